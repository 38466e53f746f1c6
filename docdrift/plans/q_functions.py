"""Key ``scalar_functions``: every string / number rule of the inventory as
one column over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.paths import stays_inside_root
from ..operators.requests import strip_comments
from . import bindings as B
from .q_docs import _DEPTH_SQL
from .q_edits import go_quote_sql, rf, trim_sql
from .registry import register

_REL = "CASE doc_id % 3 WHEN 0 THEN 'a/' WHEN 1 THEN '../' ELSE 'a/../' END || source"


@register(
    "scalar_functions",
    f"""SELECT doc_id,
        starts_with(text, 'Th') AS has_prefix,
        ends_with(text, '.') AS has_suffix,
        contains(text, 'the') AS has_the,
        md5({rf('text', "'e'", "'E'")}) AS replace_first_md5,
        md5(replace(text, 'e', 'E')) AS replace_all_md5,
        len(string_split(text, chr(10))) AS n_lines,
        lang || ', ' || source AS joined,
        {trim_sql("(chr(12288) || ' ' || lang || chr(10) || chr(9))")} AS trimmed,
        md5(rtrim(text || chr(10) || chr(10), chr(10))) AS rtrim_md5,
        instr(text, 'e') - 1 AS first_e,
        CASE WHEN instr(text, 'e') = 0 THEN -1 ELSE length(text) - instr(reverse(text), 'e') END AS last_e,
        CASE WHEN octet_length(encode(text)) > 10 THEN substring(text, 1, 10) || '...' ELSE text END AS head,
        octet_length(encode(text)) AS n_bytes,
        octet_length(encode(text)) // 4 AS est_tokens,
        CAST(CAST(round_even(100.0 * length(text) / octet_length(encode(text)), 0) AS BIGINT) AS VARCHAR) AS ascii_pct,
        md5({go_quote_sql('text')}) AS quoted_md5,
        md5(regexp_replace(text, '<!--[\\s\\S]*?-->', '', 'g')) AS no_comments_md5,
        CAST(to_json({{'lang': lang, 'doc_id': doc_id}}) AS VARCHAR) AS as_json,
        TRY_CAST(substring(source, 4) AS INTEGER) AS source_no,
        least(pow(2.0, doc_id % 8), 30.0) AS backoff_s,
        {_DEPTH_SQL.replace('segs', 'string_split(' + _REL + ", '/')")} AS safe,
        regexp_matches(text, '^\\p{{Lu}}') AS exported
    FROM documents""",
)
def q_scalar_functions(spark, sf):
    d = B.table(spark, sf, "documents", spread=True)
    text = F.col("text")
    rel = F.when(F.col("doc_id") % 3 == 0, F.lit("a/")).when(F.col("doc_id") % 3 == 1, F.lit("../")).otherwise(F.lit("a/../"))
    return d.select(
        "doc_id",
        text.startswith("Th").alias("has_prefix"),
        text.endswith(".").alias("has_suffix"),
        T.contains(text, F.lit("the")).alias("has_the"),
        F.md5(T.replace_first(text, F.lit("e"), F.lit("E"))).alias("replace_first_md5"),
        F.md5(F.replace(text, F.lit("e"), F.lit("E"))).alias("replace_all_md5"),
        F.size(F.split(text, "\n", -1)).alias("n_lines"),
        F.array_join(F.array("lang", "source"), ", ").alias("joined"),
        T.trim_space(F.concat(F.lit("　 "), F.col("lang"), F.lit("\n\t"))).alias("trimmed"),
        F.md5(T.rtrim_newlines(F.concat(text, F.lit("\n\n")))).alias("rtrim_md5"),
        (F.instr(text, "e") - 1).alias("first_e"),
        F.when(F.instr(text, "e") == 0, F.lit(-1)).otherwise(F.length(text) - F.instr(F.reverse(text), "e")).alias("last_e"),
        T.preview(text, 10, "...").alias("head"),
        T.byte_len(text).alias("n_bytes"),
        F.floor(T.byte_len(text) / 4).cast("bigint").alias("est_tokens"),
        T.percent0(100.0 * F.length(text) / T.byte_len(text)).alias("ascii_pct"),
        F.md5(T.go_quote(text)).alias("quoted_md5"),
        F.md5(strip_comments(text)).alias("no_comments_md5"),
        F.to_json(F.struct("lang", "doc_id")).alias("as_json"),
        F.substr("source", F.lit(4)).try_cast("int").alias("source_no"),
        F.least(F.pow(F.lit(2.0), F.col("doc_id") % 8), F.lit(30.0)).alias("backoff_s"),
        stays_inside_root(F.concat(rel, F.col("source"))).alias("safe"),
        T.upper_initial(text).alias("exported"),
    )
