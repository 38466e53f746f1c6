"""Keys S4, R4-R11, V1-V4, S6, A6 bound to ``documents`` (replies derived
per document, see ``bindings.reply_bodies``)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.text import SPACE_CLASS
from ..operators import edits as E
from ..operators import validate as V
from ..session import checkpoint_dir, cut_lineage
from ..sources import doc_store as DS
from ..sources import replies as SR
from . import bindings as B
from .registry import register

# --- Spark side -------------------------------------------------------------------


def _gated(spark, sf):
    return SR.gate_replies(SR.decode_replies(B.reply_bodies(spark, sf)))


def _decoded(spark, sf):
    return SR.decode_edits(_gated(spark, sf)).filter(F.col("reply_status") == "ok")


def _applied(spark, sf):
    dec = _decoded(spark, sf).filter(F.col("decode_status") == "ok")
    return E.apply_edits(B.docs_table(spark, sf), dec)


def _flagged(spark, sf):
    # the changed documents feed both the validation and the block flag:
    # store them once rather than decoding and folding every reply twice
    updates = cut_lineage(E.changed_docs(_applied(spark, sf)))
    issues = V.validate_updates(B.docs_table(spark, sf, spread=False), updates)
    return V.blocked_docs(updates, issues)


# --- SQL side ---------------------------------------------------------------------

TRIM = f"regexp_replace({{x}}, '^{SPACE_CLASS}+|{SPACE_CLASS}+$', '', 'g')"


def trim_sql(x: str) -> str:
    return TRIM.replace("{x}", x)


def rf(c: str, old: str, new: str) -> str:
    return (f"(CASE WHEN instr({c}, {old}) = 0 THEN {c} ELSE substring({c}, 1, instr({c}, {old}) - 1) || {new} || "
            f"substring({c}, instr({c}, {old}) + length({old})) END)")


def edit_sql(file_: str, action: str, old: str, new: str) -> str:
    return f"{{'file': {file_}, 'action': '{action}', 'old_text': {old}, 'new_text': {new}}}"


_W = r"regexp_extract(text, '^(\S+)', 1)"
_EDITS = f"""list_filter([
    {edit_sql('path', 'replace', _W, f"'[' || {_W} || ']'")},
    {edit_sql('path', 'insert_after', f"'[' || {_W} || ']'", "'Note ' || CAST(doc_id AS VARCHAR)")},
    {edit_sql('path', 'delete', "'absent text ' || CAST(doc_id AS VARCHAR)", "''")},
    {edit_sql('path', 'rewrite', _W, "'x'")},
    CASE WHEN doc_id % 5 = 0 THEN {edit_sql('path', 'delete', 'substring(text, CAST(floor(length(text) * 0.4) AS BIGINT) + 1)', "''")} END,
    CASE WHEN doc_id % 4 = 1 THEN {edit_sql("'other.md'", 'replace', _W, "'y'")} END
  ], lambda x: x IS NOT NULL)"""

BASE = f"""docs AS (
    SELECT lang AS repo, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path,
           doc_id, text, text AS content FROM documents),
  rep AS (
    SELECT *, CAST(to_json({{'edits': edits}}) AS VARCHAR) AS ej FROM (SELECT *, {_EDITS} AS edits FROM docs)),
  rep2 AS (
    SELECT *, CASE doc_id % 7 WHEN 3 THEN 'truncated' WHEN 4 THEN 'empty_content' WHEN 5 THEN 'no_choices' ELSE 'ok' END AS reply_status,
           CASE doc_id % 7 WHEN 2 THEN 'bad_json' ELSE 'ok' END AS decode_status,
           CASE doc_id % 7 WHEN 0 THEN ej WHEN 1 THEN ej WHEN 2 THEN '```' || ej || '```'
                WHEN 6 THEN '{{"edits": null, "reason": "none"}}' END AS stripped,
           CASE doc_id % 7 WHEN 1 THEN '```json' || chr(10) || ej || chr(10) || '```' WHEN 2 THEN '```' || ej || '```'
                WHEN 4 THEN '' WHEN 6 THEN ' {{"edits": null, "reason": "none"}} ' ELSE ej END AS raw
    FROM rep),
  okr AS (SELECT * FROM rep2 WHERE reply_status = 'ok' AND decode_status = 'ok'),
  ed AS (
    SELECT o.repo, o.path, CAST(u.i - 1 AS BIGINT) AS seq, u.e.file AS file, u.e.action AS action,
           u.e.old_text AS old_text, u.e.new_text AS new_text
    FROM okr o, unnest(CASE WHEN o.doc_id % 7 = 6 THEN [] ELSE o.edits END) WITH ORDINALITY AS u(e, i)),
  fold AS (
    WITH RECURSIVE f(repo, path, step, content, err, flen, file, action, old_text, new_text) AS (
      SELECT repo, path, CAST(0 AS BIGINT), content, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
             CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM okr
      UNION ALL
      SELECT f.repo, f.path, f.step + 1,
             CASE WHEN x.err IS NULL THEN x.applied ELSE f.content END, x.err, octet_length(encode(f.content)),
             e.file, e.action, e.old_text, e.new_text
      FROM f JOIN ed e ON e.repo = f.repo AND e.path = f.path AND e.seq = f.step,
      LATERAL (SELECT
          CASE WHEN e.file <> f.path THEN 'unknown_file'
               WHEN e.action IN ('replace', 'delete') AND instr(f.content, e.old_text) = 0 THEN 'not_found'
               WHEN e.action = 'insert_after' AND instr(f.content, e.old_text) = 0 THEN 'anchor_not_found'
               WHEN e.action = 'insert_after' AND instr(f.content, {trim_sql('e.new_text')}) > 0 THEN 'duplicate'
               WHEN e.action NOT IN ('replace', 'delete', 'insert_after') THEN 'unknown_action' END AS err,
          CASE e.action WHEN 'replace' THEN {rf('f.content', 'e.old_text', 'e.new_text')}
                        WHEN 'delete' THEN {rf('f.content', 'e.old_text', "''")}
                        ELSE {rf('f.content', 'e.old_text', "e.old_text || chr(10) || e.new_text")} END AS applied) x
    ) SELECT * FROM f),
  final AS (SELECT repo, path, arg_max(content, step) AS new_content FROM fold GROUP BY repo, path),
  applied AS (SELECT f.repo, f.path, d.content, f.new_content FROM final f JOIN docs d ON d.repo = f.repo AND d.path = f.path),
  upd AS (SELECT repo, path, new_content AS content FROM applied WHERE new_content <> content),
  iss AS (
    SELECT u.repo, u.path AS file,
           CASE WHEN u.content = '' THEN 'updated content is empty'
                ELSE 'content shrank by ' || CAST(CAST(round_even((o - n) * 100.0 / o, 0) AS BIGINT) AS VARCHAR) || '% (' ||
                     CAST(o AS VARCHAR) || ' → ' || CAST(n AS VARCHAR) || ' bytes), exceeds 50% threshold' END AS message,
           true AS rejected
    FROM (SELECT u.*, octet_length(encode(d.content)) AS o, octet_length(encode(u.content)) AS n
          FROM upd u JOIN docs d ON d.repo = u.repo AND d.path = u.path) u
    WHERE u.content = '' OR (o > 0 AND (o - n) * 1.0 / o > 0.5)),
  flagged AS (
    SELECT u.*, EXISTS (SELECT 1 FROM iss i WHERE i.repo = u.repo AND i.file = u.path AND i.rejected) AS blocked FROM upd u)"""


def _w(select: str) -> str:
    return "WITH " + BASE + " " + select


def go_quote_sql(x: str) -> str:
    s = f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
    return f"('\"' || {s} || '\"')"


# --- keys -------------------------------------------------------------------------


@register(
    "decode_replies",
    _w("""SELECT repo, path, true AS reply_ok, CASE WHEN doc_id % 7 = 5 THEN 0 ELSE 1 END AS n_choices,
               CASE WHEN doc_id % 7 = 5 THEN NULL WHEN doc_id % 7 = 3 THEN 'length' ELSE 'stop' END AS finish_reason,
               CASE WHEN doc_id % 7 = 5 THEN NULL ELSE octet_length(encode(raw)) END AS content_bytes,
               CAST(octet_length(encode(text)) // 4 AS INTEGER) AS prompt_tokens FROM rep2"""),
)
def q_decode_replies(spark, sf):
    r = SR.decode_replies(B.reply_bodies(spark, sf))
    first = F.try_element_at("reply.choices", F.lit(1))
    return r.select(
        "repo", "path", "reply_ok", F.size("reply.choices").alias("n_choices"),
        first["finish_reason"].alias("finish_reason"),
        F.octet_length(first["message"]["content"]).alias("content_bytes"),
        F.col("reply.usage.prompt_tokens").alias("prompt_tokens"),
    )


@register("gate_replies", _w("SELECT repo, path, reply_status FROM rep2"))
def q_gate_replies(spark, sf):
    return _gated(spark, sf).select("repo", "path", "reply_status")


@register("strip_fences", _w("SELECT repo, path, md5(stripped) AS stripped_md5 FROM rep2 WHERE reply_status = 'ok'"))
def q_strip_fences(spark, sf):
    g = _gated(spark, sf).filter(F.col("reply_status") == "ok")
    return g.select("repo", "path", F.md5(SR.strip_fences(F.col("raw"))).alias("stripped_md5"))


@register(
    "decode_edits",
    _w("""SELECT repo, path, decode_status,
               CASE WHEN decode_status <> 'ok' THEN NULL WHEN doc_id % 7 = 6 THEN 0 ELSE len(edits) END AS n_edits
          FROM rep2 WHERE reply_status = 'ok'"""),
)
def q_decode_edits(spark, sf):
    return _decoded(spark, sf).select("repo", "path", "decode_status", F.size("edits").alias("n_edits"))


@register(
    "explode_edits",
    _w("""SELECT o.repo, o.path, CAST(u.i - 1 AS INTEGER) AS seq, u.e.file AS file, u.e.action AS action,
                 u.e.old_text AS old_text, u.e.new_text AS new_text
          FROM okr o LEFT JOIN LATERAL (SELECT * FROM unnest(CASE WHEN o.doc_id % 7 = 6 THEN [] ELSE o.edits END) WITH ORDINALITY AS t(e, i)) u ON true"""),
)
def q_explode_edits(spark, sf):
    dec = _decoded(spark, sf).filter(F.col("decode_status") == "ok")
    return SR.explode_edits(dec, ["repo", "path"]).drop("section")


@register(
    "scope_edits",
    _w("SELECT repo, path, CAST(seq AS INTEGER) AS seq, file, file = path AS in_scope FROM ed"),
)
def q_scope_edits(spark, sf):
    dec = _decoded(spark, sf).filter(F.col("decode_status") == "ok")
    ex = SR.explode_edits(dec, ["repo", "path"]).filter(F.col("seq").isNotNull())
    return E.scope_edits(ex).select("repo", "path", "seq", "file", "in_scope")


@register(
    "apply_edits",
    _w("SELECT repo, path, octet_length(encode(new_content)) AS new_bytes, md5(new_content) AS new_md5 FROM applied"),
)
def q_apply_edits(spark, sf):
    a = _applied(spark, sf)
    return a.select("repo", "path", F.octet_length("new_content").alias("new_bytes"), F.md5("new_content").alias("new_md5"))


@register(
    "skipped_edits",
    _w("SELECT repo, path, CAST(step - 1 AS INTEGER) AS seq, file, action, err AS error FROM fold WHERE err IS NOT NULL"),
)
def q_skipped_edits(spark, sf):
    return E.skipped_edits(_applied(spark, sf))


@register("changed_docs", _w("SELECT repo, path, octet_length(encode(content)) AS n_bytes, md5(content) AS md5 FROM upd"))
def q_changed_docs(spark, sf):
    c = E.changed_docs(_applied(spark, sf))
    return c.select("repo", "path", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("md5"))


@register(
    "validate_edits",
    _w(f"""SELECT repo, path, CAST(step - 1 AS INTEGER) AS seq, action, CAST(flen AS INTEGER) AS file_len,
          CASE WHEN action = 'replace' AND new_text = '' THEN 'replace has empty new_text for ' ||
                    {go_quote_sql("CASE WHEN octet_length(encode(old_text)) > 80 THEN substring(old_text, 1, 80) || '...' ELSE old_text END")}
               WHEN action = 'delete' AND flen > 0 AND octet_length(encode(old_text)) * 1.0 / flen > 0.3 THEN
                    'single delete removes ' || CAST(CAST(round_even(octet_length(encode(old_text)) * 100.0 / flen, 0) AS BIGINT) AS VARCHAR) ||
                    '% of file (' || CAST(octet_length(encode(old_text)) AS VARCHAR) || ' of ' || CAST(flen AS VARCHAR) || ' bytes)'
          END AS message, false AS rejected
        FROM fold WHERE step > 0"""),
)
def q_validate_edits(spark, sf):
    a = _applied(spark, sf)
    log = a.select("repo", "path", F.explode("log").alias("l")).select(
        "repo", "path", "l.seq", "l.action", "l.old_text", "l.new_text", "l.file_len"
    )
    return V.validate_edits(log).select("repo", "path", "seq", "action", "file_len", "message", "rejected")


@register("validate_updates", _w("SELECT repo, file, message, rejected FROM iss"))
def q_validate_updates(spark, sf):
    updates = E.changed_docs(_applied(spark, sf))
    return V.validate_updates(B.docs_table(spark, sf, spread=False), updates)


@register("blocked_docs", _w("SELECT repo, path, blocked FROM flagged"))
def q_blocked_docs(spark, sf):
    return _flagged(spark, sf).select("repo", "path", "blocked")


@register(
    "dry_run_report",
    _w("SELECT repo, path, CASE WHEN blocked THEN 'would block' ELSE 'would update' END AS action FROM flagged"),
)
def q_dry_run_report(spark, sf):
    return V.dry_run_report(_flagged(spark, sf))


_READY = """ready AS (
    SELECT f.repo, f.path,
           CASE WHEN f.blocked THEN 'blocked' WHEN f.content = '' THEN 'empty'
                WHEN NOT EXISTS (SELECT 1 FROM docs d WHERE d.repo = f.repo AND d.path = f.path) THEN 'missing_target'
                ELSE 'written' END AS outcome,
           CASE WHEN ends_with(f.content, chr(10)) THEN f.content ELSE f.content || chr(10) END AS content
    FROM flagged f)"""


@register(
    "write_ready_docs",
    "WITH " + BASE + ", " + _READY + " SELECT repo, path, outcome, octet_length(encode(content)) AS n_bytes FROM ready",
)
def q_write_ready_docs(spark, sf):
    r = V.write_ready_docs(_flagged(spark, sf), B.docs_table(spark, sf, spread=False))
    return r.select("repo", "path", "outcome", F.octet_length("content").alias("n_bytes"))


@register(
    "outcome_counts",
    "WITH " + BASE + ", " + _READY + """ SELECT repo, count(*) FILTER (WHERE outcome = 'written') AS written,
        count(*) FILTER (WHERE outcome = 'blocked') AS blocked,
        count(*) FILTER (WHERE outcome NOT IN ('written', 'blocked')) AS refused FROM ready GROUP BY repo""",
)
def q_outcome_counts(spark, sf):
    return V.outcome_counts(V.write_ready_docs(_flagged(spark, sf), B.docs_table(spark, sf, spread=False)))


@register(
    "merge_docs",
    "WITH " + BASE + ", " + _READY + """ SELECT d.repo, d.path, octet_length(encode(coalesce(r.content, d.content))) AS n_bytes,
        md5(coalesce(r.content, d.content)) AS md5
        FROM docs d LEFT JOIN ready r ON r.repo = d.repo AND r.path = d.path AND r.outcome = 'written'""",
)
def q_merge_docs(spark, sf):
    """The whole document table after the run's results are merged into it (the
    second merge is a replay and changes nothing)."""
    store = f"{checkpoint_dir(spark)}/docdrift-store-{uuid.uuid4().hex}"
    DS.create_docs(B.docs_table(spark, sf, spread=False), store, buckets=16)
    ready = cut_lineage(V.write_ready_docs(_flagged(spark, sf), B.docs_table(spark, sf, spread=False)))
    for _ in range(2):
        version = DS.merge_docs(ready, store, "run-1")
    docs = DS.read_docs(spark, store, version)
    return docs.select("repo", "path", F.octet_length("content").alias("n_bytes"), F.md5("content").alias("md5"))
