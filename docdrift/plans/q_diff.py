"""Keys D1-D10, N1-N8, A1-A3 bound to ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import nested as N
from ..operators import summary as A
from . import bindings as B
from . import oracle_sym as O
from .registry import register

G_KEYS = ["scope", "name"]
G_CMP = ["kind", "ptype", "psize"]


def _flat(df):
    return df.withColumn("changes", F.array_join(F.transform("changes", lambda c: c["description"]), "\n"))


# --- generic keyed diff ------------------------------------------------------

_G = f"WITH go AS ({O.part_rows_sql('old')}), gn AS ({O.part_rows_sql('new')})"


@register(
    "dedupe_last",
    f"""WITH go AS ({O.part_rows_sql('old')}),
    g2 AS (SELECT scope, name, kind, ptype, psize, ordinal FROM go
           UNION ALL SELECT scope, name, kind, ptype, psize + 100, ordinal + 1000000000 FROM go)
    SELECT scope, name, kind, ptype, psize, ordinal FROM (
      SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY ordinal DESC) AS rn FROM g2) WHERE rn = 1""",
)
def q_dedupe_last(spark, sf):
    return D.dedupe_last(B.part_rows_with_copies(spark, sf), G_KEYS, "ordinal")


@register(
    "diff_added",
    _G + " SELECT * FROM gn WHERE NOT EXISTS (SELECT 1 FROM go WHERE go.scope = gn.scope AND go.name = gn.name)",
)
def q_diff_added(spark, sf):
    return D.diff_added(B.part_rows(spark, sf, "old"), B.part_rows(spark, sf, "new"), G_KEYS)


@register(
    "diff_removed",
    _G + " SELECT * FROM go WHERE NOT EXISTS (SELECT 1 FROM gn WHERE go.scope = gn.scope AND go.name = gn.name)",
)
def q_diff_removed(spark, sf):
    return D.diff_removed(B.part_rows(spark, sf, "old"), B.part_rows(spark, sf, "new"), G_KEYS)


@register(
    "diff_modified",
    _G
    + """ SELECT go.scope, go.name, go.kind AS old_kind, go.ptype AS old_ptype, go.psize AS old_psize,
                 gn.kind AS new_kind, gn.ptype AS new_ptype, gn.psize AS new_psize
          FROM go JOIN gn ON go.scope = gn.scope AND go.name = gn.name
          WHERE go.kind IS DISTINCT FROM gn.kind OR go.ptype IS DISTINCT FROM gn.ptype
             OR go.psize IS DISTINCT FROM gn.psize""",
)
def q_diff_modified(spark, sf):
    return D.diff_modified(B.part_rows(spark, sf, "old"), B.part_rows(spark, sf, "new"), G_KEYS, G_CMP)


@register(
    "snapshot_diff",
    _G
    + f""", j AS (
      SELECT coalesce(go.scope, gn.scope) AS scope, coalesce(go.name, gn.name) AS name,
             go.name IS NOT NULL AS has_o, gn.name IS NOT NULL AS has_n,
             go.kind AS old_kind, go.ptype AS old_ptype, go.psize AS old_psize,
             gn.kind AS new_kind, gn.ptype AS new_ptype, gn.psize AS new_psize,
             list_filter([CASE WHEN go.kind IS DISTINCT FROM gn.kind THEN 'kind' END,
                          CASE WHEN go.ptype IS DISTINCT FROM gn.ptype THEN 'ptype' END,
                          CASE WHEN go.psize IS DISTINCT FROM gn.psize THEN 'psize' END], lambda x: x IS NOT NULL) AS dc
      FROM go FULL OUTER JOIN gn ON go.scope = gn.scope AND go.name = gn.name),
    k AS (SELECT *, CASE WHEN NOT has_o THEN 0 WHEN NOT has_n THEN 1 WHEN len(dc) > 0 THEN 2 END AS change_ord FROM j)
    SELECT scope, name, {O.CHANGE_LIST}[change_ord + 1] AS change, change_ord,
           CASE WHEN change_ord = 2 THEN array_to_string(dc, ',') ELSE '' END AS changed_cols,
           old_kind, old_ptype, old_psize, new_kind, new_ptype, new_psize
    FROM k WHERE change_ord IS NOT NULL""",
)
def q_snapshot_diff(spark, sf):
    d = D.snapshot_diff(B.part_rows(spark, sf, "old"), B.part_rows(spark, sf, "new"), G_KEYS, G_CMP)
    return d.withColumn("changed_cols", F.array_join("changed_cols", ","))


# --- declaration diff ----------------------------------------------------------


def _sym_diff(spark, sf, renames=True):
    return D.symbol_diff(B.symbols(spark, sf, "old"), B.symbols(spark, sf, "new"), renames=renames)


_DIFF_OUT = ["repo", "path", "name", "old_name", "change", "change_ord", "kind", "signature", "old_signature", "changes"]


@register("detect_renames", "WITH " + O.diffs_sql(True) + " " + O.DIFF_SELECT)
def q_detect_renames(spark, sf):
    return _flat(_sym_diff(spark, sf)).select(*_DIFF_OUT)


@register("diff_all_files", "WITH " + O.diffs_sql(False) + " " + O.DIFF_SELECT)
def q_diff_all_files(spark, sf):
    return _flat(_sym_diff(spark, sf, renames=False)).select(*_DIFF_OUT)


# Files whose old (new) version counts as unread: those of the brands that end
# with 3 (4). What they would have held is unknown.
_UNKNOWN_SQL = "((change_ord = 0 AND ends_with(path, '3.go')) OR (change_ord = 1 AND ends_with(path, '4.go')))"


@register(
    "parse_failed",
    "WITH " + O.diffs_sql(True, _UNKNOWN_SQL) + " " + O.DIFF_SELECT.replace(" FROM d", f", {_UNKNOWN_SQL} AS parse_failed FROM d"),
)
def q_parse_failed(spark, sf):
    files = B.symbols(spark, sf, "old").unionByName(B.symbols(spark, sf, "new")).select("repo", "path")
    side = F.when(F.col("path").endswith("3.go"), "old").when(F.col("path").endswith("4.go"), "new")
    failed = files.select("repo", "path", side.alias("side")).filter(F.col("side").isNotNull())
    d = D.symbol_diff(B.symbols(spark, sf, "old"), B.symbols(spark, sf, "new"), failed=failed)
    return _flat(d).select(*_DIFF_OUT, "parse_failed")


@register(
    "strict_renames",
    "WITH " + O.diffs_sql(True, "kind NOT IN ('func', 'method', 'struct')") + " " + O.DIFF_SELECT,
)
def q_strict_renames(spark, sf):
    d = D.symbol_diff(B.symbols(spark, sf, "old"), B.symbols(spark, sf, "new"), strict_renames=True)
    return _flat(d).select(*_DIFF_OUT)


@register(
    "order_diffs",
    "WITH " + O.diffs_sql(True) + " " + O.DIFF_SELECT + " ORDER BY repo, path, change_ord, name",
)
def q_order_diffs(spark, sf):
    return D.order_diffs(_flat(_sym_diff(spark, sf)).select(*_DIFF_OUT))


@register(
    "change_counts",
    "WITH " + O.diffs_sql(True) + f" SELECT repo, {O.CHANGE_LIST}[change_ord + 1] AS change, count(*) AS n FROM d GROUP BY ALL",
)
def q_change_counts(spark, sf):
    return D.change_counts(_sym_diff(spark, sf))


@register(
    "shape_key",
    f"WITH s AS ({O.symbols_sql('new')}) SELECT repo, path, name, sha256({O.shape_json()}) AS shape FROM s",
)
def q_shape_key(spark, sf):
    s = B.symbols(spark, sf, "new")
    return s.select("repo", "path", "name", F.struct(*s.columns).alias("sym")).select(
        "repo", "path", "name", D.shape_key("sym").alias("shape")
    )


@register(
    "kind_labels",
    f"""SELECT p_partkey,
           coalesce({O.KIND_LIST}[CAST(p_partkey % 9 AS INTEGER) + 1], 'unknown') AS kind,
           coalesce({O.CHANGE_LIST}[CAST(p_partkey % 5 AS INTEGER) + 1], 'unknown') AS change
        FROM part""",
)
def q_kind_labels(spark, sf):
    p = B.table(spark, sf, "part")
    return p.select(
        "p_partkey",
        D.kind_label(p.p_partkey % 9).alias("kind"),
        D.change_label(p.p_partkey % 5).alias("change"),
    )


# --- nested comparisons (matched pairs of the declaration binding) ---------------


def _pairs(spark, sf):
    o = D.dedupe_last(B.symbols(spark, sf, "old"), D.SYMBOL_KEYS)
    n = D.dedupe_last(B.symbols(spark, sf, "new"), D.SYMBOL_KEYS)
    vals = [c for c in o.columns if c not in D.SYMBOL_KEYS]
    return o.select(*D.SYMBOL_KEYS, F.struct(*vals).alias("o")).join(
        n.select(*D.SYMBOL_KEYS, F.struct(*vals).alias("n")), D.SYMBOL_KEYS, "inner"
    )


def _pairs_sql(expr: str) -> str:
    return "WITH " + O.joined_sql() + f" SELECT repo, path, name, array_to_string({expr}, chr(10)) AS changes FROM j WHERE has_o AND has_n"


def _nested_key(key, spark_fn, sql_expr):
    @register(key, _pairs_sql(sql_expr))
    def q(spark, sf):
        p = _pairs(spark, sf)
        return p.select("repo", "path", "name", F.array_join(spark_fn(F.col("o"), F.col("n")), "\n").alias("changes"))

    return q


_nested_key("cmp_kind", lambda o, n: N.cmp_kind(o["kind"], n["kind"]), O.cmp_kind("o_kind", "n_kind"))
_nested_key("cmp_params", lambda o, n: N.cmp_params(o["params"], n["params"]), O.cmp_params("o_params", "n_params"))
_nested_key("cmp_returns", lambda o, n: N.cmp_returns(o["returns"], n["returns"]), O.cmp_returns("o_returns", "n_returns"))
_nested_key("cmp_fields", lambda o, n: N.cmp_fields(o["fields"], n["fields"]), O.cmp_fields("o_fields", "n_fields"))
_nested_key("cmp_methods", lambda o, n: N.cmp_methods(o["methods"], n["methods"]), O.cmp_methods("o_methods", "n_methods"))
_nested_key("cmp_receiver", lambda o, n: N.cmp_receiver(o["recv"], n["recv"]), O.cmp_receiver("o_recv", "n_recv"))
def _found(o, n):
    """What else differs: the signature rule only speaks where this is empty."""
    return F.concat(
        N.cmp_kind(o["kind"], n["kind"]), N.cmp_params(o["params"], n["params"]), N.cmp_fields(o["fields"], n["fields"])
    )


_FOUND_SQL = (
    f"len(({O.cmp_kind('o_kind', 'n_kind')})) + len(({O.cmp_params('o_params', 'n_params')}))"
    f" + len(({O.cmp_fields('o_fields', 'n_fields')}))"
)
_nested_key(
    "cmp_signature",
    lambda o, n: N.cmp_signature(o["signature"], n["signature"], _found(o, n)),
    f"(CASE WHEN o_signature <> n_signature AND {_FOUND_SQL} = 0 THEN ['signature changed from ' || {O.go_quote('o_signature')} || ' to ' || {O.go_quote('n_signature')}] ELSE {O.E} END)",
)


@register(
    "format_params",
    f"WITH s AS ({O.symbols_sql('old')}) SELECT repo, path, name, {O.fmt_list('params')} AS params, {O.fmt_list('returns')} AS returns FROM s",
)
def q_format_params(spark, sf):
    s = B.symbols(spark, sf, "old")
    return s.select("repo", "path", "name", N.format_params("params").alias("params"), N.format_params("returns").alias("returns"))


# --- summaries -------------------------------------------------------------------

_REPOS_SQL = "repos AS (SELECT DISTINCT p_type AS repo FROM part)"


def _verbose_sql() -> str:
    return (
        "WITH "
        + O.diffs_sql(True)
        + ", "
        + _REPOS_SQL
        + """,
    lines AS (
      SELECT repo, change_ord AS section, path, name, 0 AS j,
             CASE change_ord WHEN 0 THEN '- ' || signature WHEN 1 THEN '- ' || old_signature
                  ELSE '- ' || old_name || ' -> ' || name || ': ' || signature END AS line
      FROM d WHERE change_ord <> 2
      UNION ALL
      SELECT repo, 2, path, name, u.j - 1, '- ' || kind || ' ' || name || ': ' || u.c
      FROM d, unnest(ch) WITH ORDINALITY AS u(c, j) WHERE change_ord = 2
    ),
    chunks AS (
      SELECT repo, section, path, string_agg(line, chr(10) ORDER BY name, j) AS chunk FROM lines GROUP BY repo, section, path
    )
    SELECT r.repo, section, path, coalesce(chunk, 'No changes to exported symbols') AS chunk
    FROM repos r LEFT JOIN chunks c ON r.repo = c.repo"""
    )


def _compact_sql() -> str:
    return (
        "WITH "
        + O.diffs_sql(True)
        + ", "
        + _REPOS_SQL
        + """,
    lines AS (
      SELECT repo, path, change_ord, name,
             CASE change_ord WHEN 0 THEN '+ ADDED   ' || name || ': ' || signature
                  WHEN 1 THEN '- REMOVED ' || name || ': ' || old_signature
                  WHEN 2 THEN '~ CHANGED ' || name || chr(10) || '  was: ' || old_signature || chr(10) || '  now: ' || signature
                  ELSE '→ RENAMED ' || old_name || ' → ' || name || ': ' || signature END AS line
      FROM d
    ),
    chunks AS (SELECT repo, path, string_agg(line, chr(10) ORDER BY change_ord, name) AS chunk FROM lines GROUP BY repo, path)
    SELECT r.repo, path, coalesce(chunk, 'No changes to exported symbols') AS chunk
    FROM repos r LEFT JOIN chunks c ON r.repo = c.repo"""
    )


def _repos(spark, sf):
    return B.table(spark, sf, "part").select(F.col("p_type").alias("repo"))


@register("summary_verbose", _verbose_sql())
def q_summary_verbose(spark, sf):
    return A.verbose_chunks(_sym_diff(spark, sf), _repos(spark, sf))


@register("summary_compact", _compact_sql())
def q_summary_compact(spark, sf):
    return A.compact_chunks(_sym_diff(spark, sf), _repos(spark, sf))


_PARTS_SQL = """, sized AS (
      SELECT *, coalesce(sum(octet_length(encode(chunk)) + 1) OVER (
        PARTITION BY repo ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM all_chunks),
    parts AS (SELECT repo, CAST(at_ // {size} AS BIGINT) AS part, CAST(min(at_) AS BIGINT) AS offset_, string_agg(chunk, chr(10) ORDER BY at_) AS text
              FROM sized GROUP BY ALL),
    ended AS (SELECT *, CASE WHEN part = max(part) OVER (PARTITION BY repo) THEN text ELSE text || chr(10) END AS full_text FROM parts)
    SELECT repo, part, offset_ AS "offset", octet_length(encode(full_text)) AS n_bytes, md5(full_text) AS md5 FROM ended"""
#: Small parts, so that every repository has several.
_PART = 512


def _all_chunks_sql(sql: str) -> str:
    """The chunk query as one more CTE."""
    head, select = sql.rsplit("\n    SELECT r.repo", 1)
    return f"{head}, plain_chunks AS (SELECT r.repo{select})"


def _parts(df):
    return df.select("repo", "part", "offset", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5"))


@register(
    "compact_parts",
    _all_chunks_sql(_compact_sql()) + ", all_chunks AS (SELECT * FROM plain_chunks)" + _PARTS_SQL.format(order="path", size=_PART),
)
def q_compact_parts(spark, sf):
    return _parts(A.compact_parts(_sym_diff(spark, sf), _repos(spark, sf), _PART))


_TITLES = "['" + "', '".join(A.SECTIONS) + "']"


@register(
    "verbose_parts",
    _all_chunks_sql(_verbose_sql())
    + f""", all_chunks AS (
      SELECT repo, section, 1 AS k, path, chunk FROM plain_chunks
      UNION ALL
      SELECT repo, section, 0, '', CASE WHEN section = min(section) OVER (PARTITION BY repo) THEN '' ELSE chr(10) END || {_TITLES}[section + 1]
      FROM (SELECT DISTINCT repo, section FROM plain_chunks WHERE section IS NOT NULL))"""
    + _PARTS_SQL.format(order="section, k, path", size=_PART),
)
def q_verbose_parts(spark, sf):
    return _parts(A.verbose_parts(_sym_diff(spark, sf), _repos(spark, sf), _PART))
