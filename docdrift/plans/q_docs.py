"""Keys S1-S3, C1-C6, M1-M3, A4, A5 bound to ``documents`` and ``pages``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.paths import stays_inside_root
from ..operators import changes as C
from ..operators import select as M
from ..session import checkpoint_dir, cut_lineage
from ..sources import docs as SD
from ..sources import snapshots as SS
from ..sources import text_store as TS
from . import bindings as B
from .registry import register

# --- SQL derivations (the same rules as bindings.py) ------------------------------

EXT = "CASE WHEN doc_id % 6 = 5 THEN '.txt' WHEN doc_id % 6 = 4 THEN '_test.go' ELSE '.go' END"
SNAP_OLD = f"""SELECT lang AS repo, 'base' AS ref, 'pkg/' || source || '/f' || CAST(doc_id AS VARCHAR) || {EXT} AS path,
                      text || chr(10) AS content FROM documents WHERE doc_id % 10 <> 0"""
SNAP_NEW = f"""SELECT lang AS repo, 'head' AS ref, 'pkg/' || source || '/f' || CAST(doc_id AS VARCHAR) || {EXT} AS path,
                      CASE WHEN doc_id % 10 = 2 THEN text || chr(10) || 'extra line' ELSE text END || chr(10) AS content
               FROM documents WHERE doc_id % 10 <> 1"""
DOCS = """SELECT lang AS repo, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) ||
                 CASE WHEN doc_id % 9 = 0 THEN '.txt' ELSE '.md' END AS path, text AS content FROM documents"""
ROOTS = """SELECT DISTINCT lang AS repo, r.root FROM documents,
             (VALUES ('docs/src1'), ('docs/src2/'), ('./docs/src3'), ('README.md')) AS r(root)"""
EXCLUDES = """SELECT lang AS repo, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path
              FROM documents WHERE doc_id % 13 = 0"""
MAPPINGS = """SELECT lang AS repo, doc_id AS mapping_id,
                     ['docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md', 'docs/' || source || '/README.md'] AS docs,
                     ['pkg/' || source] AS code
              FROM documents WHERE doc_id % 3 = 0"""
CHANGED = f"""so AS ({SNAP_OLD}), sn AS ({SNAP_NEW}),
  changed AS (
    SELECT coalesce(so.repo, sn.repo) AS repo, coalesce(so.path, sn.path) AS path,
           CASE WHEN so.path IS NULL THEN 'added' WHEN sn.path IS NULL THEN 'removed' ELSE 'modified' END AS change,
           so.content AS oc, sn.content AS nc
    FROM so FULL OUTER JOIN sn ON so.repo = sn.repo AND so.path = sn.path
    WHERE so.content IS DISTINCT FROM sn.content)"""
SCANNED = f"""docs AS ({DOCS}), roots AS ({ROOTS}), excl AS ({EXCLUDES}),
  nroots AS (SELECT DISTINCT repo, CASE WHEN r2 = '.' THEN '' ELSE r2 END AS root FROM
             (SELECT repo, regexp_replace(regexp_replace(root, '/+$', ''), '^(\\./)+', '') AS r2 FROM roots)),
  scanned AS (
    SELECT d.* FROM docs d
    WHERE ends_with(d.path, '.md')
      AND EXISTS (SELECT 1 FROM nroots r WHERE r.repo = d.repo
                  AND (d.path = r.root OR r.root = '' OR starts_with(d.path, r.root || '/')))
      AND NOT EXISTS (SELECT 1 FROM excl e WHERE e.repo = d.repo AND e.path = d.path))"""
PAIRS = f"""maps AS ({MAPPINGS}),
  pairs AS (SELECT repo, mapping_id, c AS code_prefix, unnest(docs) AS doc_path FROM (SELECT repo, mapping_id, docs, unnest(code) AS c FROM maps))"""
MATCHED = PAIRS + """,
  goch AS (SELECT repo, path FROM changed WHERE ends_with(path, '.go')),
  hit AS (SELECT DISTINCT p.repo, p.mapping_id FROM pairs p JOIN goch c ON p.repo = c.repo AND starts_with(c.path, p.code_prefix)),
  mapped AS (SELECT DISTINCT p.repo, p.doc_path FROM pairs p JOIN hit h ON p.repo = h.repo AND p.mapping_id = h.mapping_id)"""
SELECTED = f"""{SCANNED}, {CHANGED}, {MATCHED},
  flagged AS (SELECT s.*, EXISTS (SELECT 1 FROM mapped m WHERE m.repo = s.repo AND m.doc_path = s.path) AS hit FROM scanned s),
  selected AS (SELECT f.repo, f.path, f.content FROM flagged f
               WHERE f.hit OR NOT (SELECT bool_or(g.hit) FROM flagged g WHERE g.repo = f.repo))"""
SIZED = """sized AS (SELECT repo, path, octet_length(encode(content)) AS n_bytes FROM docs),
  est AS (SELECT repo, count(*) AS n_docs, sum(n_bytes) AS total_bytes, sum(n_bytes) // 4 AS est_tokens FROM sized GROUP BY repo)"""
ESTIMATE = f"docs AS ({DOCS}), {SIZED}"
ALL_ROOTS = "SELECT DISTINCT lang AS repo, 'docs' AS root FROM documents"
BOTH_ESTIMATES = f"""{SELECTED.replace(ROOTS, ALL_ROOTS)},
  {SIZED},
  chosen AS (SELECT repo, count(*) AS n, coalesce(sum(octet_length(encode(content))), 0) AS b FROM selected GROUP BY repo),
  both_est AS (
    SELECT est.*, coalesce(n, 0) AS n_selected, CAST(coalesce(b, 0) AS BIGINT) AS selected_bytes, CAST(coalesce(b, 0) // 4 AS BIGINT) AS selected_tokens
    FROM est LEFT JOIN chosen ON est.repo = chosen.repo)"""


# --- Spark side -----------------------------------------------------------------


def _changed(spark, sf):
    # hashed at the scan: no text is dealt out for a comparison of hashes
    return C.changed_paths(B.code_snapshot(spark, sf, "old", spread=False), B.code_snapshot(spark, sf, "new", spread=False))


def _scanned(spark, sf):
    return SD.scan_docs(B.docs_table(spark, sf), B.doc_roots(spark, sf), B.doc_excludes(spark, sf))


def _pairs(spark, sf):
    return SD.mapping_pairs(B.mappings(spark, sf))


def _go_changed(spark, sf):
    return SS.filter_source_files(_changed(spark, sf)).select("repo", "path")


def _sizes(spark, sf):
    """Keys and byte counts of all documents, taken at the scan."""
    return B.docs_table(spark, sf, spread=False).select("repo", "path", F.octet_length("content").alias("n_bytes"))


def _selected_sizes(spark, sf, sizes=None, roots=B.DOC_ROOTS):
    # the size keys need each selected document's byte count only: take it at
    # the scan so no text travels at all; what selection reads several times
    # (documents' keys and sizes, mapping pairs, changed paths) is stored once
    d = cut_lineage(_sizes(spark, sf)) if sizes is None else sizes
    scanned = cut_lineage(SD.scan_docs(d, B.doc_roots(spark, sf, roots), B.doc_excludes(spark, sf)))
    mapped = M.mapped_docs(cut_lineage(_go_changed(spark, sf)), cut_lineage(_pairs(spark, sf)))
    return M.select_docs(scanned, mapped)


def _estimates(spark, sf, estimate):
    """``estimate`` of each repository's documents, and beside it that of the
    documents which a run over all folders selects (none: 0, within)."""
    sizes = cut_lineage(_sizes(spark, sf))
    every, chosen = estimate(sizes), estimate(_selected_sizes(spark, sf, sizes, B.ALL_ROOTS))
    names = {"n_docs": "n_selected", "total_bytes": "selected_bytes", "est_tokens": "selected_tokens", "within_budget": "selected_within_budget"}
    names = {c: n for c, n in names.items() if c in chosen.columns}
    both = every.join(chosen.select("repo", *[F.col(c).alias(n) for c, n in names.items()]), "repo", "left")
    return both.select(*every.columns, *[F.coalesce(n, F.lit(True if c == "within_budget" else 0)).alias(n) for c, n in names.items()])


@register(
    "scan_snapshot",
    f"""SELECT repo, ref, path, sha256(content) AS content_hash, octet_length(encode(content)) AS n_bytes
        FROM ({SNAP_OLD} UNION ALL {SNAP_NEW})""",
)
def q_scan_snapshot(spark, sf):
    s = B.code_snapshot(spark, sf, "old").unionByName(B.code_snapshot(spark, sf, "new"))
    return s.select("repo", "ref", "path", "content_hash", F.octet_length("content").alias("n_bytes"))


@register("changed_paths", f"WITH {CHANGED} SELECT repo, path, change FROM changed")
def q_changed_paths(spark, sf):
    return _changed(spark, sf)


@register(
    "changed_files",
    f"""WITH {CHANGED} SELECT repo, path, coalesce(regexp_replace(oc, '\\n+$', ''), '') AS old_content,
        coalesce(nc, '') AS new_content FROM changed""",
)
def q_changed_files(spark, sf):
    return C.changed_files(B.code_snapshot(spark, sf, "old"), B.code_snapshot(spark, sf, "new"))


@register(
    "normalise_content",
    f"SELECT repo, path, regexp_replace(content, '\\n+$', '') AS content FROM ({SNAP_OLD})",
)
def q_normalise_content(spark, sf):
    s = B.code_snapshot(spark, sf, "old")
    return s.select("repo", "path", C.normalise_content(F.col("content")).alias("content"))


@register(
    "filter_source_files",
    f"SELECT repo, ref, path FROM ({SNAP_OLD} UNION ALL {SNAP_NEW}) WHERE ends_with(path, '.go')",
)
def q_filter_source_files(spark, sf):
    s = B.code_snapshot(spark, sf, "old").unionByName(B.code_snapshot(spark, sf, "new"))
    return SS.filter_source_files(s).select("repo", "ref", "path")


@register(
    "split_lines",
    """SELECT doc_id, CAST(u.i AS BIGINT) AS line_no, u.line
       FROM documents, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) WITH ORDINALITY AS u(line, i)
       WHERE text <> ''""",
)
def q_split_lines(spark, sf):
    d = B.table(spark, sf, "documents", spread=True).select("doc_id", F.col("text").alias("content"))
    return C.split_lines(d).select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


_DEPTH_SQL = """list_bool_and(list_transform(generate_series(1, len(segs)), lambda i:
      list_sum(list_transform(segs[1:i], lambda s: CASE WHEN s = '..' THEN -1 WHEN s = '.' OR s = '' THEN 0 ELSE 1 END)) >= 0))"""


@register(
    "safe_paths",
    f"""WITH p AS (
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN t WHEN 1 THEN '../' || t WHEN 2 THEN 'a/../' || t ELSE '/x/../../' || t END AS path
      FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1) AS t FROM pages))
    SELECT page_id, path, {_DEPTH_SQL} AS safe FROM (SELECT *, string_split(path, '/') AS segs FROM p)""",
)
def q_safe_paths(spark, sf):
    p = B.page_paths(spark, sf)
    return p.select("page_id", "path", stays_inside_root("path").alias("safe"))


@register("scan_docs", f"WITH {SCANNED} SELECT repo, path, octet_length(encode(content)) AS n_bytes FROM scanned")
def q_scan_docs(spark, sf):
    return _scanned(spark, sf).select("repo", "path", F.octet_length("content").alias("n_bytes"))


@register(
    "mapping_pairs",
    f"WITH {PAIRS} SELECT repo, mapping_id, code_prefix, doc_path FROM pairs",
)
def q_mapping_pairs(spark, sf):
    return _pairs(spark, sf)


@register("match_prefixes", f"WITH {CHANGED}, {MATCHED} SELECT repo, mapping_id FROM hit")
def q_match_prefixes(spark, sf):
    return M.match_prefixes(_go_changed(spark, sf), _pairs(spark, sf))


@register("mapped_docs", f"WITH {CHANGED}, {MATCHED} SELECT repo, doc_path FROM mapped")
def q_mapped_docs(spark, sf):
    return M.mapped_docs(_go_changed(spark, sf), _pairs(spark, sf))


@register("select_docs", f"WITH {SELECTED} SELECT repo, path, octet_length(encode(content)) AS n_bytes FROM selected")
def q_select_docs(spark, sf):
    return _selected_sizes(spark, sf).select("repo", "path", "n_bytes")


@register(
    "token_estimate",
    f"""WITH {BOTH_ESTIMATES} SELECT repo, n_docs, total_bytes, est_tokens, n_selected, selected_bytes, selected_tokens FROM both_est""",
)
def q_token_estimate(spark, sf):
    return _estimates(spark, sf, M.token_estimate)


@register(
    "budget_gate",
    f"""WITH {BOTH_ESTIMATES} SELECT repo, n_docs, total_bytes, est_tokens, est_tokens <= 50000 AS within_budget,
        n_selected, selected_bytes, selected_tokens, selected_tokens <= 50000 AS selected_within_budget FROM both_est""",
)
def q_budget_gate(spark, sf):
    return _estimates(spark, sf, lambda docs: M.budget_gate(M.token_estimate(docs)))


@register(
    "docs_within_budget",
    f"""WITH {ESTIMATE} SELECT s.repo, path, n_bytes FROM sized s JOIN est e ON s.repo = e.repo WHERE est_tokens <= 150000""",
)
def q_docs_within_budget(spark, sf):
    return M.docs_within_budget(_sizes(spark, sf), 150_000)


@register(
    "budget_cut",
    f"""WITH {ESTIMATE}, placed AS (
      SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY repo ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before
      FROM sized)
    SELECT repo, path, n_bytes, CAST(bytes_before AS BIGINT) AS bytes_before, (bytes_before + n_bytes) // 4 <= 50000 AS fits FROM placed""",
)
def q_budget_cut(spark, sf):
    return M.budget_cut(_sizes(spark, sf))


def _stored_versions(spark, sf):
    """Both versions of the files in a new store, the later one written twice
    (as after a failure)."""
    store = f"{checkpoint_dir(spark)}/docdrift-texts-{uuid.uuid4().hex}"
    for ref, side in (("base", "old"), ("head", "new"), ("head", "new")):
        TS.put_version(B.code_snapshot(spark, sf, side, spread=False), store, ref)
    return store


@register(
    "stored_changes",
    f"""WITH {CHANGED} SELECT repo, path, md5(coalesce(regexp_replace(oc, '\\n+$', ''), '')) AS old_md5,
        md5(coalesce(nc, '')) AS new_md5 FROM changed""",
)
def q_stored_changes(spark, sf):
    changes = TS.stored_changes(spark, _stored_versions(spark, sf), "base", "head")
    return changes.select("repo", "path", F.md5("old_content").alias("old_md5"), F.md5("new_content").alias("new_md5"))


@register(
    "stored_texts",
    f"""WITH so AS ({SNAP_OLD}), sn AS ({SNAP_NEW}), t AS (
      SELECT DISTINCT 'base' AS brought, content FROM so
      UNION ALL SELECT DISTINCT 'head', content FROM sn WHERE NOT EXISTS (SELECT 1 FROM so WHERE so.content = sn.content))
    SELECT brought, count(*) AS n_texts, sum(octet_length(encode(content))) AS n_bytes FROM t GROUP BY brought""",
)
def q_stored_texts(spark, sf):
    """What each version added to the store: texts that no version had."""
    texts = spark.read.schema(TS.TEXTS).parquet(f"{_stored_versions(spark, sf)}/texts")
    return texts.groupBy("brought").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.octet_length("content")).alias("n_bytes"))
