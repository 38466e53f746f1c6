"""Document source (S2) and configuration tables (S3).

``scan_docs`` keeps Markdown files under the configured roots, drops
excluded paths and keeps one row per ``(repo, path)``. Roots and excludes are
tables (one row per configured entry), joined by equality or prefix, never
collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_texts


def read_doc_files(spark: SparkSession, root: str, repo: str, suffix: str = ".md") -> DataFrame:
    """Read Markdown files below ``root`` as ``repo, path, content``."""
    return read_texts(spark, root, suffix).select(F.lit(repo).alias("repo"), "path", "content")


def _norm_root(c):
    # 'docs/', './docs' -> 'docs'; '.' and '' -> '' (the repository root)
    c = F.regexp_replace(F.regexp_replace(c, "/+$", ""), "^(\\./)+", "")
    return F.when(c == ".", F.lit("")).otherwise(c)


def ancestors(dir_col) -> "F.Column":
    """``'a/b/c'`` -> ``['', 'a', 'a/b', 'a/b/c']``; ``''`` -> ``['']``."""
    parts = F.split(dir_col, "/")
    chain = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return F.when(dir_col == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), chain))


def scan_docs(
    docs: DataFrame,
    roots: DataFrame,
    excludes: DataFrame | None = None,
    suffix: str = ".md",
) -> DataFrame:
    """``docs(repo, path, content)`` restricted to paths ending with
    ``suffix`` that equal a configured root or sit below one
    (``roots(repo, root)``), minus ``excludes(repo, path)``. ``docs`` holds
    one row per ``(repo, path)`` (as a file listing does); so does the
    result. Roots that match nothing are skipped silently.

    Prefix tests become equi-joins: the distinct parent directories of the
    documents (far fewer than documents, de-duplicated map-side) are
    expanded to their ancestors and joined with the roots; documents are
    then kept by an equi-join on their parent directory, or on their own
    path for file roots.
    """
    # the selection runs on keys only; texts join back once at the end
    d = docs.select("repo", "path").filter(F.col("path").endswith(suffix)).withColumn(
        "_dir", F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "^$", "")
    )
    r = roots.select("repo", _norm_root(F.col("root")).alias("_root")).distinct()
    dirs = d.select("repo", "_dir").distinct()
    covered = (
        dirs.select("repo", "_dir", F.explode(ancestors(F.col("_dir"))).alias("_root"))
        .join(r, ["repo", "_root"])
        .select("repo", "_dir")
        .distinct()
        .withColumn("_by_dir", F.lit(True))
    )
    files = r.select("repo", F.col("_root").alias("path"), F.lit(True).alias("_by_file"))
    kept = (
        d.join(covered, ["repo", "_dir"], "left")
        .join(files, ["repo", "path"], "left")
        .filter(F.col("_by_dir").isNotNull() | F.col("_by_file").isNotNull())
        .select("repo", "path")
    )
    if excludes is not None:
        kept = kept.join(excludes.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    # one row per (repo, path) in, one out: the key joins above are to
    # de-duplicated tables, and the texts are fetched by a semi join, so no
    # document is repeated however many roots cover it and each text is
    # shuffled once
    return docs.join(kept, ["repo", "path"], "left_semi")


def mapping_pairs(mappings: DataFrame) -> DataFrame:
    """S3: ``mappings(repo, mapping_id, docs[], code[])`` ->
    ``repo, mapping_id, code_prefix, doc_path`` (one row per pair)."""
    return mappings.select(
        "repo", "mapping_id", F.explode("code").alias("code_prefix"), "docs"
    ).select("repo", "mapping_id", "code_prefix", F.explode("docs").alias("doc_path"))
