"""Content-addressed snapshots (S1): texts stored once, versions as hashes.

A version is rows of ``(repo, path, content_hash, n_bytes, brought)``; a text
is stored once, under the version that brought it first (``brought``, the
partition column of the texts). Comparing versions reads hashes only, and the
texts of changed files are read from the partitions that hold them.

A version is written as a whole under its ``ref``: texts first, then its rows,
so rows never name a text that is not there. A write that died is repeated and
replaces what it left; a version that has its rows is not written again, as
later versions may name its texts. Versions of one store are written one after
the other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import KEYS, changed_paths, normalise_content
from ..session import cut_lineage
from .snapshots import filter_source_files

TEXTS = "content_hash string, content string, brought string"
VERSIONS = "repo string, path string, content_hash string, n_bytes long, brought string, ref string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored rows; none where nothing was stored yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def _write(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def put_version(snapshot: DataFrame, store: str, ref: str) -> None:
    """Store the files ``snapshot(repo, path, content)`` as version ``ref``.
    Only texts that no other version has brought are written. Rows without a
    path and null contents are left out; a path given twice counts once, with
    the greatest hash. A version without files has no rows."""
    spark = snapshot.sparkSession
    if not read_version(spark, store, ref).isEmpty():
        return
    files = snapshot.filter((F.col("path") != "") & F.col("content").isNotNull()).select(
        *KEYS, "content", F.sha2("content", 256).alias("content_hash")
    )
    known = _read(spark, f"{store}/texts", TEXTS).filter(F.col("brought") != ref).select("content_hash", "brought")
    size = F.octet_length("content").cast("long")
    keys = files.groupBy(*KEYS).agg(F.max(F.struct("content_hash", size.alias("n_bytes"))).alias("f")).select(*KEYS, "f.*")
    rows = cut_lineage(
        keys.join(known, "content_hash", "left").select(
            *KEYS, "content_hash", "n_bytes", F.coalesce("brought", F.lit(ref)).alias("brought"), F.lit(ref).alias("ref")
        )
    )
    wanted = rows.filter(F.col("brought") == ref).select("content_hash").distinct()
    new = files.select("content_hash", "content").join(wanted, "content_hash", "left_semi").dropDuplicates(["content_hash"])
    _write(new.select("content_hash", "content", F.lit(ref).alias("brought")), f"{store}/texts", "brought")
    _write(rows, f"{store}/versions", "ref")


def read_version(spark: SparkSession, store: str, ref: str) -> DataFrame:
    """``repo, path, content_hash, n_bytes, brought`` of a version; no text is
    opened."""
    return _read(spark, f"{store}/versions", VERSIONS).filter(F.col("ref") == ref).drop("ref")


def fetch_texts(rows: DataFrame, store: str) -> DataFrame:
    """``rows`` with their ``content``, from the partitions that hold it."""
    texts = _read(rows.sparkSession, f"{store}/texts", TEXTS)
    return rows.join(texts, ["brought", "content_hash"])


def version_changes(spark: SparkSession, store: str, old_ref: str, new_ref: str, suffix: str = "") -> DataFrame:
    """C1 over stored versions: ``repo, path, change`` of the paths that end
    with ``suffix``, by hashes alone."""
    old, new = (filter_source_files(read_version(spark, store, ref), suffix) for ref in (old_ref, new_ref))
    return changed_paths(old, new)


def stored_changes(
    spark: SparkSession, store: str, old_ref: str, new_ref: str, trim_old: bool = True, suffix: str = ""
) -> DataFrame:
    """C2 over stored versions: ``repo, path, old_content, new_content`` of the
    changed files; the texts of unchanged files are not fetched."""
    changed = cut_lineage(version_changes(spark, store, old_ref, new_ref, suffix))

    def texts(ref: str, name: str) -> DataFrame:
        rows = read_version(spark, store, ref).join(changed.select(*KEYS), KEYS, "left_semi")
        return fetch_texts(rows, store).select(*KEYS, F.col("content").alias(name))

    out = changed.join(texts(old_ref, "_oc"), KEYS, "left").join(texts(new_ref, "_nc"), KEYS, "left")
    return out.select(
        *KEYS,
        F.coalesce(normalise_content(F.col("_oc"), trim_old), F.lit("")).alias("old_content"),
        F.coalesce("_nc", F.lit("")).alias("new_content"),
    )
