"""Versioned file sources (S1, C4) and the snapshot table layout.

A snapshot table has one row per ``(repo, ref, path)`` with the file text and
its SHA-256. Stored as Parquet partitioned by ``repo, ref``, a scan for one
version prunes partitions and a scan for hashes never reads ``content``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_texts

SNAPSHOT_COLS = ["repo", "ref", "path", "content", "content_hash"]


def with_hash(df: DataFrame) -> DataFrame:
    """Add ``content_hash`` (hex SHA-256 of the UTF-8 text)."""
    return df.withColumn("content_hash", F.sha2(F.col("content"), 256))


def read_snapshot_files(
    spark: SparkSession,
    root: str,
    repo: str,
    ref: str,
    suffix: str = ".go",
) -> DataFrame:
    """S1 for files on (shared) storage: one row per file below ``root``, its
    path relative to ``root``."""
    files = read_texts(spark, root, suffix)
    return with_hash(
        files.select(F.lit(repo).alias("repo"), F.lit(ref).alias("ref"), "path", "content")
    ).select(*SNAPSHOT_COLS)


def read_snapshot_table(spark: SparkSession, path: str, ref: str | None = None) -> DataFrame:
    """S1 for a Parquet snapshot table partitioned by ``repo, ref``."""
    df = spark.read.parquet(path)
    if ref is not None:
        df = df.filter(F.col("ref") == ref)
    return df


def write_snapshot_table(df: DataFrame, path: str) -> None:
    """Write snapshots partitioned by ``repo, ref`` (dynamic overwrite). Rows
    are dealt out by ranges of ``(repo, ref, path)``, so a large version is
    written by many tasks and a small one by few."""
    (
        with_hash(df.drop("content_hash")).select(*SNAPSHOT_COLS)
        .repartitionByRange("repo", "ref", "path")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo", "ref")
        .parquet(path)
    )


def filter_source_files(df: DataFrame, suffix: str = ".go") -> DataFrame:
    """C4: keep paths ending with ``suffix`` (test and vendored files stay)."""
    return df.filter(F.col("path").endswith(suffix))
