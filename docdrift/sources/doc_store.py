"""The document table as a keyed store (S6): merge a run's results, keep the rest.

A store holds one row per ``(repo, path)``. Its rows lie in buckets by a hash
of the key; a version's manifest names, for every bucket, the folder with its
rows. A merge rewrites the buckets that hold updated documents, carries the
others over by naming their old folders, and becomes visible by one rename of
its manifest to the next version number. Before that, nothing refers to what it
wrote; a run that dies there leaves the old version as it was, and repeating it
writes to folders of its own. A run that has been committed is not applied
again. Two runs that start from one version cannot both take the next number.

The renames need a file system that renames atomically and refuses an existing
target (HDFS and local file systems do). Folders that no manifest names are
left for the deployment to clear.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["repo", "path"]
DOC = "repo string, path string, content string"
MANIFEST = "version long, run string, bucket int, buckets int, folder string"
#: Bytes of content in a bucket, roughly: what one task rewrites.
BUCKET_BYTES = 256 << 20


class NextVersionTaken(RuntimeError):
    """Another run committed the version that this one was to become; merge
    again on top of it."""


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int")


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, at


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the committed versions, ascending."""
    _, conf, at = _hadoop(spark, f"{store}/manifest")
    fs = at.getFileSystem(conf)
    if not fs.exists(at):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(at))
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def _manifest(spark: SparkSession, store: str, version: int) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{store}/manifest/v{version}")


def _commit(manifest: DataFrame, store: str, version: int) -> None:
    """Write a manifest aside and rename it to its number: the commit."""
    spark = manifest.sparkSession
    aside = f"{store}/manifest/.new-{uuid.uuid4().hex}"
    manifest.coalesce(1).write.json(aside)
    jvm, conf, source = _hadoop(spark, aside)
    target = jvm.org.apache.hadoop.fs.Path(f"{store}/manifest/v{version}")
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.getFileSystem(conf).makeQualified(source).toUri(), conf)
    never_over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(source, target, never_over)
    except Exception as exc:
        if version in _versions(spark, store):
            raise NextVersionTaken(f"version {version} of {store}") from exc
        raise


def _written(rows: DataFrame, store: str, buckets: int) -> str:
    """Store rows by bucket in a folder of their own; its name."""
    folder = f"data/{uuid.uuid4().hex}"
    placed = rows.select(*KEYS, "content", _bucket(buckets).alias("bucket"))
    placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{store}/{folder}")
    return folder


def _held(spark: SparkSession, store: str, folder: str) -> DataFrame:
    """``bucket`` of the buckets that a folder has rows of."""
    return spark.read.schema(DOC + ", bucket int").parquet(f"{store}/{folder}").select("bucket").distinct()


def create_docs(docs: DataFrame, store: str, run: str = "create", buckets: int | None = None) -> int:
    """Version 0 of a new store from ``docs(repo, path, content)``; of several
    rows for a key the greatest text counts. The number of buckets is fixed
    here, by default from the size of the texts."""
    spark = docs.sparkSession
    if buckets is None:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("s")).first()["s"]
        buckets = max(1, -(-size // BUCKET_BYTES))
    folder = _written(docs.groupBy(*KEYS).agg(F.max("content").alias("content")), store, buckets)
    rows = _held(spark, store, folder).select(
        F.lit(0).cast("long").alias("version"), F.lit(run).alias("run"), "bucket", F.lit(buckets).alias("buckets"), F.lit(folder).alias("folder")
    )
    # a store without documents still has a version, and a number of buckets
    none = spark.range(1).select(
        F.lit(0).cast("long"), F.lit(run), F.lit(-1), F.lit(buckets), F.lit(None).cast("string")
    ).toDF("version", "run", "bucket", "buckets", "folder")
    _commit(rows.unionByName(none), store, 0)
    return 0


def read_docs(spark: SparkSession, store: str, version: int | None = None, only: list[int] | None = None) -> DataFrame:
    """The documents of a version (the latest one by default); with ``only``
    those of the given buckets."""
    if version is None:
        version = _versions(spark, store)[-1]
    held = _manifest(spark, store, version).where("folder IS NOT NULL").select("bucket", "folder").collect()  # one row per bucket
    paths = [f"{store}/{r['folder']}/bucket={r['bucket']}" for r in held if only is None or r["bucket"] in only]
    if not paths:
        return spark.createDataFrame([], DOC)
    return spark.read.schema(DOC).parquet(*sorted(paths))


def merge_docs(updates: DataFrame, store: str, run: str) -> int:
    """S6 (sink): replace the content of the documents named by
    ``updates(repo, path, content)``; all other documents stay. Returns the
    version that holds the result: the next one, or the one that ``run`` has
    already become. Updates of documents that the store does not have are left
    out (no file is created); of several updates for a key the greatest text
    counts; null content leaves a document as it is. With ``outcome`` among the
    columns only ``written`` rows count."""
    spark = updates.sparkSession
    versions = _versions(spark, store)
    done = spark.read.schema(MANIFEST).json([f"{store}/manifest/v{v}" for v in versions]).where(F.col("run") == run)
    if (applied := done.agg(F.min("version").alias("v")).first()["v"]) is not None:
        return applied
    latest = versions[-1]
    held = _manifest(spark, store, latest)
    buckets = held.first()["buckets"]
    if "outcome" in updates.columns:
        updates = updates.where("outcome = 'written'")
    new = updates.where("content IS NOT NULL").groupBy(*KEYS).agg(F.max("content").alias("new"))
    touched = [r["b"] for r in new.select(_bucket(buckets).alias("b")).distinct().collect()]  # at most the buckets
    before = read_docs(spark, store, latest, touched)
    merged = before.join(new, KEYS, "left").select(*KEYS, F.coalesce("new", "content").alias("content"))
    folder = _written(merged, store, buckets) if touched else None
    moved = F.col("bucket").isin(touched) & F.col("folder").isNotNull() if touched else F.lit(False)
    rows = held.select(
        F.lit(latest + 1).cast("long").alias("version"), F.lit(run).alias("run"), "bucket", "buckets",
        F.when(moved, F.lit(folder)).otherwise(F.col("folder")).alias("folder"),
    )
    _commit(rows, store, latest + 1)
    return latest + 1
