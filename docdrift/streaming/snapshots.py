"""Incremental diffs as snapshots arrive (Structured Streaming).

New file versions land as Parquet rows ``(repo, ref, path, version, deleted,
content)`` in a source folder; ``version`` orders the versions of a file and a
``deleted`` row ends it. The store is a log: a micro-batch writes the files it
changed into its own ``batch_id`` partition and leaves all others alone, and
the current version of a file is its latest row. A batch is compared with the
rows of earlier batches only, and both its store partition and its diff
partition are overwritten as a whole, so a replayed batch (even after one of
the two writes was lost half way) gives the same rows again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changes as C
from ..operators import diff as D
from ..operators import mining as MI
from ..session import cut_lineage
from ..sources import snapshots as SS

ARRIVING = T.StructType(
    [
        T.StructField("repo", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("content", T.StringType()),
    ]
)


#: One row of the store: a file's state after a batch.
STORED = "repo string, path string, ref string, version long, deleted boolean, content string, content_hash string, batch_id long"
_STATE = ["ref", "version", "deleted", "content", "content_hash"]


def _latest(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each file; null versions come first, and of rows that
    tie the one with the larger state stays."""
    last = F.max_by(F.struct(*_STATE), F.struct(*order, "version", "deleted", "content_hash", "ref"))
    return rows.groupBy("repo", "path").agg(last.alias("s")).select("repo", "path", "s.*")


def current_versions(spark: SparkSession, store: str, before_batch: int | None = None) -> DataFrame:
    """The latest stored state of each file, deleted ones included; of batches
    below ``before_batch`` if given. Only a store that does not exist yet is
    empty: any other failure to read it is raised."""
    try:
        rows = spark.read.schema(STORED).parquet(store)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORED)
    if before_batch is not None:
        rows = rows.filter(F.col("batch_id") < before_batch)
    return _latest(rows, "batch_id")


def diff_batch(batch: DataFrame, batch_id: int, store: str, out: str, suffix: str = ".go") -> None:
    """One micro-batch: store its files' last versions, then write the diff
    against the versions of earlier batches. A version older than the stored
    one is passed over; of several versions in the batch the last counts."""
    spark = batch.sparkSession
    arrived = SS.with_hash(SS.filter_source_files(batch, suffix)).withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    last = _latest(arrived)
    known = current_versions(spark, store, batch_id)
    was = known.select("repo", "path", F.struct(*_STATE).alias("was"))
    fresh = last.join(was, ["repo", "path"], "left").filter(
        F.col("was.version").isNull() | F.col("version").isNull() | (F.col("version") >= F.col("was.version"))
    )
    fresh = cut_lineage(fresh)  # read by both writes
    _overwrite(fresh.select("repo", "path", *_STATE, F.lit(batch_id).cast("long").alias("batch_id")), store)
    new = fresh.filter(~F.col("deleted")).select("repo", "path", "content", "content_hash")
    old = fresh.filter(~F.col("was.deleted")).select("repo", "path", "was.content", "was.content_hash")
    files = C.changed_files(old, new)
    o = MI.mine_declarations(files.select("repo", "path", F.col("old_content").alias("content"))).drop("exported")
    n = MI.mine_declarations(files.select("repo", "path", F.col("new_content").alias("content"))).drop("exported")
    diffs = D.symbol_diff(o, n).drop("shape").withColumn("batch_id", F.lit(batch_id).cast("long"))
    _overwrite(diffs, out)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replace the rows' own ``batch_id`` partition of a table."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def start(
    spark: SparkSession,
    source: str,
    store: str,
    out: str,
    checkpoint_location: str,
    available_now: bool = True,
):
    """Start the stream; with ``available_now`` it processes what is there
    and stops (for scheduled runs and tests)."""
    stream = spark.readStream.schema(ARRIVING).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda df, bid: diff_batch(df, bid, store, out)).option(
        "checkpointLocation", checkpoint_location
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
