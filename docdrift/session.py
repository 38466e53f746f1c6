"""Session helpers: a session for tests and the benchmark, the shared folder
for stored intermediate tables, and shipping the package to Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "docdrift") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOCDRIFT_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_scratch(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    The deployment names it (storage that the driver and all executors share);
    the library only reads it and raises when it is unset, because a
    machine-local folder loses data on a cluster."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return d.rstrip("/")


def use_local_scratch(spark: SparkSession) -> None:
    """Name a scratch folder where ``spark.checkpoint.dir`` is unset and the
    session is one machine (``local[...]``), as in tests; a cluster's setting
    is never replaced, and a cluster without one is left to raise."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None):
        return
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docdrift-ckpt-"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per session, so that
    functions applied to rows can be imported there."""
    sc = spark.sparkContext
    if getattr(sc, "_docdrift_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="docdrift-pkg-")
    archive = shutil.make_archive(os.path.join(folder, "docdrift"), "zip", os.path.dirname(root), "docdrift")
    sc.addPyFile(archive)
    sc._docdrift_shipped = True


def cut_lineage(df):
    """Write ``df`` as Parquet to the shared checkpoint folder and continue
    from the stored copy (survives lost executors; never a local checkpoint).
    Used where a result feeds several consumers.

    Written once as a table (an RDD checkpoint would compute the data twice,
    once for the action and once for the checkpoint file), and read back with
    statistics for the optimizer. The files belong to the caller's run: the
    deployment clears the folder when the run is over."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/docdrift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
