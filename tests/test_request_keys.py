"""Requests meet their summaries' keys without gathering a repository."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from __spark_entry__ import queries
from docdrift.operators import requests as RQ


@contextmanager
def settings(spark, **values):
    values = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_large_repository_is_split(spark):
    sized = {"adaptive__advisoryPartitionSizeInBytes": "64k", "adaptive__skewJoin__skewedPartitionThresholdInBytes": "64k"}
    with settings(spark, autoBroadcastJoinThreshold="-1", adaptive__skewJoin__skewedPartitionFactor="1.5", **sized):
        repo = F.when(F.col("id") % 20 == 0, F.concat(F.lit("r"), F.col("id") % 500)).otherwise("large")
        docs = spark.range(0, 20_000, 1, 16).select(repo.alias("repo"), F.col("id").cast("string").alias("path"), F.expr("uuid()").alias("content"))
        summaries = docs.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("path")), "\n").alias("summary"))
        r = RQ.build_requests(docs, summaries, model="m")
        rows = r.select(F.spark_partition_id().alias("task"), F.md5(F.to_json("request")).alias("h"))
        tasks = rows.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.max("h")).collect()
    assert sum(t["n"] for t in tasks) == 20_000
    assert max(t["n"] for t in tasks) < 10_000


def test_few_keys_move_no_documents(spark):
    with settings(spark, autoBroadcastJoinThreshold="20k"):
        plan = queries()["request_json"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning(repo" not in plan
