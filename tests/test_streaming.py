"""Snapshots arriving over time are diffed batch by batch."""

import os
import tempfile

import pytest

from docdrift.streaming import snapshots as ST

SCHEMA = "repo string, ref string, path string, version long, deleted boolean, content string"


def _folders(*names):
    root = tempfile.mkdtemp(prefix="docdrift-stream-")
    return [f"{root}/{x}" for x in names]


def _diffs(spark, out, batch=None):
    rows = spark.read.parquet(out)
    rows = rows if batch is None else rows.filter(f"batch_id = {batch}")
    return sorted((r["repo"], r["name"], r["old_name"], r["change"]) for r in rows.collect())


def test_stream_versions_and_deletion(spark):
    src, store, out, ck = _folders("src", "store", "out", "ck")

    def arrive(*rows):
        spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(src)
        ST.start(spark, src, store, out, ck).awaitTermination()

    arrive(
        ("r", "v1", "a.go", 1, False, "package p\n\nfunc Keep() {}\n\nfunc Old() {}\n"),
        ("q", "v1", "b.go", 1, None, "package q\n\nfunc Other() {}\n"),
    )
    assert _diffs(spark, out) == [("q", "Other", "", "added"), ("r", "Keep", "", "added"), ("r", "Old", "", "added")]
    # two versions of one file in one batch: the last one counts
    arrive(
        ("r", "v3", "a.go", 3, False, "package p\n\nfunc Keep(a int) {}\n\nfunc New() {}\n"),
        ("r", "v2", "a.go", 2, False, "package p\n\nfunc Between() {}\n"),
    )
    assert _diffs(spark, out, 1) == [("r", "Keep", "", "modified"), ("r", "New", "Old", "renamed")]
    kept = spark.read.parquet(out).filter("batch_id = 1 AND change = 'modified'").first()
    assert [c["aspect"] for c in kept["changes"]]  # sub-changes are stored
    # a deletion, and a version older than the stored one
    arrive(("q", "v4", "b.go", 4, True, None), ("r", "v0", "a.go", 0, False, "package p\n"))
    assert _diffs(spark, out, 2) == [("q", "Other", "", "removed")]
    now = {(r["path"], r["ref"], r["deleted"]) for r in ST.current_versions(spark, store).collect()}
    assert now == {("a.go", "v3", False), ("b.go", "v4", True)}


def test_replay_after_a_half_written_batch(spark):
    store, out = _folders("store", "out")
    one = spark.createDataFrame([("r", "v1", "a.go", 1, False, "package p\n\nfunc A() {}\n")], SCHEMA)
    two = spark.createDataFrame([("r", "v2", "a.go", 2, False, "package p\n\nfunc A(x int) {}\n")], SCHEMA)
    ST.diff_batch(one, 0, store, out)
    ST.diff_batch(two, 1, store, out)
    first = _diffs(spark, out)
    ST.diff_batch(two, 1, store, out)  # the store already has the batch
    assert _diffs(spark, out) == first == [("r", "A", "", "added"), ("r", "A", "", "modified")]
    assert spark.read.parquet(store).count() == 2


def test_unreadable_store_fails_the_batch(spark):
    store, out = _folders("store", "out")
    os.makedirs(f"{store}/batch_id=0")
    with open(f"{store}/batch_id=0/part-0.parquet", "w") as f:
        f.write("not a parquet file")
    batch = spark.createDataFrame([("r", "v1", "a.go", 1, False, "package p\n")], SCHEMA)
    with pytest.raises(Exception):
        ST.diff_batch(batch, 1, store, out)
    assert not os.path.exists(out)
