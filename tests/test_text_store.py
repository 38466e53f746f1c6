"""Content-addressed versions: shared texts, replays, reads of hashes only."""

import tempfile

import pytest

from docdrift.operators import changes as C
from docdrift.sources import snapshots as SS
from docdrift.sources import text_store as T

from collected import rows

SNAP = "repo string, path string, content string"
OLD = [(f"r{k % 4}", f"src/{k}.go", f"package p{k % 90}\n\n") for k in range(200)]
NEW = OLD[2:] + [("r0", "src/0.go", "package changed\n"), ("r9", "src/new.go", "package p3\n\n"), ("r9", "", "no path"), ("r9", "null.go", None)]


@pytest.fixture
def store(spark):
    path = tempfile.mkdtemp(prefix="docdrift-texts-", dir="/tmp") + "/store"
    T.put_version(spark.createDataFrame(OLD, SNAP), path, "v1")
    T.put_version(spark.createDataFrame(NEW, SNAP).repartition(5), path, "v2")
    return path


def test_texts_are_stored_once(spark, store):
    texts = spark.read.schema(T.TEXTS).parquet(f"{store}/texts")
    assert {r["brought"]: r["count"] for r in texts.groupBy("brought").count().collect()} == {"v1": 90, "v2": 1}
    for ref, files in (("v1", OLD), ("v2", NEW)):
        expected = sorted(f for f in files if f[1] and f[2] is not None)
        assert rows(T.fetch_texts(T.read_version(spark, store, ref), store), "repo", "path", "content") == expected


def test_changes_are_those_of_the_snapshots(spark, store):
    plain = [SS.with_hash(spark.createDataFrame([f for f in side if f[2] is not None], SNAP)) for side in (OLD, NEW)]
    assert rows(T.version_changes(spark, store, "v1", "v2")) == rows(C.changed_paths(*plain))
    assert rows(T.stored_changes(spark, store, "v1", "v2")) == rows(C.changed_files(*plain))
    assert T.stored_changes(spark, store, "v2", "v2").collect() == []


def test_a_comparison_opens_no_text(spark, store):
    plan = T.version_changes(spark, store, "v1", "v2")._jdf.queryExecution().executedPlan().toString()
    assert "content_hash" in plan and "content#" not in plan and "/texts" not in plan and "sha2" not in plan


def test_a_repeated_write_changes_nothing(spark, store):
    before = [rows(spark.read.schema(s).parquet(f"{store}/{t}")) for t, s in (("texts", T.TEXTS), ("versions", T.VERSIONS))]
    T.put_version(spark.createDataFrame(NEW, SNAP), store, "v2")
    T.put_version(spark.createDataFrame(OLD[:1], SNAP), store, "v1")  # later versions name its texts
    after = [rows(spark.read.schema(s).parquet(f"{store}/{t}")) for t, s in (("texts", T.TEXTS), ("versions", T.VERSIONS))]
    assert before == after


def test_versions_without_files(spark):
    path = tempfile.mkdtemp(prefix="docdrift-texts-", dir="/tmp") + "/store"
    assert T.read_version(spark, path, "v1").collect() == []
    T.put_version(spark.createDataFrame([], SNAP), path, "v1")
    T.put_version(spark.createDataFrame(OLD[:3], SNAP), path, "v2")
    assert {r.old_content for r in T.stored_changes(spark, path, "v1", "v2").collect()} == {""}


def test_a_write_that_died_before_its_rows(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="docdrift-texts-", dir="/tmp") + "/store"
    write = T._write

    def dies(frame, at, by):
        if at.endswith("/versions"):
            raise RuntimeError("killed")
        write(frame, at, by)

    monkeypatch.setattr(T, "_write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        T.put_version(spark.createDataFrame(OLD, SNAP), path, "v1")
    assert T.read_version(spark, path, "v1").collect() == []
    monkeypatch.setattr(T, "_write", write)
    T.put_version(spark.createDataFrame(OLD, SNAP), path, "v1")
    assert rows(T.fetch_texts(T.read_version(spark, path, "v1"), path), "repo", "path", "content") == sorted(OLD)
    assert spark.read.schema(T.TEXTS).parquet(f"{path}/texts").count() == 90
