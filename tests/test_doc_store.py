"""The document store: merges, replays, failures before the commit, races."""

import os
import tempfile

import pytest

from docdrift.sources import doc_store as S

from collected import rows

DOCS = [(f"r{k % 3}", f"docs/{k}.md", f"text {k}\n") for k in range(60)]


@pytest.fixture
def store(spark):
    path = tempfile.mkdtemp(prefix="docdrift-store-", dir="/tmp") + "/docs"
    S.create_docs(spark.createDataFrame(DOCS, S.DOC), path, buckets=8)
    return path


def updates(spark, *items):
    return spark.createDataFrame([(r, p, c, "written") for r, p, c in items], S.DOC + ", outcome string")


def test_a_merge_keeps_what_it_does_not_name(spark, store):
    first = updates(spark, ("r0", "docs/0.md", "new 0\n"), ("r1", "docs/1.md", "new 1\n"), ("r9", "docs/new.md", "not there"))
    assert S.merge_docs(first, store, "run-1") == 1
    blocked = spark.createDataFrame([("r2", "docs/2.md", "never", "blocked")], S.DOC + ", outcome string")
    second = updates(spark, ("r0", "docs/3.md", "new 3\n"), ("r0", "docs/0.md", None)).unionByName(blocked)
    assert S.merge_docs(second, store, "run-2") == 2
    want = {(r, p): c for r, p, c in DOCS}
    assert rows(S.read_docs(spark, store, 0)) == sorted(DOCS)
    want |= {("r0", "docs/0.md"): "new 0\n", ("r1", "docs/1.md"): "new 1\n"}
    assert {(r, p): c for r, p, c in rows(S.read_docs(spark, store, 1))} == want
    want |= {("r0", "docs/3.md"): "new 3\n"}
    assert {(r, p): c for r, p, c in rows(S.read_docs(spark, store))} == want and len(want) == 60


def test_only_touched_buckets_are_rewritten(spark, store):
    S.merge_docs(updates(spark, ("r0", "docs/0.md", "x")), store, "run-1")
    folders = [{r["bucket"]: r["folder"] for r in S._manifest(spark, store, v).collect()} for v in (0, 1)]
    assert sum(folders[0][b] != folders[1][b] for b in folders[0]) == 1


def test_a_replay_changes_nothing(spark, store):
    S.merge_docs(updates(spark, ("r0", "docs/0.md", "one")), store, "run-1")
    S.merge_docs(updates(spark, ("r0", "docs/0.md", "two")), store, "run-2")
    assert S.merge_docs(updates(spark, ("r0", "docs/0.md", "one")), store, "run-1") == 1
    assert ("r0", "docs/0.md", "two") in rows(S.read_docs(spark, store)) and S._versions(spark, store) == [0, 1, 2]
    # the run that made the store is version 0
    assert S.merge_docs(updates(spark, ("r0", "docs/0.md", "three")), store, "create") == 0 and S._versions(spark, store) == [0, 1, 2]


def test_a_run_that_dies_before_the_commit(spark, store, monkeypatch):
    def dies(*_):
        raise RuntimeError("killed")

    change = updates(spark, ("r0", "docs/0.md", "after"), ("r1", "docs/4.md", "after"))
    with monkeypatch.context() as m:
        m.setattr(S, "_commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            S.merge_docs(change, store, "run-1")
    assert len(os.listdir(f"{store}/data")) == 2  # the data was written, no manifest names it
    assert S._versions(spark, store) == [0] and rows(S.read_docs(spark, store)) == sorted(DOCS)
    assert S.merge_docs(change, store, "run-1") == 1
    assert {c for _, _, c in rows(S.read_docs(spark, store)) if c == "after"} and S.read_docs(spark, store).count() == 60


def test_the_next_version_is_taken_once(spark, store, monkeypatch):
    commit = S._commit

    def late(manifest, path, version):
        monkeypatch.setattr(S, "_commit", commit)
        S.merge_docs(updates(spark, ("r0", "docs/3.md", "other run")), path, "run-b")
        commit(manifest, path, version)

    monkeypatch.setattr(S, "_commit", late)
    with pytest.raises(S.NextVersionTaken):
        S.merge_docs(updates(spark, ("r0", "docs/0.md", "mine")), store, "run-a")
    assert S.merge_docs(updates(spark, ("r0", "docs/0.md", "mine")), store, "run-a") == 2
    got = {(r, p): c for r, p, c in rows(S.read_docs(spark, store))}
    assert got["r0", "docs/0.md"] == "mine" and got["r0", "docs/3.md"] == "other run"


def test_stores_and_updates_without_rows(spark):
    path = tempfile.mkdtemp(prefix="docdrift-store-", dir="/tmp") + "/docs"
    S.create_docs(spark.createDataFrame([], S.DOC), path)
    assert S.merge_docs(updates(spark, ("r", "p", "c")), path, "run-1") == 1
    assert S.merge_docs(spark.createDataFrame([], S.DOC), path, "run-2") == 2
    assert S.read_docs(spark, path).collect() == []


def test_buckets_follow_the_size(spark):
    path = tempfile.mkdtemp(prefix="docdrift-store-", dir="/tmp") + "/docs"
    docs = spark.createDataFrame(DOCS, S.DOC)
    S.create_docs(docs.unionByName(docs), path)
    assert S._manifest(spark, path, 0).first()["buckets"] == 1 and rows(S.read_docs(spark, path)) == sorted(DOCS)
