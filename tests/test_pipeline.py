"""The whole run on a tiny two-repository corpus with a local completer."""

import json
import re
import sys
import tempfile

from pyspark import cloudpickle

from docdrift.plans import pipeline as P

# the completers below run in Python workers, which cannot import this test
# module: ship them by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def completer(request: str) -> str:
    req = json.loads(request)
    user = req["messages"][1]["content"]
    path = re.search(r'<DOCUMENT path="([^"]*)">', user).group(1)
    edits = {"edits": [{"file": path, "action": "replace", "old_text": "Old()", "new_text": "New()"}]}
    return json.dumps({"choices": [{"message": {"role": "assistant", "content": json.dumps(edits)}, "finish_reason": "stop"}]})


def test_plan_and_finish(spark):
    snap = "repo string, ref string, path string, content string"
    old = spark.createDataFrame(
        [("r1", "a", "x.go", "package p\n\nfunc Old() {}\n"), ("r2", "a", "y.go", "package q\n\nfunc Same() {}\n")], snap
    )
    new = spark.createDataFrame(
        [("r1", "b", "x.go", "package p\n\nfunc New() {}\n\nfunc Added() int { return 1 }\n"), ("r2", "b", "y.go", "package q\n\nfunc Same() {}\n")],
        snap,
    )
    from docdrift.sources.snapshots import with_hash

    docs = spark.createDataFrame(
        [("r1", "docs/a.md", "Call Old() first.\n"), ("r1", "docs/b.md", "Unrelated.\n"), ("r2", "docs/c.md", "Same() works.\n")],
        "repo string, path string, content string",
    )
    roots = spark.createDataFrame([("r1", "docs"), ("r2", "docs")], "repo string, root string")
    plan = P.plan_updates(with_hash(old), with_hash(new), docs, roots, model="m")
    diffs = {(r["repo"], r["name"], r["change"]) for r in plan["diffs"].collect()}
    assert diffs == {("r1", "New", "renamed"), ("r1", "Added", "added")}
    reqs = plan["requests"].collect()
    # r2 has no API change, so it gets no requests; r1 gets one per document
    assert sorted(r["path"] for r in reqs) == ["docs/a.md", "docs/b.md"]

    # no text of a document is read or dealt out before the requests are built
    for name in ("selected", "budget"):
        assert "content" not in plan[name]._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["path"], r["n_bytes"]) for r in plan["selected"].collect()) == [("docs/a.md", 18), ("docs/b.md", 11), ("docs/c.md", 14)]

    store = tempfile.mkdtemp(prefix="docdrift-replies-", dir="/tmp") + "/replies"
    replies = P.complete(plan["requests"], plan["summary"], completer, store)
    assert replies.count() == 2
    # a second run finds the stored replies and calls nothing again: a
    # completer that always fails would leave error rows if it were called
    def failing(_request):
        raise RuntimeError("must not be called")

    again = P.complete(plan["requests"], plan["summary"], failing, store)
    assert again.count() == 2
    assert all(r["error"] is None for r in again.collect())

    done = P.finish_updates(replies.select("repo", "path", "body"), docs)
    ready = {r["path"]: (r["outcome"], r["content"]) for r in done["ready"].collect()}
    assert ready == {"docs/a.md": ("written", "Call New() first.\n")}
    skipped = {(r["path"], r["error"]) for r in done["skipped"].collect()}
    assert skipped == {("docs/b.md", "not_found")}

    # the result goes into the document store, where the other documents stay
    from docdrift.sources import doc_store as DS

    path = tempfile.mkdtemp(prefix="docdrift-store-", dir="/tmp") + "/docs"
    DS.create_docs(docs, path)
    assert P.apply_updates(done["ready"], path, "run-1") == P.apply_updates(done["ready"], path, "run-1") == 1
    assert {r["path"]: r["content"] for r in DS.read_docs(spark, path).collect()} == {
        "docs/a.md": "Call New() first.\n", "docs/b.md": "Unrelated.\n", "docs/c.md": "Same() works.\n",
    }


def test_plan_from_stored_versions(spark):
    """Two versions of the store give the plan of the two snapshots."""
    from docdrift.sources import snapshots as SS
    from docdrift.sources import text_store as TS

    snap = "repo string, path string, content string"
    same = [("r1", f"lib/{k}.go", f"package p\n\nfunc Keep{k}() {{}}\n") for k in range(40)]
    old = spark.createDataFrame(same + [("r1", "x.go", "package p\n\nfunc Old() {}\n"), ("r2", "y.txt", "a\n")], snap)
    new = spark.createDataFrame(same + [("r1", "x.go", "package p\n\nfunc New() {}\n"), ("r2", "y.txt", "b\n")], snap)
    docs = spark.createDataFrame([("r1", "docs/a.md", "Call Old().\n"), ("r2", "docs/b.md", "Text.\n")], "repo string, path string, content string")
    roots = spark.createDataFrame([("r1", "docs"), ("r2", "docs")], "repo string, root string")
    mappings = spark.createDataFrame(
        [("r1", 1, ["docs/a.md"], ["x"])], "repo string, mapping_id long, docs array<string>, code array<string>"
    )
    store = tempfile.mkdtemp(prefix="docdrift-texts-", dir="/tmp") + "/store"
    TS.put_version(old, store, "a")
    TS.put_version(new, store, "b")
    stored = P.plan_version_updates(spark, store, "a", "b", docs, roots, mappings=mappings, model="m")
    plain = P.plan_updates(SS.with_hash(old), SS.with_hash(new), docs, roots, mappings, model="m")
    assert [(r["repo"], r["path"]) for r in stored["changed_files"].collect()] == [("r1", "x.go")]
    for name in ("changed_files", "diffs", "summary", "selected", "budget", "requests", "extract_errors"):
        assert sorted(map(repr, stored[name].collect())) == sorted(map(repr, plain[name].collect())), name
    assert [r["path"] for r in stored["requests"].collect()] == ["docs/a.md"]
    assert P.plan_version_updates(spark, store, "b", "b", docs, roots)["requests"].collect() == []
