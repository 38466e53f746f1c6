"""File sources: whole-file reads with the suffix filter pushed into the
listing, paths relative to the root; request JSON sink shape."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from docdrift.operators import requests as RQ
from docdrift.sources import docs as SD
from docdrift.sources import snapshots as SS

from collected import rows


def _tree(files):
    root = tempfile.mkdtemp(prefix="docdrift-src-", dir="/tmp")
    for rel, text in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w", encoding="utf-8") as fh:
            fh.write(text)
    return root


def test_read_snapshot_files(spark):
    root = _tree({"a.go": "package a\n", "pkg/deep/b.go": "package b\n\nfunc B() {}\n", "readme.md": "# x\n", "go.sum": "x"})
    df = SS.read_snapshot_files(spark, root, repo="r", ref="head")
    assert rows(df, "path", "content") == [("a.go", "package a\n"), ("pkg/deep/b.go", "package b\n\nfunc B() {}\n")]
    assert all(len(r["content_hash"]) == 64 for r in df.collect())


def test_read_doc_files(spark):
    root = _tree({"docs/a.md": "# A\n", "docs/sub/b.md": "# B\n", "main.go": "package m\n"})
    df = SD.read_doc_files(spark, root, repo="r")
    assert rows(df, "path") == [("docs/a.md",), ("docs/sub/b.md",)]


def test_paths_are_decoded_and_relative_however_the_root_is_spelt(spark):
    root = _tree({"a b/x y.go": "package a\n", "c+d/%41.go": "package c\n", "é/z.go": "package z\n", "a b/x.md": "# x\n"})
    for spelt in (root, root + "/", "file://" + root, "file:" + root):
        df = SS.read_snapshot_files(spark, spelt, repo="r", ref="head")
        assert rows(df, "path") == [("a b/x y.go",), ("c+d/%41.go",), ("é/z.go",)], spelt
        assert rows(SD.read_doc_files(spark, spelt, repo="r"), "path") == [("a b/x.md",)], spelt


def test_snapshot_table_round_trip(spark):
    path = tempfile.mkdtemp(prefix="docdrift-src-") + "/table"
    df = spark.createDataFrame(
        [("r", "v1", f"f{i}.go", f"package p{i}\n") for i in range(40)] + [("q", "v2", "a.go", "package q\n")],
        "repo string, ref string, path string, content string",
    )
    SS.write_snapshot_table(df, path)
    SS.write_snapshot_table(df.filter("repo = 'q'"), path)  # other partitions stay
    back = SS.read_snapshot_table(spark, path, ref="v1")
    assert back.count() == 40 and SS.read_snapshot_table(spark, path).count() == 41
    assert all(len(r["content_hash"]) == 64 for r in back.collect())


def test_sinks_write_what_was_built(spark):
    from docdrift.operators import validate as V

    root = tempfile.mkdtemp(prefix="docdrift-src-")
    req = spark.createDataFrame([("r", "a.md", "{}", "h1"), ("q", "b.md", "{}", "h2")], "repo string, path string, request_json string, request_hash string")
    RQ.write_requests(req, root + "/requests")
    assert rows(spark.read.json(root + "/requests"), "repo", "path") == [("q", "b.md"), ("r", "a.md")]
    ready = spark.createDataFrame([("r", "a.md", "new", "written")], "repo string, path string, content string, outcome string")
    V.write_docs(ready, root + "/docs")
    assert rows(spark.read.parquet(root + "/docs"), "repo", "path", "content") == [("r", "a.md", "new")]


def _requests(spark):
    return spark.createDataFrame(
        [("r1", "a.md", "ask 1", "h1"), ("r2", "a.md", "ask 1", "h1"), ("r1", "b.md", "ask 2", "h2")],
        "repo string, path string, request_json string, request_hash string",
    )


def test_stored_errors_are_asked_again_and_every_asker_gets_the_reply(spark):
    store = tempfile.mkdtemp(prefix="docdrift-src-") + "/replies"
    log = tempfile.mkdtemp(prefix="docdrift-src-")

    def flaky(request, log=log):
        import os
        import uuid

        open(os.path.join(log, uuid.uuid4().hex), "w").write(request)
        if request == "ask 2":
            raise ValueError("down")
        return "reply to " + request

    def working(request):
        return "later reply to " + request

    first = RQ.complete_requests(_requests(spark), flaky, store=store, batches=2)
    assert rows(first, "repo", "path", "body", "error") == [
        ("r1", "a.md", "reply to ask 1", None), ("r1", "b.md", None, "ValueError: down"), ("r2", "a.md", "reply to ask 1", None),
    ]
    assert sorted(open(os.path.join(log, f)).read() for f in os.listdir(log)) == ["ask 1", "ask 2"]  # once per request
    again = RQ.complete_requests(_requests(spark), working, store=store)
    assert rows(again, "repo", "path", "body") == [
        ("r1", "a.md", "reply to ask 1"), ("r1", "b.md", "later reply to ask 2"), ("r2", "a.md", "reply to ask 1"),
    ]


def test_malformed_bodies_are_bad_bodies(spark):
    from docdrift.sources import replies as SR

    good = '{"choices": [{"message": {"role": "a", "content": "x"}, "finish_reason": "stop"}]}'
    bodies = ['{"choices": oops}', '{"choices": [}', good, "[]", "", None, "{}", good + " {}"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = SR.gate_replies(SR.decode_replies(df)).orderBy("i").collect()
    assert [r["reply_status"] for r in got][:5] == ["bad_body", "bad_body", "ok", "bad_body", "bad_body"]
    assert [r["reply_ok"] for r in got][6] and got[6]["reply_status"] == "no_choices"


def test_request_names_its_summary_and_the_body_holds_it(spark):
    docs = spark.createDataFrame([("r", "a.md", "text <!-- hidden --> end")], "repo string, path string, content string")
    sums = spark.createDataFrame([("r", "+ ADDED   X: func X()")], "repo string, summary string")
    for max_tokens, present in ((0, False), (256, True)):
        req = RQ.request_json(RQ.build_requests(docs, sums, model="m", max_tokens=max_tokens))
        row = req.join(sums, "repo").select("*", RQ.request_body("request_json", F.col("summary")).alias("body")).first()
        assert "ADDED" not in row["request_json"] and row["summary_key"] in row["request_json"]
        body = json.loads(row["body"])
        assert ("max_tokens" in body) is present and "summary_key" not in body
        assert body["temperature"] == 0.0 and body["model"] == "m"
        user = body["messages"][1]["content"]
        assert "hidden" not in user and user.startswith("<CODE_CHANGES>\n+ ADDED")
        assert '</CODE_CHANGES>\n\n<DOCUMENT path="a.md">\ntext  end\n</DOCUMENT>' in user
        assert len(row["request_hash"]) == 64
