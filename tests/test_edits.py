"""Reply decoding and ordered edit application."""

import json

from pyspark.sql import functions as F

from docdrift.operators import edits as E
from docdrift.sources import replies as SR


def _apply(spark, content, edits, path="d.md"):
    docs = spark.createDataFrame([("r", path, content)], "repo string, path string, content string")
    ed = [
        {"file": e[0], "section": None, "action": e[1], "old_text": e[2], "new_text": e[3]}
        for e in edits
    ]
    rep = spark.createDataFrame(
        [("r", path, ed)],
        "repo string, path string, edits array<struct<file:string,section:string,action:string,old_text:string,new_text:string>>",
    )
    r = E.apply_edits(docs, rep).collect()[0]
    return r["new_content"], [(l["seq"], l["error"]) for l in r["log"]]


def test_chained_and_first_occurrence(spark):
    out, log = _apply(
        spark,
        "a b a",
        [("d.md", "replace", "a", "x"), ("d.md", "replace", "x b", "y"), ("d.md", "delete", "a", "")],
    )
    assert out == "y "
    assert all(e is None for _, e in log)


def test_literal_matching_and_empty_old_text(spark):
    out, _ = _apply(spark, "cost (1+1)*2", [("d.md", "replace", "(1+1)*", "3*")])
    assert out == "cost 3*2"
    out, _ = _apply(spark, "body", [("d.md", "replace", "", "head ")])
    assert out == "head body"


def test_insert_after_and_duplicates(spark):
    out, log = _apply(
        spark,
        "# Title\ntext",
        [
            ("d.md", "insert_after", "# Title", "New line"),
            ("d.md", "insert_after", "# Title", "  New line  "),
            ("d.md", "insert_after", "missing", "x"),
            ("d.md", "insert_after", "text", "   "),
        ],
    )
    assert out == "# Title\nNew line\ntext"
    assert [e for _, e in log] == [None, "duplicate", "anchor_not_found", "duplicate"]


def test_unknown_file_action_and_missing_text(spark):
    out, log = _apply(
        spark,
        "hello",
        [("other.md", "replace", "hello", "x"), ("d.md", "rewrite", "hello", "x"), ("d.md", "delete", "absent", "")],
    )
    assert out == "hello"
    assert [e for _, e in log] == ["unknown_file", "unknown_action", "not_found"]


def _decode(spark, contents, finish="stop"):
    bodies = []
    for c in contents:
        if c is None:
            bodies.append(json.dumps({"choices": []}))
        else:
            bodies.append(json.dumps({"choices": [{"message": {"role": "assistant", "content": c}, "finish_reason": finish}]}))
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "path string, body string")
    d = SR.decode_edits(SR.gate_replies(SR.decode_replies(df)))
    return [(r["reply_status"], r["decode_status"], None if r["edits"] is None else len(r["edits"])) for r in d.orderBy(F.col("path").cast("int")).collect()]


def test_reply_shapes(spark):
    e = json.dumps({"edits": [{"file": "a.md", "action": "delete", "old_text": "x", "new_text": ""}], "reason": "r"})
    got = _decode(
        spark,
        [e, "```json\n" + e + "\n```", "```" + e + "```", "", None, "[]", "{}", '{"edits": null}', "  " + e + "  "],
    )
    assert got == [
        ("ok", "ok", 1),
        ("ok", "ok", 1),
        ("ok", "bad_json", None),
        ("empty_content", None, None),
        ("no_choices", None, None),
        ("ok", "bad_json", None),
        ("ok", "ok", 0),
        ("ok", "ok", 0),
        ("ok", "ok", 1),
    ]
    assert _decode(spark, [e], finish="length") == [("truncated", None, None)]


def test_strip_fences_expression(spark):
    df = spark.createDataFrame([("```json\n{}\n```",), ("```{}```",), ("  {} ",), ("```\nx",)], "s string")
    got = [r[0] for r in df.select(SR.strip_fences(F.col("s"))).collect()]
    assert got == ["{}", "```{}```", "{}", "```\nx"]
