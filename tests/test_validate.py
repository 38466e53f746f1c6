"""Per-document and per-edit validation, carried over case by case."""

from docdrift.operators import validate as V


def _docs(spark, items):
    return spark.createDataFrame([("r", p, c) for p, c in items], "repo string, path string, content string")


def test_validate_updates_cases(spark):
    originals = _docs(
        spark,
        [
            ("empty.md", "# Hello\nSome content.\n"),
            ("loss60.md", "x" * 1000),
            ("loss30.md", "x" * 1000),
            ("growth.md", "short"),
            ("half.md", "x" * 100),
        ],
    )
    updates = _docs(
        spark,
        [
            ("empty.md", ""),
            ("loss60.md", "x" * 400),
            ("loss30.md", "x" * 700),
            ("growth.md", "y" * 5000),
            ("half.md", "x" * 50),
            ("unknown.md", "content"),
        ],
    )
    got = {r["file"]: (r["message"], r["rejected"]) for r in V.validate_updates(originals, updates).collect()}
    assert set(got) == {"empty.md", "loss60.md"}
    assert got["empty.md"] == ("updated content is empty", True)
    assert got["loss60.md"][1] is True
    assert got["loss60.md"][0] == "content shrank by 60% (1000 → 400 bytes), exceeds 50% threshold"


def test_validate_updates_counts_bytes_not_characters(spark):
    # 10 two-byte characters (20 bytes) down to 9 bytes: 55 % of the bytes are lost
    originals = _docs(spark, [("a.md", "é" * 10)])
    updates = _docs(spark, [("a.md", "x" * 9)])
    got = V.validate_updates(originals, updates).collect()
    assert len(got) == 1 and got[0]["rejected"]
    assert "(20 → 9 bytes)" in got[0]["message"]


def test_validate_edit_cases(spark):
    edits = spark.createDataFrame(
        [
            ("a.md", "replace", "x" * 13, "", 500),
            ("a.md", "replace", "old", "new", 500),
            ("a.md", "delete", "x" * 400, "", 1000),
            ("a.md", "delete", "xxxx", "", 1000),
            ("a.md", "insert_after", "anchor", "new stuff", 500),
            ("a.md", "delete", "xxxx", "", 0),
        ],
        "file string, action string, old_text string, new_text string, file_len int",
    )
    got = [(r["action"], r["message"], r["rejected"]) for r in V.validate_edits(edits).collect()]
    warnings = [g for g in got if g[1] is not None]
    assert len(warnings) == 2
    assert all(not g[2] for g in got)
    msgs = sorted(w[1] for w in warnings)
    assert msgs[0].startswith("replace has empty new_text for \"xxxxxxxxxxxxx\"")
    assert msgs[1] == "single delete removes 40% of file (400 of 1000 bytes)"


def test_blocked_and_force(spark):
    updates = _docs(spark, [("a.md", ""), ("b.md", "fine")])
    originals = _docs(spark, [("a.md", "text"), ("b.md", "fine!")])
    issues = V.validate_updates(originals, updates)
    flagged = {r["path"]: r["blocked"] for r in V.blocked_docs(updates, issues).collect()}
    assert flagged == {"a.md": True, "b.md": False}
    forced = {r["path"]: r["blocked"] for r in V.blocked_docs(updates, issues, force=True).collect()}
    assert forced == {"a.md": False, "b.md": False}
    report = {r["path"]: r["action"] for r in V.dry_run_report(V.blocked_docs(updates, issues)).collect()}
    assert report == {"a.md": "would block", "b.md": "would update"}


def test_write_ready_rules(spark):
    flagged = spark.createDataFrame(
        [
            ("r", "ok.md", "text", False),
            ("r", "blocked.md", "text", True),
            ("r", "empty.md", "", False),
            ("r", "../escape.md", "text", False),
            ("r", "missing.md", "text", False),
            ("r", "nl.md", "done\n", False),
        ],
        "repo string, path string, content string, blocked boolean",
    )
    existing = _docs(spark, [(p, "x") for p in ["ok.md", "blocked.md", "empty.md", "../escape.md", "nl.md"]])
    got = {r["path"]: (r["outcome"], r["content"]) for r in V.write_ready_docs(flagged, existing).collect()}
    assert got["ok.md"] == ("written", "text\n")
    assert got["nl.md"] == ("written", "done\n")
    assert got["blocked.md"][0] == "blocked"
    assert got["empty.md"][0] == "empty"
    assert got["../escape.md"][0] == "unsafe_path"
    assert got["missing.md"][0] == "missing_target"
    counts = V.outcome_counts(V.write_ready_docs(flagged, existing)).collect()[0]
    assert (counts["written"], counts["blocked"], counts["refused"]) == (2, 1, 3)
