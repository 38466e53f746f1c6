"""Change detection, document scan, prefix selection with fallback, budget."""

from docdrift.functions.paths import stays_inside_root
from docdrift.operators import changes as C
from docdrift.operators import select as M
from docdrift.sources import docs as SD
from docdrift.sources import snapshots as SS

from collected import rows


def _snap(spark, items, ref):
    df = spark.createDataFrame([("r", ref, p, c) for p, c in items], "repo string, ref string, path string, content string")
    return SS.with_hash(df)


def test_changed_files_cases(spark):
    before = [("cmd/serve.go", "package cmd\n\nvar Port = 80\n\n\n"), ("cmd/stop.go", "package cmd\n"), ("old/gone.go", "package old\n")]
    after = [
        ("cmd/serve.go", "package cmd\n\nvar Port = 8080\n"),
        ("cmd/stop.go", "package cmd\n"),
        ("store/disk/page.go", "package disk\n"),
        ("docs/guide.md", "# Guide\n"),
        ("deploy.yaml", "replicas: 2\n"),
    ]
    got = C.changed_files(SS.filter_source_files(_snap(spark, before, "base")), SS.filter_source_files(_snap(spark, after, "head")))
    assert rows(got, "path", "old_content", "new_content") == [
        ("cmd/serve.go", "package cmd\n\nvar Port = 80", "package cmd\n\nvar Port = 8080\n"),
        ("old/gone.go", "package old", ""),
        ("store/disk/page.go", "", "package disk\n"),
    ]
    assert C.changed_files(_snap(spark, before, "base"), _snap(spark, before, "head")).count() == 0


def test_split_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n"), ("b", "")], "path string, content string")
    assert rows(C.split_lines(df), "path", "line_no", "line") == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "")]


def test_safe_paths(spark):
    df = spark.createDataFrame([("/etc/x",), ("../x",), ("a/../b",), ("a/../../x",), ("./a/b",)], "p string")
    got = [r[0] for r in df.select(stays_inside_root("p")).collect()]
    assert got == [True, False, True, False, True]


def _docs(spark, paths):
    return spark.createDataFrame([("r", p, "x" * 8) for p in paths], "repo string, path string, content string")


def test_scan_docs_roots_and_excludes(spark):
    docs = _docs(spark, ["docs/a.md", "docs/sub/b.md", "docs2/c.md", "README.md", "docs/n.txt", "top.md"])
    roots = spark.createDataFrame([("r", "docs/"), ("r", "README.md"), ("r", "missing")], "repo string, root string")
    excl = spark.createDataFrame([("r", "docs/sub/b.md")], "repo string, path string")
    assert rows(SD.scan_docs(docs, roots, excl), "path") == [("README.md",), ("docs/a.md",)]
    everything = spark.createDataFrame([("r", ".")], "repo string, root string")
    assert len(rows(SD.scan_docs(docs, everything), "path")) == 5


def _pairs(spark, items):
    return spark.createDataFrame(items, "repo string, mapping_id long, code_prefix string, doc_path string")


def test_selection_fallbacks(spark):
    docs = _docs(spark, ["a.md", "b.md", "c.md"])
    changed = spark.createDataFrame([("r", "pkg/src10/x.go")], "repo string, path string")
    # unaligned prefix: pkg/src1 matches pkg/src10/...
    mapped = M.mapped_docs(changed, _pairs(spark, [("r", 1, "pkg/src1", "a.md"), ("r", 2, "cmd/", "b.md")]))
    assert rows(M.select_docs(docs, mapped), "path") == [("a.md",)]
    # no match -> all documents
    none = M.mapped_docs(changed, _pairs(spark, [("r", 1, "cmd/", "a.md")]))
    assert len(rows(M.select_docs(docs, none))) == 3
    # mapped document does not exist -> all documents
    ghost = M.mapped_docs(changed, _pairs(spark, [("r", 1, "pkg/", "ghost.md")]))
    assert len(rows(M.select_docs(docs, ghost))) == 3
    # empty prefix matches every path
    allp = M.mapped_docs(changed, _pairs(spark, [("r", 1, "", "c.md")]))
    assert rows(M.select_docs(docs, allp), "path") == [("c.md",)]


def test_budget_boundary(spark):
    docs = spark.createDataFrame(
        [("r1", "a.md", "x" * 400), ("r2", "b.md", "x" * 404), ("r3", "c.md", "é" * 3)],
        "repo string, path string, content string",
    )
    est = {r["repo"]: (r["total_bytes"], r["est_tokens"], r["within_budget"]) for r in M.budget_gate(M.token_estimate(docs), 100).collect()}
    assert est["r1"] == (400, 100, True)
    assert est["r2"] == (404, 101, False)
    assert est["r3"] == (6, 1, True)
