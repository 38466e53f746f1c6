"""Mining + declaration diff end to end on inline sources, plus nested
comparisons and rename pairing."""

import random

from pyspark.sql import functions as F

from docdrift.operators import diff as D
from docdrift.operators import mining as MI
from docdrift.operators import nested as N
from docdrift.operators import summary as A


def _files(spark, items):
    return spark.createDataFrame([("r", p, c) for p, c in items], "repo string, path string, content string")


def _diff(spark, old_src, new_src, path="a.go"):
    old = MI.mine_declarations(_files(spark, [(path, old_src)])).drop("exported")
    new = MI.mine_declarations(_files(spark, [(path, new_src)])).drop("exported")
    return D.symbol_diff(old, new)


def _counts(df):
    out = {}
    for r in df.collect():
        out[r["change"]] = out.get(r["change"], 0) + 1
    return out


def test_mixed_changes(spark):
    old = "package p\n\nfunc Keep() {}\n\nfunc Remove() {}\n\nfunc Modify(a int) {}\n"
    new = 'package p\n\nfunc Keep() {}\n\nfunc Modify(a int, b string) {}\n\nfunc Added() string { return "" }\n'
    d = _diff(spark, old, new)
    assert _counts(d) == {"added": 1, "removed": 1, "modified": 1}
    mod = d.filter("change = 'modified'").collect()[0]
    assert [c["description"] for c in mod["changes"]] == ["parameter b string added"]
    text = A.summary_verbose(d).collect()[0]["summary"]
    for section in ("## Added", "## Removed", "## Modified"):
        assert section in text
    assert "- func Modify: parameter b string added" in text


def test_new_and_deleted_file(spark):
    src = "package p\n\nfunc Alpha() {}\n\nvar MaxSize int\n"
    assert _counts(_diff(spark, "", src)) == {"added": 2}
    assert _counts(_diff(spark, src, "")) == {"removed": 2}


def test_no_difference(spark):
    src = "package p\n\nfunc Hello() {}\n"
    d = _diff(spark, src, src)
    assert d.count() == 0
    repos = spark.createDataFrame([("r",)], "repo string")
    assert A.summary_compact(d, repos).collect()[0]["summary"] == "No changes to exported symbols"


def test_parse_error(spark):
    files = _files(spark, [("bad.go", "not valid go"), ("empty.go", "")])
    errs = MI.extract_errors(files).collect()
    assert [r["path"] for r in errs] == ["bad.go"]
    assert MI.mine_declarations(files).count() == 0


def test_duplicate_name_last_wins(spark):
    old = spark.createDataFrame(
        [("r", "a.go", 1, "X", "const", "const X"), ("r", "a.go", 2, "X", "var", "var X")],
        "repo string, path string, ordinal int, name string, kind string, signature string",
    )
    new = spark.createDataFrame([("r", "a.go", 1, "X", "var", "var X")], old.schema)
    assert D.symbol_diff(old, new).count() == 0


def _params(spark, o, n, fn):
    t = "array<struct<name:string,type:string>>"
    df = spark.createDataFrame([(o, n)], f"o {t}, n {t}")
    return df.select(fn(F.col("o"), F.col("n")).alias("c")).collect()[0]["c"]


def test_param_rules(spark):
    # reorder of same-named parameters is positional
    assert _params(spark, [("a", "int"), ("b", "string")], [("b", "string"), ("a", "int")], N.cmp_params) == [
        "parameter at position 0 changed from a int to b string",
        "parameter at position 1 changed from b string to a int",
    ]
    # type change by name
    assert _params(spark, [("a", "int")], [("a", "int64")], N.cmp_params) == ["parameter a type changed from int to int64"]
    # unnamed parameters are keyed by type
    assert _params(spark, [("", "int")], [("", "string")], N.cmp_params) == [
        "parameter string added",
        "parameter int removed",
    ]
    # results: count change is one line; same count is per position
    assert _params(spark, [("", "error")], [("", "int"), ("", "error")], N.cmp_returns) == [
        "return values changed from (error) to (int, error)"
    ]
    assert _params(spark, [("n", "int")], [("m", "int")], N.cmp_returns) == ["return value at position 0 name changed from n to m"]


def test_parse_params(spark):
    df = spark.createDataFrame(
        [("a, b string",), ("chan int",), ("x int, f func(int) error, opts ...string",), ("int, error",), ("",)], "s string"
    )
    got = [[(p["name"], p["type"]) for p in r["p"]] for r in df.select(MI.parse_params(F.col("s")).alias("p")).collect()]
    assert got == [
        [("a", "string"), ("b", "string")],
        [("", "chan int")],
        [("x", "int"), ("f", "func(int) error"), ("opts", "...string")],
        [("", "int"), ("", "error")],
        [],
    ]


def _sym_rows(spark, rows):
    return spark.createDataFrame(
        [("r", path, i, name, kind, f"{kind} {name}") for i, (path, name, kind) in enumerate(rows)],
        "repo string, path string, ordinal int, name string, kind string, signature string",
    )


def test_rename_pairing_cases(spark):
    old = _sym_rows(spark, [("a.go", "A1", "const"), ("a.go", "A2", "const"), ("b.go", "B", "func")])
    new = _sym_rows(spark, [("a.go", "C1", "const"), ("c.go", "B2", "func")])
    d = D.symbol_diff(old, new)
    got = sorted((r["path"], r["change"], r["name"], r["old_name"]) for r in d.collect())
    # one pair inside a.go (A1 -> C1 by name rank); A2 stays removed; no cross-file pairing
    assert got == [
        ("a.go", "removed", "A2", ""),
        ("a.go", "renamed", "C1", "A1"),
        ("b.go", "removed", "B", ""),
        ("c.go", "added", "B2", ""),
    ]


def _greedy_model(old, new):
    """Plain-Python reference: per file, removed/added by name, pair each
    removed with the first unpaired added of the same kind."""
    out = {}
    files = {p for p, _, _ in old} | {p for p, _, _ in new}
    for f in files:
        o = {n: k for p, n, k in old if p == f}
        n_ = {n: k for p, n, k in new if p == f}
        removed = sorted(x for x in o if x not in n_)
        added = sorted(x for x in n_ if x not in o)
        used = set()
        pairs = 0
        for r in removed:
            for a in added:
                if a not in used and n_[a] == o[r]:
                    used.add(a)
                    pairs += 1
                    break
        out[f] = (len(removed) - pairs, len(added) - pairs, pairs)
    return out


def test_rename_counts_random_with_split_classes(spark):
    rnd = random.Random(7)
    kinds = ["const", "var", "func"]
    old, new = [], []
    for f in ["x.go", "y.go"]:
        names = [f"N{i}" for i in range(60)]
        for nm in names:
            if rnd.random() < 0.7:
                old.append((f, nm, rnd.choice(kinds)))
        for nm in names + [f"M{i}" for i in range(40)]:
            if rnd.random() < 0.5:
                new.append((f, nm, rnd.choice(kinds)))
    # keep kinds stable for names present on both sides
    okind = {(p, n): k for p, n, k in old}
    new = [(p, n, okind.get((p, n), k)) for p, n, k in new]
    expect = _greedy_model(old, new)
    for ranges in (None, 1, 7):
        d = D.symbol_diff(_sym_rows(spark, old), _sym_rows(spark, new), ranges=ranges)
        got = {}
        for r in d.collect():
            rm, ad, pr = got.get(r["path"], (0, 0, 0))
            got[r["path"]] = (rm + (r["change"] == "removed"), ad + (r["change"] == "added"), pr + (r["change"] == "renamed"))
        for f, v in expect.items():
            assert got.get(f, (0, 0, 0)) == v, (ranges, f)


def test_rename_pairs_are_the_same_for_any_ranges(spark):
    # one class, 50 removed and 20 added, spread over 1, 4 and 64 ranges: the
    # i-th removed by name always pairs with the i-th added by name
    old = [("z.go", f"Old{i:02d}", "const") for i in range(50)] + [("y.go", "A", "const")]
    new = [("z.go", f"New{i:02d}", "const") for i in range(20)] + [("y.go", "B", "const"), ("y.go", "C", "const")]
    expect = sorted((f"Old{i:02d}", f"New{i:02d}") for i in range(20)) + [("A", "B")]
    for ranges in (1, 4, 64):
        got = D.symbol_diff(_sym_rows(spark, old), _sym_rows(spark, new), ranges=ranges).collect()
        assert sorted((r["old_name"], r["name"]) for r in got if r["change"] == "renamed") == sorted(expect), ranges
        assert sum(r["change"] == "removed" for r in got) == 30 and sum(r["change"] == "added" for r in got) == 1


def test_what_an_unread_file_would_hold_is_unknown(spark):
    old = [("a.go", "F", "func"), ("b.go", "G", "func"), ("b.go", "Kept", "func"), ("c.go", "H", "func")]
    new = [("b.go", "G2", "func"), ("b.go", "Kept", "func"), ("c.go", "H2", "func"), ("d.go", "N", "func")]
    frames = [spark.createDataFrame([("r", *s, 1) for s in side], "repo string, path string, name string, kind string, ordinal int") for side in (old, new)]
    sides = [("r", "a.go", "new"), ("r", "b.go", "new"), ("r", "d.go", "old"), ("r", "d.go", "old"), ("x", "c.go", "new")]
    failed = spark.createDataFrame(sides, "repo string, path string, side string")
    got = {(r.path, r.name): (r.change, r.parse_failed) for r in D.symbol_diff(*frames, failed=failed).collect()}
    assert got == {
        ("a.go", "F"): ("removed", True), ("b.go", "G"): ("removed", True), ("b.go", "G2"): ("added", False),
        ("c.go", "H2"): ("renamed", False), ("d.go", "N"): ("added", True),
    }


def test_strict_renames_need_a_shape(spark):
    schema = "repo string, path string, name string, kind string, ordinal int, params array<struct<name:string,type:string>>"
    old = spark.createDataFrame([("r", "a.go", "A", "const", 1, []), ("r", "a.go", "F", "func", 2, [("x", "int")])], schema)
    new = spark.createDataFrame([("r", "a.go", "B", "const", 1, []), ("r", "a.go", "G", "func", 2, [("y", "int")])], schema)
    loose = {(r.name, r.change) for r in D.symbol_diff(old, new).collect()}
    strict = {(r.name, r.change) for r in D.symbol_diff(old, new, strict_renames=True).collect()}
    assert loose == {("B", "renamed"), ("G", "renamed")}
    assert strict == {("A", "removed"), ("B", "added"), ("G", "renamed")}
