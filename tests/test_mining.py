"""Declaration mining on ordinary source shapes."""

import time

import pytest

from docdrift.operators import diff as D
from docdrift.operators import mining as MI


def _one(spark, text):
    return spark.createDataFrame([("r", "a.go", text)], "repo string, path string, content string")


def mined(spark, source, exported=True):
    df = _one(spark, "package p\n\n" + source)
    return {r["name"]: r for r in MI.mine_declarations(df, exported).orderBy("ordinal").collect()}


SOURCE = '''type P struct {
	ID int `json:"id"` // key
	hidden int `json:"h"` // no
	// Name of it.
	Name, Other string `x:"}"`
	Embedded
	Inner struct {
		A int
		B string
	}
	F func(
		a int,
	) error
}

type One struct{ X int; Y string }

type Empty struct{}

type M[K comparable, V []int] struct {
	Key K
}

type I interface {
	Do(
		a int,
		b string,
	) (int, error) // does
	Close() error
}

type J interface{ Get() int }

func New() *T { return &T{"{"} }

func Any(x interface{ M() }) interface{ N() } { return nil }

func (s *Srv[T]) Serve(addr string) (err error) {
	if x := "func Ghost() {"; x != "" {
		return nil
	}
	return
}

/*
func Ghost() {}
*/
const ( // flags
	Open = "{"
	Close = '}'
	Raw = `
func Ghost2() {}
)`
	After // last
)

var Text = "// not a comment" // a comment

func Élan() {}

type Ünit int

var X, Y int
func X2() {}
'''


@pytest.fixture(scope="module")
def symbols(spark):
    return mined(spark, SOURCE)


def pairs(row, field):
    return [(x["name"], x["type"]) for x in row[field]]


def test_names(symbols):
    assert set(symbols) == {
        "P", "One", "Empty", "M", "I", "J", "New", "Any", "Srv[T].Serve", "Open", "Close", "Raw", "After", "Text", "Élan", "Ünit", "X", "Y", "X2",
    }


def test_struct_fields(symbols):
    assert pairs(symbols["P"], "fields") == [
        ("ID", "int"), ("Name", "string"), ("Other", "string"), ("Embedded", "Embedded"),
        ("Inner", "struct { A int; B string }"), ("F", "func(a int) error"),
    ]
    docs = {f["name"]: f["doc"] for f in symbols["P"]["fields"]}
    assert docs["ID"] == "key\n" and docs["Name"] == "Name of it.\n"
    assert pairs(symbols["One"], "fields") == [("X", "int"), ("Y", "string")]
    assert symbols["One"]["signature"] == "type One struct {X int; Y string}"
    assert symbols["Empty"]["signature"] == "type Empty struct {}"
    assert symbols["M"]["kind"] == "struct" and pairs(symbols["M"], "fields") == [("Key", "K")]


def test_interface_methods(symbols):
    assert pairs(symbols["I"], "methods") == [("Do", "func(a int, b string) (int, error)"), ("Close", "func() error")]
    assert symbols["I"]["methods"][0]["doc"] == "does\n"
    assert pairs(symbols["J"], "methods") == [("Get", "func() int")]


def test_functions_end_at_their_body(symbols):
    assert symbols["New"]["signature"] == "func New() *T" and pairs(symbols["New"], "returns") == [("", "*T")]
    assert symbols["Any"]["signature"] == "func Any(x interface{ M() }) interface{ N() }"
    assert symbols["Srv[T].Serve"]["signature"] == "func (s *Srv[T]) Serve(addr string) (err error)"
    assert pairs(symbols["Srv[T].Serve"], "returns") == [("err", "error")]


def test_values(symbols):
    assert {n: symbols[n]["grp"] for n in ("Open", "Close", "Raw", "After")} == dict.fromkeys(("Open", "Close", "Raw", "After"), "Open")
    assert symbols["After"]["doc"] == "last\n" and symbols["Text"]["doc"] == "a comment\n"
    order = [r["ordinal"] for r in symbols.values()]
    assert order == sorted(order) and len(set(order)) == len(order)
    assert list(symbols)[-3:] == ["X", "Y", "X2"]


def test_a_body_is_no_change_and_a_member_is(spark):
    def diff(old, new):
        frame = [spark.createDataFrame([("r", "a.go", "package p\n\n" + x)], "repo string, path string, content string") for x in (old, new)]
        rows = D.symbol_diff(*(MI.mine_declarations(f).drop("exported") for f in frame)).collect()
        return sorted((r["name"], r["change"]) for r in rows)

    assert diff("func New() int { return 1 }\n", "func New() int { return 2 }\n") == []
    assert diff("type P struct{ X int }\n", "type P struct{ X, Y int }\n") == [("P", "modified")]
    assert diff('const (\n\tOpen = "{"\n\tGone = 1\n)\n', 'const (\n\tOpen = "{"\n)\n') == [("Gone", "removed")]


def test_broken_files_are_errors_and_give_nothing(spark):
    files = [
        ("ok.go", "// note\n/* package x\n*/\n\npackage p\n\nfunc A() {}\n"), ("none.go", "not valid go"), ("empty.go", ""),
        ("comment.go", "/*\npackage p\n*/\nfunc B() {}\n"), ("open.go", "package p\n\nfunc Broken( {\n}\n"), ("text.go", 'package p\n\nvar X = "(("\n'),
    ]
    df = spark.createDataFrame([("r", p, c) for p, c in files], "repo string, path string, content string")
    errors = {r["path"]: r["error"] for r in MI.extract_errors(df).collect()}
    assert errors == {"none.go": "expected 'package' clause", "comment.go": "expected 'package' clause", "open.go": "unbalanced brackets"}
    assert {(r["path"], r["name"]) for r in MI.mine_declarations(df).collect()} == {("ok.go", "A"), ("text.go", "X")}


def test_mask_keeps_lines_and_columns(spark):
    text = 'a "b\\"c" // d\n/* e\nf */ `g\nh` \'\\\'\' i / j'
    df = spark.createDataFrame([(text,), ("x" * 9000 + '"' + "y" * 9000 + '"',)], "t string")
    got = [r[0] for r in df.select(MI.mask(df["t"])).collect()]
    assert [len(g) for g in got] == [len(text), 18002]
    assert got[0] == 'a "____" \x01   \n    \n     `_\n_` \'__\' i / j'


def test_a_long_comment_block_takes_linear_work(spark):
    n = 100_000
    text = "package p\n\n" + "".join(f"// note {k}\n" for k in range(n)) + "func F() {}\n\n// G is next.\nfunc G() {}\n"
    start = time.time()
    docs = {r.name: r.doc for r in MI.mine_declarations(_one(spark, text)).select("name", "doc").collect()}
    assert docs["G"] == "G is next.\n"
    assert docs["F"] == "".join(f"note {k}\n" for k in range(n))
    assert time.time() - start < 60


def test_lines_are_dealt_out_once(spark):
    mined = MI.mine_declarations(_one(spark, "package p\n\nfunc F() {}\n"))
    plan = mined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(repo" in plan
