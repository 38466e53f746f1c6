"""Keys E1-E12 bound to ``supplier`` (one generated source file each, see
``bindings.go_sources``). The oracle states the expected declarations
straight from the supplier columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mining as E
from ..operators.nested import format_params
from . import bindings as B
from .registry import register


def _mined(spark, sf, exported_only=True):
    return E.mine_declarations(B.go_sources(spark, sf), exported_only=exported_only)


def _members(col):
    return F.array_join(
        F.transform(col, lambda f: F.concat(f["name"], F.lit(" "), f["type"], F.lit(" | "), F.rtrim(f["doc"], F.lit("\n")))), "; "
    )


NL = "chr(10)"
K = "CAST(s_suppkey AS VARCHAR)"
BASE = f"""s AS (SELECT 'r' || CAST(s_nationkey % 5 AS VARCHAR) AS repo, 'pkg/s' || {K} || '.go' AS path, {K} AS k,
                 s_suppkey AS kn, s_name FROM supplier WHERE s_suppkey % 10 <> 7)"""
# columns: name, kind, signature, doc, recv, params, returns, fields, methods, grp, exported
ROWS = [
    f"""'Get' || k, 'func',
        CASE WHEN kn % 4 = 0 THEN 'func Get' || k || '(id, nation int, name string) (*Supplier' || k || ', error)'
             ELSE 'func Get' || k || '(id int, name string) (*Supplier' || k || ', error)' END,
        'Get' || k || ' returns supplier ' || k || '.' || {NL} || 'It never fails.' || {NL}, '',
        CASE WHEN kn % 4 = 0 THEN 'id int, nation int, name string' ELSE 'id int, name string' END,
        '*Supplier' || k || ', error', '', '', '', true""",
    f"""'Supplier' || k, 'struct', 'type Supplier' || k || ' struct {{ID int; Name string; hidden int; Nation; A, B float64}}',
        'Supplier' || k || ' is one supplier.' || {NL}, '', '', '',
        'ID int | ID is the key.; Name string | display name; Nation Nation | ; A float64 | ; B float64 | ', '', '', true""",
    f"""'Supplier' || k || '.Balance', 'method', 'func (s *Supplier' || k || ') Balance() float64',
        'Balance returns the account balance.' || {NL}, 'Supplier' || k, '', 'float64', '', '', '', true""",
    f"""'MaxItems' || k, 'const', 'const MaxItems' || k, 'MaxItems' || k || ' caps items.' || {NL}, '', '', '', '', '',
        'MaxItems' || k, true""",
    """'minItems' || k, 'const', 'const minItems' || k, '', '', '', '', '', '', 'MaxItems' || k, false""",
    """'Label' || k, 'const', 'const Label' || k || ' string', '', '', '', '', '', '', 'MaxItems' || k, true""",
    """'Default' || k, 'var', 'var Default' || k, '', '', '', '', '', '', '', true""",
    f"""'Reader' || k, 'interface', 'type Reader' || k || ' interface {{Read(p []byte) (n int, err error); fmt.Stringer}}',
        'Reader' || k || ' reads.' || {NL}, '', '', '', '', 'Read func(p []byte) (n int, err error) | ', '', true""",
    """'ID' || k, 'type alias', 'type ID' || k || ' = int64', '', '', '', '', '', '', '', true""",
    """'Count' || k, 'type', 'type Count' || k || ' int', '', '', '', '', '', '', '', true""",
    """'Apply' || k, 'func', 'func Apply' || k || '(f func(int) error, ch chan int, opts ...string) (ok bool)', '', '',
        'f func(int) error, ch chan int, opts ...string', 'ok bool', '', '', '', true""",
    """'helper' || k, 'func', 'func helper' || k || '()', '', '', '', '', '', '', '', false""",
]
COLS = "name, kind, signature, doc, recv, params, returns, fields, methods, grp, exported"


def _sql(select: str) -> str:
    names = [c.strip() for c in COLS.split(",")]
    # positional union with explicit names on the first branch
    vals = _split_top_level(ROWS[0])
    aliased_first = ", ".join(f"{v} AS {n}" for v, n in zip(vals, names))
    union = f"SELECT repo, path, {aliased_first} FROM s"
    for r in ROWS[1:]:
        union += f"\n    UNION ALL SELECT repo, path, {r} FROM s"
    return f"WITH {BASE},\n  exp AS ({union})\n{select}"


def _split_top_level(expr_list: str) -> list[str]:
    out, depth, cur, quote = [], 0, "", False
    for ch in expr_list:
        if ch == "'":
            quote = not quote
        if not quote:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 0:
                out.append(cur.strip())
                cur = ""
                continue
        cur += ch
    out.append(cur.strip())
    return out


@register("mine_declarations", _sql("SELECT repo, path, name, kind FROM exp WHERE exported"))
def q_mine_declarations(spark, sf):
    return _mined(spark, sf).select("repo", "path", "name", "kind")


@register("exported_only", _sql("SELECT repo, path, name, exported FROM exp"))
def q_exported_only(spark, sf):
    return _mined(spark, sf, exported_only=False).select("repo", "path", "name", "exported")


@register("parse_params", _sql("SELECT repo, path, name, params, returns FROM exp WHERE exported AND kind IN ('func', 'method')"))
def q_parse_params(spark, sf):
    m = _mined(spark, sf).filter(F.col("kind").isin("func", "method"))
    return m.select("repo", "path", "name", format_params("params").alias("params"), format_params("returns").alias("returns"))


@register("method_receiver", _sql("SELECT repo, path, name, recv FROM exp WHERE exported AND kind = 'method'"))
def q_method_receiver(spark, sf):
    return _mined(spark, sf).filter(F.col("kind") == "method").select("repo", "path", "name", "recv")


@register("render_signature", _sql("SELECT repo, path, name, signature FROM exp WHERE exported"))
def q_render_signature(spark, sf):
    return _mined(spark, sf).select("repo", "path", "name", "signature")


@register("attach_docs", _sql("SELECT repo, path, name, doc FROM exp WHERE exported"))
def q_attach_docs(spark, sf):
    return _mined(spark, sf).select("repo", "path", "name", "doc")


@register("group_labels", _sql("SELECT repo, path, name, grp FROM exp WHERE exported AND kind IN ('const', 'var')"))
def q_group_labels(spark, sf):
    return _mined(spark, sf).filter(F.col("kind").isin("const", "var")).select("repo", "path", "name", "grp")


@register(
    "classify_types",
    _sql("SELECT repo, path, name, kind FROM exp WHERE exported AND kind IN ('struct', 'interface', 'type alias', 'type')"),
)
def q_classify_types(spark, sf):
    m = _mined(spark, sf).filter(F.col("kind").isin("struct", "interface", "type alias", "type"))
    return m.select("repo", "path", "name", "kind")


@register("struct_fields", _sql("SELECT repo, path, name, fields FROM exp WHERE exported AND kind = 'struct'"))
def q_struct_fields(spark, sf):
    m = _mined(spark, sf).filter(F.col("kind") == "struct")
    return m.select("repo", "path", "name", _members(F.col("fields")).alias("fields"))


@register("interface_methods", _sql("SELECT repo, path, name, methods FROM exp WHERE exported AND kind = 'interface'"))
def q_interface_methods(spark, sf):
    m = _mined(spark, sf).filter(F.col("kind") == "interface")
    return m.select("repo", "path", "name", _members(F.col("methods")).alias("methods"))


@register("value_symbols", _sql("SELECT repo, path, name, kind, signature, grp FROM exp WHERE exported AND kind IN ('const', 'var')"))
def q_value_symbols(spark, sf):
    m = _mined(spark, sf).filter(F.col("kind").isin("const", "var"))
    return m.select("repo", "path", "name", "kind", "signature", "grp")


@register(
    "extract_errors",
    """SELECT 'r' || CAST(s_nationkey % 5 AS VARCHAR) AS repo, 'pkg/s' || CAST(s_suppkey AS VARCHAR) || '.go' AS path,
              'expected ''package'' clause' AS error FROM supplier WHERE s_suppkey % 10 = 7""",
)
def q_extract_errors(spark, sf):
    return E.extract_errors(B.go_sources(spark, sf))
