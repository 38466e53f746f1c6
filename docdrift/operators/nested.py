"""Nested-record diff: two arrays on one joined row -> list of change texts.

Every builder works on columns of one row with higher-order array functions
(``filter`` / ``exists`` / ``transform`` / ``zip_with``). There is no explode
and no regroup, so a nested diff never adds a shuffle.

Parameters and results are ``ARRAY<STRUCT<name, type>>``; fields and
methods are ``ARRAY<STRUCT<name, type, doc>>``. Each builder returns an
``ARRAY<STRING>`` of descriptions in the documented order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import col_, go_quote, let

def _empty() -> Column:
    return F.array().cast("array<string>")


def _arr(c) -> Column:
    return F.coalesce(col_(c), F.array())


def _s(c) -> Column:
    return F.coalesce(col_(c), F.lit(""))


def format_param(p) -> Column:
    """``name type`` or just ``type`` when unnamed."""
    return F.when(p["name"] != "", F.concat(p["name"], F.lit(" "), p["type"])).otherwise(p["type"])


def format_params(arr) -> Column:
    """Parameter list joined by ``, ``."""
    return F.array_join(F.transform(_arr(arr), format_param), ", ")


def _param_key(p) -> Column:
    return F.when(p["name"] != "", p["name"]).otherwise(F.concat(F.lit(":"), p["type"]))


def cmp_kind(o_kind, n_kind) -> Column:
    """N1."""
    o, n = _s(o_kind), _s(n_kind)
    return F.when(o != n, F.array(F.concat(F.lit("kind changed from "), o, F.lit(" to "), n))).otherwise(_empty())


def cmp_params(o_params, n_params) -> Column:
    """Added, removed, same-name type changes, then positional changes
    only when both lists have the same length and nothing else was found."""
    o, n = _arr(o_params), _arr(n_params)
    added = F.transform(
        F.filter(n, lambda x: ~F.exists(o, lambda y: _param_key(y) == _param_key(x))),
        lambda x: F.concat(F.lit("parameter "), format_param(x), F.lit(" added")),
    )
    removed = F.transform(
        F.filter(o, lambda x: ~F.exists(n, lambda y: _param_key(y) == _param_key(x))),
        lambda x: F.concat(F.lit("parameter "), format_param(x), F.lit(" removed")),
    )
    retyped = F.flatten(
        F.transform(
            F.filter(o, lambda x: x["name"] != ""),
            lambda x: F.transform(
                F.filter(n, lambda y: (y["name"] == x["name"]) & (y["type"] != x["type"])),
                lambda y: F.concat(
                    F.lit("parameter "), x["name"], F.lit(" type changed from "),
                    x["type"], F.lit(" to "), y["type"],
                ),
            ),
        )
    )
    found = F.concat(added, removed, retyped)
    positional = F.filter(
        F.transform(
            F.zip_with(o, n, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda z, i: F.when(
                (z["a"]["name"] != z["b"]["name"]) | (z["a"]["type"] != z["b"]["type"]),
                F.concat(
                    F.lit("parameter at position "), i.cast("string"), F.lit(" changed from "),
                    format_param(z["a"]), F.lit(" to "), format_param(z["b"]),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return F.when((F.size(o) == F.size(n)) & (F.size(found) == 0), positional).otherwise(found)


def cmp_returns(o_returns, n_returns) -> Column:
    """One line when the counts differ, else per position type then name."""
    o, n = _arr(o_returns), _arr(n_returns)
    per_pos = F.flatten(
        F.transform(
            F.zip_with(o, n, lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
            lambda z, i: F.filter(
                F.array(
                    F.when(
                        z["a"]["type"] != z["b"]["type"],
                        F.concat(
                            F.lit("return value at position "), i.cast("string"),
                            F.lit(" type changed from "), z["a"]["type"], F.lit(" to "), z["b"]["type"],
                        ),
                    ),
                    F.when(
                        z["a"]["name"] != z["b"]["name"],
                        F.concat(
                            F.lit("return value at position "), i.cast("string"),
                            F.lit(" name changed from "), z["a"]["name"], F.lit(" to "), z["b"]["name"],
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            ),
        )
    )
    count_changed = F.array(
        F.concat(
            F.lit("return values changed from ("), format_params(o), F.lit(") to ("),
            format_params(n), F.lit(")"),
        )
    )
    return F.when(F.size(o) != F.size(n), count_changed).otherwise(per_pos)


def _cmp_members(o_arr, n_arr, noun: str, changed_word: str) -> Column:
    o, n = _arr(o_arr), _arr(n_arr)
    added = F.transform(
        F.filter(n, lambda x: ~F.exists(o, lambda y: y["name"] == x["name"])),
        lambda x: F.concat(F.lit(f"{noun} "), x["name"], F.lit(" "), x["type"], F.lit(" added")),
    )
    removed = F.transform(
        F.filter(o, lambda x: ~F.exists(n, lambda y: y["name"] == x["name"])),
        lambda x: F.concat(F.lit(f"{noun} "), x["name"], F.lit(" "), x["type"], F.lit(" removed")),
    )
    # the last duplicate of a name on the new side wins
    paired = F.transform(
        o,
        lambda x: F.struct(
            x.alias("o"),
            F.try_element_at(F.filter(n, lambda y: y["name"] == x["name"]), F.lit(-1)).alias("n"),
        ),
    )
    retyped = F.transform(
        F.filter(paired, lambda p: p["n"].isNotNull() & (p["o"]["type"] != p["n"]["type"])),
        lambda p: F.concat(
            F.lit(f"{noun} "), p["o"]["name"], F.lit(f" {changed_word} from "),
            p["o"]["type"], F.lit(" to "), p["n"]["type"],
        ),
    )
    return F.concat(added, removed, retyped)


def cmp_fields(o_fields, n_fields) -> Column:
    """N4."""
    return _cmp_members(o_fields, n_fields, "field", "type changed")


def cmp_methods(o_methods, n_methods) -> Column:
    """N5."""
    return _cmp_members(o_methods, n_methods, "method", "signature changed")


def cmp_receiver(o_recv, n_recv) -> Column:
    """N6."""
    o, n = _s(o_recv), _s(n_recv)
    return F.when(
        o != n, F.array(F.concat(F.lit("receiver changed from "), o, F.lit(" to "), n))
    ).otherwise(_empty())


def cmp_signature(o_sig, n_sig, found) -> Column:
    """Only when nothing else was found and the signatures differ."""
    o, n = _s(o_sig), _s(n_sig)
    return F.when(
        (F.size(found) == 0) & (o != n),
        F.array(F.concat(F.lit("signature changed from "), go_quote(o), F.lit(" to "), go_quote(n))),
    ).otherwise(_empty())


def _tag(arr: Column, aspect: str) -> Column:
    return F.transform(arr, lambda d: F.struct(F.lit(aspect).alias("aspect"), d.alias("description")))


ASPECTS = ["kind", "params", "returns", "fields", "methods", "receiver", "signature"]


def compare_symbols(o="o", n="n") -> Column:
    """All sub-changes of one symbol pair as ``ARRAY<STRUCT<ord, aspect,
    description>>`` in the fixed order kind, params, returns, fields,
    methods, receiver, signature. ``o`` and ``n`` are struct columns (or
    their names)."""
    oc, nc = col_(o), col_(n)
    parts = [
        ("kind", cmp_kind(oc["kind"], nc["kind"])),
        ("params", cmp_params(oc["params"], nc["params"])),
        ("returns", cmp_returns(oc["returns"], nc["returns"])),
        ("fields", cmp_fields(oc["fields"], nc["fields"])),
        ("methods", cmp_methods(oc["methods"], nc["methods"])),
        ("receiver", cmp_receiver(oc["recv"], nc["recv"])),
    ]
    tagged = [_tag(arr, aspect) for aspect, arr in parts]
    def with_found(found):
        sig = _tag(cmp_signature(oc["signature"], nc["signature"], found), "signature")
        return F.transform(
            F.concat(found, sig),
            lambda c, i: F.struct(i.alias("ord"), c["aspect"].alias("aspect"), c["description"].alias("description")),
        )

    return let(F.concat(*tagged), with_found)
