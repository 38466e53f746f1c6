"""Keyed snapshot diff.

``snapshot_diff`` compares two versions of any keyed table with ONE full
outer equi-join. ``symbol_diff`` specialises it to declaration tables: the
nested comparison runs as array expressions on the joined row, then rename
pairing (``detect_renames``) turns removed/added pairs of equal shape into
renamed rows.

Plan shape: each side is de-duplicated by ``groupBy(keys)`` (partial
aggregation map-side) which leaves it hash-partitioned on the keys, so the
full outer join that follows adds no further exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, memo_column
from ..session import cut_lineage
from .nested import compare_symbols

# Declaration kind labels by ordinal, and change kinds by ordinal.
KIND_LABELS = ["func", "method", "struct", "interface", "type alias", "type", "const", "var"]
CHANGE_LABELS = ["added", "removed", "modified", "renamed"]

SYMBOL_KEYS = ["repo", "path", "name"]


def kind_label(ordinal) -> Column:
    """Declaration kind label for an ordinal, ``unknown`` otherwise."""
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in KIND_LABELS]), c.cast("int") + 1), F.lit("unknown"))


def change_label(ordinal) -> Column:
    """Change kind label for an ordinal, ``unknown`` otherwise."""
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in CHANGE_LABELS]), c.cast("int") + 1), F.lit("unknown"))


def dedupe_last(df: DataFrame, keys: list[str], order_col: str = "ordinal") -> DataFrame:
    """Keep the row with the highest ``order_col`` per key (last wins).

    ``max_by`` is an aggregate, so duplicates are collapsed map-side before
    the shuffle; a key that holds many copies never lands whole in one task.
    """
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(packed, F.col(order_col)).alias("_last"))
        .select(*keys, *[F.col("_last")[c].alias(c) for c in others])
    )


def snapshot_diff(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    compare_cols: list[str],
    order_col: str | None = None,
    keep_unchanged: bool = False,
) -> DataFrame:
    """D5 (generic): one full outer join on ``keys``.

    Output: keys, ``change``, ``change_ord``, ``changed_cols`` (names of the
    compared columns that differ), and ``old_<c>`` / ``new_<c>`` per compared
    column. Comparison is null-safe.
    """
    if order_col is not None:
        old = dedupe_last(old, keys, order_col)
        new = dedupe_last(new, keys, order_col)
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in compare_cols], F.lit(True).alias("_o"))
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in compare_cols], F.lit(True).alias("_n"))
    j = o.join(n, keys, "full_outer")
    diff_cols = F.filter(
        F.array(*[F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in compare_cols]),
        lambda x: x.isNotNull(),
    )
    change_ord = (
        F.when(F.col("_o").isNull(), 0)
        .when(F.col("_n").isNull(), 1)
        .when(F.size(diff_cols) > 0, 2)
    )
    out = j.withColumn("change_ord", change_ord).withColumn("changed_cols", diff_cols)
    if not keep_unchanged:
        out = out.filter(F.col("change_ord").isNotNull())
    return out.select(
        *keys,
        change_label("change_ord").alias("change"),
        F.col("change_ord"),
        F.when(F.col("change_ord") == 2, F.col("changed_cols"))
        .otherwise(F.array().cast("array<string>"))
        .alias("changed_cols"),
        *[F.col(f"old_{c}") for c in compare_cols],
        *[F.col(f"new_{c}") for c in compare_cols],
    )


def diff_added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``old``."""
    return new.join(old.select(*keys), keys, "left_anti")


def diff_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """D3: rows of ``old`` whose key is absent from ``new``."""
    return old.join(new.select(*keys), keys, "left_anti")


def diff_modified(old: DataFrame, new: DataFrame, keys: list[str], compare_cols: list[str]) -> DataFrame:
    """Inner join, keep keys where any compared column differs."""
    o = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in compare_cols])
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in compare_cols])
    cond = reduce(lambda a, b: a | b, [~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compare_cols])
    return o.join(n, keys, "inner").filter(cond)


# --- declaration diff -------------------------------------------------------

_CMP_FIELDS = ["kind", "signature", "recv", "params", "returns", "fields", "methods"]


_SYMBOL_DEFAULTS = {
    "repo": ("string", ""),
    "path": ("string", ""),
    "ordinal": ("bigint", 0),
    "name": ("string", ""),
    "kind": ("string", "unknown"),
    "signature": ("string", ""),
    "doc": ("string", ""),
    "recv": ("string", ""),
    "params": ("array<struct<name:string,type:string>>", None),
    "returns": ("array<struct<name:string,type:string>>", None),
    "fields": ("array<struct<name:string,type:string,doc:string>>", None),
    "methods": ("array<struct<name:string,type:string,doc:string>>", None),
    "grp": ("string", ""),
}


def _normalise_symbols(df: DataFrame) -> DataFrame:
    """Coalesce every declaration column to its empty value (Go has no null
    strings); missing optional columns are added empty."""
    cols = []
    for c, (t, default) in _SYMBOL_DEFAULTS.items():
        empty = F.array().cast(t) if default is None else F.lit(default).cast(t)
        src = F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t)
        cols.append(F.coalesce(src, empty).alias(c))
    return df.select(*cols)


def shape_key(sym: str = "sym") -> Column:
    """What must be equal for a removed/added pair to count as a rename:
    kind, receiver, parameter types, result types, field names and types.
    Hashed (SHA-256 of its JSON) so it is a compact join/partition key."""
    return _shape(F.col(sym))


def _shape(s: Column) -> Column:
    shape = F.struct(
        s["kind"].alias("k"),
        s["recv"].alias("r"),
        F.transform(s["params"], lambda p: p["type"]).alias("p"),
        F.transform(s["returns"], lambda p: p["type"]).alias("q"),
        F.transform(s["fields"], lambda f: F.struct(f["name"].alias("n"), f["type"].alias("t"))).alias("f"),
    )
    return F.sha2(F.to_json(shape), 256)


def _cmp_view(sym: Column) -> Column:
    # the parts compareSymbols looks at (docs and group are ignored)
    return F.struct(
        sym["kind"],
        sym["signature"],
        sym["recv"],
        sym["params"],
        sym["returns"],
        F.transform(sym["fields"], lambda f: F.struct(f["name"], f["type"])),
        F.transform(sym["methods"], lambda f: F.struct(f["name"], f["type"])),
    )


def symbol_diff(
    old_symbols: DataFrame,
    new_symbols: DataFrame,
    renames: bool = True,
    ranges: int | None = None,
    strict_renames: bool = False,
    failed: DataFrame | None = None,
) -> DataFrame:
    """D5 + D8 for declaration tables keyed by ``(repo, path, name)``.

    Returns ``repo, path, name, old_name, change, change_ord, kind,
    signature, old_signature, changes, shape, parse_failed``. ``kind`` /
    ``signature`` describe the symbol as it is now (the old one for removed
    rows).

    ``failed(repo, path, side)`` names the files whose ``old`` or ``new``
    version could not be read. What such a side does not hold is unknown rather
    than absent: rows that are added or removed only because of it have
    ``parse_failed`` and are not paired as renames. With ``strict_renames``
    only symbols with a parameter, result, field or receiver are paired.
    """
    o = dedupe_last(_normalise_symbols(old_symbols), SYMBOL_KEYS)
    n = dedupe_last(_normalise_symbols(new_symbols), SYMBOL_KEYS)
    vals = [c for c in o.columns if c not in SYMBOL_KEYS]
    o = o.select(*SYMBOL_KEYS, F.struct(*vals).alias("o"))
    n = n.select(*SYMBOL_KEYS, F.struct(*vals).alias("n"))
    j = o.join(n, SYMBOL_KEYS, "full_outer")

    empty = F.array().cast("array<struct<ord:int,aspect:string,description:string>>")

    def classify(x):
        o_, n_ = x["o"], x["n"]
        both = o_.isNotNull() & n_.isNotNull()
        changes = F.when(both & (_cmp_view(o_) != _cmp_view(n_)), compare_symbols(o_, n_)).otherwise(empty)

        def with_changes(ch):
            change_ord = F.when(o_.isNull(), 0).when(n_.isNull(), 1).when(F.size(ch) > 0, 2)
            return F.struct(ch.alias("changes"), change_ord.alias("change_ord"))

        return let(changes, with_changes)

    # the comparison runs once per pair (``let``), also where a filter on
    # its result is pushed below this projection
    j = j.select(*SYMBOL_KEYS, "o", "n", memo_column("symbol_classify", lambda: let(F.struct("o", "n"), classify)).alias("_r"))
    j = j.select(*SYMBOL_KEYS, "o", "n", F.col("_r.changes").alias("changes"), F.col("_r.change_ord").alias("change_ord"))
    j = j.filter(F.col("change_ord").isNotNull())
    sym = F.when(F.col("change_ord") == 1, F.col("o")).otherwise(F.col("n"))
    unknown = F.lit(False)
    if failed is not None:
        sides = failed.groupBy("repo", "path").agg(*[F.max(F.col("side") == side).alias(f"_{side}_failed") for side in ("old", "new")])
        j = j.join(sides, ["repo", "path"], "left")
        unknown = ((F.col("change_ord") == 0) & F.col("_old_failed")) | ((F.col("change_ord") == 1) & F.col("_new_failed"))
    has_shape = (F.size(sym["params"]) + F.size(sym["returns"]) + F.size(sym["fields"]) > 0) | (sym["recv"] != "")
    diffs = j.select(
        *SYMBOL_KEYS,
        F.coalesce(unknown, F.lit(False)).alias("parse_failed"),
        (has_shape if strict_renames else F.lit(True)).alias("_pairs"),
        F.lit("").alias("old_name"),
        F.col("change_ord"),
        sym["kind"].alias("kind"),
        sym["signature"].alias("signature"),
        F.when(F.col("change_ord") == 0, F.lit("")).otherwise(F.col("o")["signature"]).alias("old_signature"),
        F.col("changes"),
        F.when(F.col("change_ord") < 2, _shape(sym)).alias("shape"),
    )
    if renames:
        diffs = detect_renames(diffs, ranges)
    return diffs.select(
        *SYMBOL_KEYS,
        "old_name",
        change_label("change_ord").alias("change"),
        "change_ord",
        "kind",
        "signature",
        "old_signature",
        "changes",
        "shape",
        "parse_failed",
    )


_CLASS = ["repo", "path", "shape"]
_DIFF_COLS = ["repo", "path", "name", "old_name", "change_ord", "kind", "signature", "old_signature", "changes", "shape", "parse_failed"]


def _ranked(cand: DataFrame) -> DataFrame:
    """Add ``_rn``: a row's rank by name among the removed (or the added) rows
    of its class. ``cand`` is stored and has ``_part``, its range in the order
    of class, side and name, so the rank is the number of such rows in earlier
    ranges (a row per range and class) plus the rank inside the range: no task
    holds more of a class than a range does."""
    side = [*_CLASS, "change_ord"]
    inside = F.row_number().over(Window.partitionBy("_part", *side).orderBy("name"))
    counts = cand.groupBy("_part", *side).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy(*side).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", *side, F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    return cand.withColumn("_in", inside).join(before, ["_part", *side]).withColumn("_rn", F.col("_before") + F.col("_in"))


def detect_renames(diffs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Removed and added rows of equal shape in the same file become one
    renamed row; each row is used at most once.

    Shape equality is an equivalence relation, so greedy pairing equals rank
    pairing inside each ``(repo, path, shape)`` class: the i-th removed row by
    name pairs with the i-th added row by name, whatever the size of the
    class and the number of ``ranges`` it is spread over. Rows with
    ``parse_failed``, and those whose ``_pairs`` is false, stay as they are."""
    order = [*_CLASS, "change_ord", "name"]
    dealt = diffs.repartitionByRange(ranges, *order) if ranges else diffs.repartitionByRange(*order)
    # read by the unchanged rows, the counts and the pairing: stored once
    diffs = cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))
    may_pair = (F.col("change_ord") < 2) & F.col("_pairs") & ~F.col("parse_failed")
    rest = diffs.filter(~may_pair)
    row = F.struct(*_DIFF_COLS)
    paired = _ranked(diffs.filter(may_pair)).groupBy(*_CLASS, "_rn").agg(
        F.first(F.when(F.col("change_ord") == 1, row), ignorenulls=True).alias("rem"),
        F.first(F.when(F.col("change_ord") == 0, row), ignorenulls=True).alias("add"),
    )
    renamed = F.struct(
        F.col("add.repo").alias("repo"),
        F.col("add.path").alias("path"),
        F.col("add.name").alias("name"),
        F.col("rem.name").alias("old_name"),
        F.lit(3).alias("change_ord"),
        F.col("add.kind").alias("kind"),
        F.col("add.signature").alias("signature"),
        F.col("rem.old_signature").alias("old_signature"),
        F.col("add.changes").alias("changes"),
        F.col("add.shape").alias("shape"),
        F.lit(False).alias("parse_failed"),
    )
    both = F.col("rem").isNotNull() & F.col("add").isNotNull()
    out = paired.select(F.when(both, renamed).otherwise(F.coalesce("rem", "add")).alias("r")).select("r.*")
    return rest.select(*_DIFF_COLS).unionByName(out.select(*_DIFF_COLS))


def order_diffs(diffs: DataFrame) -> DataFrame:
    """A1: deterministic order - file, change ordinal, name."""
    return diffs.orderBy("repo", "path", "change_ord", "name")


def change_counts(diffs: DataFrame) -> DataFrame:
    """Number of diffs per repository and change kind."""
    return diffs.groupBy("repo", "change").agg(F.count(F.lit(1)).alias("n"))
