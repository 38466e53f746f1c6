"""The prefix trie of conversations, built by van Emde Boas recursion.

A conversation is the sequence of its turns' digests. All sequences are cut at
half depth; a cut prefix is named by a digest that follows from the name of
the prefix above it, so equal prefixes have equal names without meeting. The
upper halves are the sequences of the upper trie, the lower halves those of a
forest, one trie below each cut prefix, and both are again cut at half depth,
all tries of one height in the same Spark job. A sequence is one row with the
number of its conversations and the smallest of them, and equal ones are added
up at every cut, so what many conversations share is built once. After the last
cut a row is a node.

Totals are grafted upward: the weight of a forest below a cut prefix is added
to the forest that it hangs from, height by height, and what lies below a
prefix then follows from the coarsest cut to the finest.

Turns get their places by range partitioning (a conversation may be longer than
a task can take), and sequences longer than ``BLOCK`` turns are sequences of
blocks of turns, which are built first and then replaced by their turns. No
row holds more than ``BLOCK`` turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table, text_or_empty

#: Turns (or blocks) in one row at most; a power of two.
BLOCK = 1024
#: Ids in one piece of a list that is hashed.
PIECE = 4096
#: The query's contract: conversations that share an opening, and the number
#: of turns that it may have, less one.
EVERY, OPENINGS = 20, 4
# The names of the empty prefix and of an empty block.
ROOT, START = b"root", b"block"
_WORD = r"[^\x20\x09-\x0D]+"


def _digest(c: Column) -> Column:
    """128 bits of SHA-256: names of prefixes and turns."""
    return F.substring(F.unhex(F.sha2(c, 256)), 1, 16)


def _follow(start: Column, sequence: Column) -> Column:
    """The name of the prefix that ``sequence`` leads to from ``start``."""
    return F.aggregate(sequence, start, lambda name, e: _digest(F.concat(name, e["t"])))


def place_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, at, t, w, n`` for every turn with a conversation: its place from
    0 (by turn, null first; ties by digest), digest, number of words, and the
    conversation's number of turns. Stored; texts do not travel."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    turns = df.select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("t"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("w"),
    ).where("conv IS NOT NULL")
    order = ["conv", F.col("turn").asc_nulls_first(), "t"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.select("conv", "t", "w", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    # A conversation's turns are consecutive in a part; earlier parts come first.
    runs = dealt.groupBy("conv", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv")
    earlier = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "conv", "part", (F.col("first") - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("start"), F.sum("n").over(own).alias("n")
    )
    return cut_lineage(dealt.join(runs, ["conv", "part"]).select("conv", (F.col("row") - F.col("start")).alias("at"), "t", "w", "n"))


def share_openings(turns: DataFrame, every: int = EVERY, openings: int = OPENINGS) -> tuple[DataFrame, DataFrame]:
    """Conversations ``c`` with the first ``crc32(c) % openings`` turns of
    conversation ``c - c % every`` in place of their own: ``conv`` of all, and
    the placed turns ``conv, at, t, w``."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % openings
    base = F.col("conv") - F.col("conv") % every
    sizes = turns.where("at = 0").select("conv", "n")
    of_base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.select("conv", "n", h.alias("h"), base.alias("base")).join(of_base, "base", "left")
    convs = cut_lineage(convs.select("conv", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k")))
    # A conversation's row meets its turns in pieces, so that a long one is spread.
    pieces = convs.select("conv", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("n"), 10))).alias("piece"))
    own = turns.where(F.col("at") >= h).withColumn("piece", F.shiftright("at", 10)).join(pieces, ["conv", "piece"])
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("k")).alias("at"), "t", "w")
    heads = turns.where((F.col("conv") % every == 0) & (F.col("at") < openings - 1)).select(F.col("conv").alias("base"), "at", "t", "w")
    given = convs.where("k > 0").join(heads, "base").where("at < k").select("conv", "at", "t", "w")
    return convs.select("conv"), own.unionByName(given)


def _blocks(turns: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """One row per conversation with turns, ``conv, seg``, and the dictionaries
    (``t, below``) of the blocks that its elements stand for, coarsest first."""
    shift, dictionaries = block.bit_length() - 1, []
    while True:
        items = F.array_sort(F.collect_list(F.struct("at", "t", "w")))
        grouped = turns.groupBy("conv", F.shiftright("at", shift).alias("at")).agg(items.alias("s"))
        grouped = cut_lineage(grouped.select("conv", "at", F.transform("s", lambda e: F.struct(e["t"], e["w"])).alias("seg")))
        if grouped.where("at > 0").isEmpty():
            return grouped.select("conv", "seg"), dictionaries[::-1]
        named = grouped.withColumn("t", _follow(F.lit(START), F.col("seg")))
        dictionaries.append(cut_lineage(named.groupBy("t").agg(F.first("seg").alias("below"))))
        turns = named.select("conv", "at", "t", F.lit(0).cast("long").alias("w"))


def _with_cut(rows: DataFrame, half: int) -> DataFrame:
    """Add ``x``, the name of the prefix at which a row is cut next (null where
    it has no more than ``half`` elements)."""
    seg = F.col("seg")
    return rows.withColumn("x", F.when(F.size(seg) > half, _follow(F.col("r"), F.slice(seg, 1, half))) if half else F.lit(None).cast("binary"))


def _cut(rows: DataFrame, half: int, unit: int) -> DataFrame:
    """The upper and lower halves of all rows, equal ones added up."""
    seg, whole, is_cut = F.col("seg"), F.col("x").isNull(), F.col("x").isNotNull()
    upper = F.struct(
        F.coalesce("x", "end").alias("end"), F.col("r"), F.col("at"), F.slice(seg, 1, half).alias("seg"),
        F.when(whole, F.col("whole")).alias("whole"),
    )
    lower = F.struct(
        F.col("end"), F.col("x").alias("r"), (F.col("at") + half * unit).alias("at"),
        F.slice(seg, half + 1, F.greatest(F.size(seg) - half, F.lit(0))).alias("seg"), F.col("whole"),
    )
    pieces = rows.select("m", "least", F.explode(F.filter(F.array(upper, F.when(is_cut, lower)), lambda p: p.isNotNull())).alias("p"))
    return pieces.select("m", "least", "p.*").groupBy("end").agg(
        F.first("r").alias("r"), F.first("at").alias("at"), F.first("seg").alias("seg"),
        F.sum("m").alias("m"), F.min("least").alias("least"), F.max("whole").alias("whole"),
    )


def _height(rows: DataFrame) -> int:
    """The least power of two that no sequence is longer than."""
    most = rows.agg(F.max(F.size("seg")).alias("n")).first()["n"] or 1
    return 1 << (most - 1).bit_length()


def _build(sequences: DataFrame, dictionaries: list[DataFrame], block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The nodes (rows of one turn), and the rows before each cut, coarsest
    first."""
    rows, before = sequences, []
    for level in range(len(dictionaries) + 1):
        if level:
            full = F.size("below") == block  # its end has a name that others follow from
            rows = rows.withColumn("t", F.col("seg")[0]["t"]).drop("seg", "x").join(dictionaries[level - 1], "t").withColumnRenamed("below", "seg")
            rows = rows.withColumn("end", F.when(F.size("seg") == block, F.col("end")).otherwise(_follow(F.col("r"), F.col("seg")))).drop("t")
            rows = cut_lineage(rows)
        unit, half = block ** (len(dictionaries) - level), _height(rows) // 2
        rows = cut_lineage(_with_cut(rows, half))
        while half:
            before.append(rows)
            rows = cut_lineage(_with_cut(_cut(rows, half, unit), half // 2))
            half //= 2
    return rows, before


_TOTALS = ("leaves", "saved")


def _sums(*names: str) -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names or _TOTALS]


def _below(nodes: DataFrame, before: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Totals of what lies strictly below each node, ``end, leaves, saved``
    (without rows of nodes that have nothing below), and below the root."""
    forest = cut_lineage(nodes.groupBy(F.col("r").alias("top")).agg(*_sums()))
    forests = []
    for rows in reversed(before):
        forests.append(forest)
        hangs = rows.where("x IS NOT NULL").groupBy(F.col("x").alias("top")).agg(F.first("r").alias("r"))
        grafted = forest.join(hangs, "top", "left").groupBy(F.coalesce("r", "top").alias("top")).agg(*_sums())
        forest = cut_lineage(grafted)
    below = None
    for rows, hanging in zip(before, reversed(forests), strict=True):
        known = rows.select("end", "x")
        if below is None:
            known = known.withColumns({c: F.lit(0).cast("long") for c in _TOTALS})
        else:
            known = known.join(below, "end", "left")
        upper = F.struct(F.coalesce("x", "end").alias("end"), F.col("x").alias("cut"), *_TOTALS)
        lower = F.struct(F.col("end"), F.lit(None).cast("binary").alias("cut"), *_TOTALS)
        pieces = known.select(F.explode(F.when(F.col("x").isNull(), F.array(upper)).otherwise(F.array(upper, lower))).alias("p")).select("p.*")
        summed = pieces.groupBy("end").agg(F.max("cut").alias("cut"), *_sums())
        grafts = hanging.select(F.col("top").alias("cut"), *(F.col(c).alias(f"add_{c}") for c in _TOTALS))
        joined = summed.join(grafts, "cut", "left")
        below = joined.select("end", *((F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in _TOTALS))
    if below is None:
        below = nodes.select("end", *(F.lit(0).cast("long").alias(c) for c in _TOTALS))
    return below, forest.where(F.col("top") == ROOT)


def list_digests(members: DataFrame, piece: int = PIECE) -> DataFrame:
    """``whole, sha256`` of ``members(whole, conv)``: the SHA-256 of each
    group's ids as decimals, ascending, with commas between. Ids are ordered
    and joined in ranges; the last step reads the joined pieces of a group one
    at a time."""

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([group], pa.binary()), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["whole", "first", "ids"]
            )

        for batch in batches:
            for whole, conv in zip(batch.column("whole").to_pylist(), batch.column("conv").to_pylist(), strict=True):
                if ids and (whole != group or len(ids) == piece):
                    yield out()
                    ids = []
                group = whole
                ids.append(conv)
        if ids:
            yield out()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["whole", "sha256"]
            )

        for batch in batches:
            done = []
            for whole, ids in zip(batch.column("whole").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if whole == group:
                    state.update(b"," + ids.encode())
                    continue
                if state:
                    done.append((group, state.hexdigest()))
                group, state = whole, hashlib.sha256(ids.encode())
            if done:
                yield out(done)
        if state:
            yield out([(group, state.hexdigest())])

    ordered = members.select("whole", "conv").repartitionByRange("whole", "conv").sortWithinPartitions("whole", "conv")
    pieces = ordered.mapInArrow(joined, "whole binary, first long, ids string")
    return pieces.repartition("whole").sortWithinPartitions("whole", "first").mapInArrow(hashed, "whole binary, sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of placed ``turns(conv, at, t, w)`` of the
    distinct ``convs(conv)``: ``conv_id`` (its smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens`` and
    ``ends_sha256`` (of the ids of the conversations that end there).

    Places run from 0 without gaps. Conversations without turns end at the
    root. No conversations give no rows, not even the root.
    """
    per_conv, dictionaries = _blocks(turns, block)
    whole = cut_lineage(per_conv.withColumn("whole", _follow(F.lit(ROOT), F.col("seg"))))
    members = convs.join(whole.select("conv", "whole"), "conv", "left").select("conv", F.coalesce("whole", F.lit(ROOT)).alias("whole"))
    members = cut_lineage(members)
    sequences = whole.groupBy("whole").agg(F.first("seg").alias("seg"), F.count(F.lit(1)).alias("m"), F.min("conv").alias("least"))
    sequences = sequences.select(
        F.col("whole").alias("end"), F.lit(ROOT).alias("r"), F.lit(0).cast("long").alias("at"), "seg", "m", "least", "whole"
    )
    rows, before = _build(sequences, dictionaries, block)

    root = members.agg(F.count(F.lit(1)).alias("m"), F.min("conv").alias("least")).where("m > 0").select(
        F.lit(ROOT).alias("end"), F.lit(None).cast("binary").alias("r"), F.lit(0).cast("long").alias("depth"),
        "m", "least", F.lit(ROOT).alias("whole"), F.lit(0).cast("long").alias("w"),
    )
    nodes = rows.select("end", "r", (F.col("at") + 1).alias("depth"), "m", "least", "whole", F.col("seg")[0]["w"].alias("w"))
    children = nodes.groupBy(F.col("r").alias("end")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.unionByName(root).join(children, "end", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("m") - 1) * F.col("w"))
    nodes = cut_lineage(nodes)
    below, under_root = _below(nodes.where("r IS NOT NULL"), before)
    under = below.unionByName(under_root.withColumnRenamed("top", "end")).select("end", *(F.col(c).alias(f"below_{c}") for c in _TOTALS))
    parents = nodes.where("n_children > 0").select(F.col("end").alias("r"), F.col("least").alias("parent_conv_id"))
    total = {c: F.col(c) + F.coalesce(f"below_{c}", F.lit(0)) for c in _TOTALS}
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(under, "end", "left").join(list_digests(members), "whole", "left").join(parents, "r", "left")
        .select(
            F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("m").alias("n_convs"), "n_children",
            total["leaves"].alias("n_leaves"), total["saved"].alias("saved_tokens"), F.coalesce("sha256", nothing).alias("ends_sha256"),
        )
    )


def conversation_trie(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``prefix_trie`` of a table of turns.

    Turns are ordered by ``turn`` (null first; equal ones by the digest of role
    and text); null roles and texts count as empty, and a repeated row is a
    further turn. Rows with a null id belong to no conversation. Texts are
    hashed whole. Other columns are ignored. An empty table gives an empty
    result."""
    turns = place_turns(df, id_col, turn_col, role_col, text_col)
    return prefix_trie(turns.where("at = 0").select("conv"), turns.drop("n"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs, turns = share_openings(place_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie(convs, turns)
