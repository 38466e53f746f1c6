"""Near-duplicates by SimHash, found with a binary trie joined with itself.

Fingerprints are 64-bit. The distinct ones are the leaves of a binary trie;
pairs of trie nodes are traversed together, the bits in which they differ are
added up, and a pair is dropped as soon as its sum exceeds the error budget.

The budget has a schedule. Two fingerprints that differ in at most ``k`` bits
differ in at most ``k // 2`` bits of one of their halves. So there are two
tries, one for each half in front, and each allows ``k // 2`` errors down to
depth 32 and ``k`` below: every pair within ``k`` bits survives in one of them.

Spark deals out the node pairs at some depth (fingerprints go to the pairs
their node is in; a pair too large for a task is replaced by the pairs of its
children, some levels down, until it is small enough), and each task traverses
its pairs on sorted arrays. A task returns a spanning forest of the links it
found, never all pairs, so a group of thousands of near copies costs a row per
fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components
from .tables import power_of_two, table, whole_row

#: The query's contract: words in a shingle, bits two fingerprints may differ in.
SHINGLE, MAX_BITS = 3, 3
SEED = 42
#: Fingerprints of a trie node that one task holds, and levels by which a
#: larger one is taken apart.
NODE_ROWS, LEVELS = 8192, 4
#: Shingles hashed at a time, node pairs and comparisons held at a time.
_HASHED, _PAIRS = 1 << 16, 1 << 19

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z only; ASCII white space
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1].tolist()
    stops = ends[size - 1 :].tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _HASHED):
        spans = zip(starts[i : i + _HASHED], stops[i : i + _HASHED], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        columns = hashes.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(columns[:, k], minlength=256) @ _BYTE_BITS
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a (signed) long; null text counts as empty."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:  # one text at a time as a Python string
            values = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.array(values.view(np.int64))

    return prints(text.cast("string"))


def forest(count: int, label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``label`` (a root per place) after joining the places ``left[i]`` and
    ``right[i]``; roots are the smallest places of their groups."""
    while True:
        a, b = label[left], label[right]
        differ = a != b
        if not differ.any():
            return label
        left, right, a, b = left[differ], right[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def trie_links(a: np.ndarray, b: np.ndarray, same: bool, depth: int, budget: list[int]) -> Iterator[tuple]:
    """Traverse the nodes with leaves ``a`` and ``b`` (sorted, distinct, with
    equal leading ``depth`` bits each) together. Yields blocks of places
    ``(i, j)`` whose leaves differ in at most ``budget[64]`` bits; for
    ``same`` nodes, each pair once."""
    if not len(a) or not len(b):
        return
    error = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0
    if error > budget[depth]:
        return
    stack = [(depth, *(np.array([x]) for x in (0, len(a), 0, len(b), error)))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > _PAIRS // 4:
            half = len(al) // 2
            stack += [(depth, *(x[:half] for x in (al, ah, bl, bh, err))), (depth, *(x[half:] for x in (al, ah, bl, bh, err)))]
            continue
        leaf = ((ah - al) * (bh - bl) <= 64) | (depth == 64)
        yield from _compared(a, b, same, budget[64], al[leaf], ah[leaf], bl[leaf], bh[leaf])
        al, ah, bl, bh, err = (x[~leaf] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        above = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        am = np.searchsorted(a, (a[al] & above) | bit)
        bm = np.searchsorted(b, (b[bl] & above) | bit)
        mirror = same & (al == bl) & (ah == bh)
        allowed = err < budget[depth + 1]
        children = (
            (al, am, bl, bm, err, np.ones(len(al), dtype=bool)),
            (am, ah, bm, bh, err, np.ones(len(al), dtype=bool)),
            (al, am, bm, bh, err + 1, allowed),
            (am, ah, bl, bm, err + 1, allowed & ~mirror),
        )
        kept = [[x[c[5] & (c[0] < c[1]) & (c[2] < c[3])] for x in c[:5]] for c in children]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def _compared(a, b, same, most, al, ah, bl, bh) -> Iterator[tuple]:
    """Pairs of leaves below small node pairs, compared in full."""
    sizes = (ah - al) * (bh - bl)
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(sizes) // _PAIRS)) + 1, [len(sizes)]])
    for s, e in zip(cuts[:-1], cuts[1:], strict=True):
        n = sizes[s:e]
        if not n.sum():
            continue
        pair = np.repeat(np.arange(s, e), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (bh - bl)[pair]
        i, j = al[pair] + k // width, bl[pair] + k % width
        close = np.bitwise_count(a[i] ^ b[j]) <= most
        if same:
            close &= i < j
        if close.any():
            yield i[close], j[close]


def _masks(bits: int, most: int) -> list[int]:
    """Every value of ``bits`` bits with at most ``most`` ones."""
    return [sum(1 << i for i in ones) for k in range(min(most, bits) + 1) for ones in combinations(range(bits), k)]


def _front(depth: int) -> Column:
    """The leading ``depth`` bits of ``v``."""
    return F.shiftrightunsigned("v", 64 - depth) if depth else F.lit(0).cast("long")


def _descend(rows: DataFrame, depth: int, levels: int, budget: list[int]) -> DataFrame:
    """Deal the rows of node pairs ``(trie, lo, hi)`` at ``depth`` out to the
    pairs of their children ``levels`` further down, within the budget."""
    below = depth + levels
    own = _front(below)
    other = F.when(_front(depth) == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    low = own.bitwiseAND(F.lit((1 << levels) - 1))
    masks = [m for m in _masks(levels, budget[below])]
    partner = [
        F.struct(
            F.shiftleft(other, levels).bitwiseOR(low.bitwiseXOR(F.lit(m))).alias("node"), F.lit(m.bit_count()).alias("cost")
        )
        for m in masks
    ]
    spent = F.bit_count(F.col("lo").bitwiseXOR(F.col("hi")))
    within = F.filter(F.array(*partner), lambda x: x["cost"] + spent <= budget[below])
    dealt = rows.select("trie", "v", own.alias("own"), F.explode(within).alias("x"))
    return dealt.select(
        "trie", F.least("own", "x.node").alias("lo"), F.greatest("own", "x.node").alias("hi"), "v"
    )


def _traverse(rows: DataFrame, depth: int, budget: list[int]) -> DataFrame:
    """A spanning forest of the links in each node pair's rows."""

    def links(key: tuple, leaves: pd.DataFrame) -> pd.DataFrame:
        trie, lo, hi = key
        values = np.unique(leaves["v"].to_numpy().view(np.uint64))
        front = (values >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(values), dtype=np.int64)
        a, b = values[front == lo], values[front == hi]
        shift = 0 if lo == hi else len(a)
        places = a if lo == hi else np.concatenate([a, b])
        label = np.arange(len(places))
        for i, j in trie_links(a, b, lo == hi, depth, budget):
            label = forest(len(places), label, i, j + shift)
        child = np.flatnonzero(label != np.arange(len(places)))
        if trie:  # back to the fingerprint's own order of halves
            places = (places << np.uint64(32)) | (places >> np.uint64(32))
        signed = places.view(np.int64)
        return pd.DataFrame({"a": signed[child], "b": signed[label[child]]})

    return rows.groupBy("trie", "lo", "hi").applyInPandas(links, "a long, b long")


def fingerprint_links(
    prints: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS, levels: int = LEVELS
) -> DataFrame:
    """Links ``a, b`` between the distinct fingerprints of ``prints(fp)`` that
    connect all pairs within ``max_bits`` bits of each other, directly or
    through others (a spanning forest for each node pair)."""
    budget = [max_bits // 2] * 33 + [max_bits] * 32
    depth = min(32, power_of_two(prints.count() / node_rows).bit_length() - 1)
    halves = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    leaves = prints.select(F.explode(F.array(F.struct(F.lit(0).alias("trie"), F.col("fp").alias("v")), F.struct(F.lit(1).alias("trie"), halves.alias("v")))).alias("x")).select("x.*")
    root = leaves.select("trie", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "v")
    rows = _descend(root, 0, depth, budget) if depth else root
    found = None
    while depth < 64:
        crowded = cut_lineage(
            rows.groupBy("trie", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * node_rows).drop("n")
        )
        last = crowded.isEmpty()
        light = rows if last else rows.join(crowded, ["trie", "lo", "hi"], "left_anti")
        part = _traverse(light, depth, budget)
        found = part if found is None else found.unionByName(part)
        if last:
            break
        step = min(levels, 64 - depth)
        rows = cut_lineage(_descend(rows.join(crowded, ["trie", "lo", "hi"], "left_semi"), depth, step, budget))
        depth += step
    return found


def simhash_groups(marked: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """``fp, root, component_id`` for the fingerprints of a stored table
    ``marked(doc_id, fp)``: one fingerprint that stands for all reachable over
    links of at most ``max_bits`` differing bits, and their smallest id. Ids
    that are null are not chosen; a component of null ids only has the null
    id."""
    firsts = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    linked = cut_lineage(components(fingerprint_links(firsts.select("fp"), max_bits, node_rows)))
    rooted = firsts.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    rooted = cut_lineage(rooted)
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return cut_lineage(rooted.join(least, "root").select("fp", "root", "component_id"))


def simhash_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hexadecimal digits),
    ``component_id``.

    Null and empty texts, and texts of white space, have fingerprint zero and
    are linked like any other. A text of fewer words than a shingle is one
    shingle. Texts are hashed whole. Repeated rows each give a row and share a
    component; rows with a null id belong to components but do not name them.
    Other columns are ignored. An empty table gives an empty result.
    """
    marked = cut_lineage(df.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), shingle).alias("fp")))
    groups = simhash_groups(marked, max_bits, node_rows)
    return marked.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """The input's rows and columns, one row of each near-duplicate component:
    the one with the smallest id (null ids last; one of rows that tie). Texts
    are treated as in ``simhash_dedup``; columns of any name are kept."""
    stored = cut_lineage(
        df.select(
            whole_row(),
            F.col(id_col).alias("doc_id"),
            fingerprint_column(F.col(text_col), shingle).alias("fp"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    thin = stored.select("doc_id", "fp", "rid")
    marked = cut_lineage(thin.join(simhash_groups(thin, max_bits, node_rows), "fp").select("root", "doc_id", "rid"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    first = cut_lineage(marked.groupBy("root").agg(F.min(order).alias("best")).select("root", F.col("best.rid").alias("keep")))
    dropped = cut_lineage(marked.join(first, "root").where("rid <> keep").select("rid"))
    return stored.join(dropped, "rid", "left_anti").select("row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
