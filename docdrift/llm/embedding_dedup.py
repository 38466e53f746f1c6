"""Near-duplicate vectors by PCA-ordered tiled comparison.

Distinct vectors are rotated so that leading dimensions carry the most of
their length (a rotation keeps every cosine), put in the order of the leading
one and packed into blocks of bounded bytes. Spark deals out squares of pairs of
blocks, so that a block travels once for each square, not for each pair; a task
takes the pairs whose bounds allow a cosine of the threshold and compares them
tile by tile. Of a tile the
products of the leading dimensions are taken first; the rest of each product
is at most the product of the two suffix norms, so most pairs stop there. The
others gain further dimensions and are bounded again, and what remains is
decided by the whole cosine in double precision.

Every pair of vectors is either bounded away or compared: nothing is missed.
The work is the square of the number of distinct vectors over a large constant
(a few nanoseconds a pair); a task returns link counts and a spanning forest,
never pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .components import components, stored
from .simhash import forest
from .tables import table

#: The query's contract.
COSINE = 0.9
#: Vectors and bytes of vectors in a block at most, blocks on a side of a square
#: at most; vectors in a tile's two sides; dimensions per step.
BLOCK, BLOCK_BYTES, SQUARE = 16_384, 8 << 20, 4
TILE, LEADING, NEXT = (1024, 4096), 16, 32
#: Vectors and bytes of vectors the rotation is fitted on at most (a bounded
#: sample by hash; it has an effect on speed only).
FITTED_ON, FITTED_BYTES = 20_000, 32 << 20
#: Rows in a stored file: of vectors, and of ids and numbers.
VECTORS_IN_FILE, ROWS_IN_FILE = 16_384, 262_144
#: Allowance for rounding in the single-precision bounds.
_SLACK = 1e-3
_GATHERED = 1 << 16


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, safe for very large and very small values."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the directions that carry most of the sample's
    length first."""
    unit = _unit(sample)
    _, columns = np.linalg.eigh(unit.T @ unit)
    return columns[:, ::-1]


def _bounds(unit: np.ndarray, turned: np.ndarray, dims: int) -> np.ndarray:
    """The leading ``dims`` rotated values and, last, the norm of the others:
    a product of two rows is the most their cosine can be."""
    rest = np.sqrt(np.maximum(0, 1 - (turned[:, :dims] ** 2).sum(axis=1, keepdims=True)))
    return np.concatenate([turned[:, :dims], rest], axis=1).astype(np.float32)


class Side:
    """One block ready for comparison."""

    def __init__(self, vectors: np.ndarray, basis: np.ndarray) -> None:
        self.unit = _unit(vectors)
        turned = self.unit @ basis
        width = vectors.shape[1]
        self.first = _bounds(self.unit, turned, min(LEADING, width))
        self.second = _bounds(self.unit, turned, min(NEXT, width))


def linked(a: Side, b: Side, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places ``(i, j)`` with a cosine of at least ``cosine``; for
    one block with itself each pair once."""
    for s in range(0, len(a.unit), TILE[0]):
        for t in range(0, len(b.unit), TILE[1]):
            if same and t + TILE[1] <= s:
                continue
            most = a.first[s : s + TILE[0]] @ b.first[t : t + TILE[1]].T
            i, j = np.nonzero(most >= cosine - _SLACK)
            i, j = i + s, j + t
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), _GATHERED):
                x, y = i[k : k + _GATHERED], j[k : k + _GATHERED]
                near = np.einsum("ij,ij->i", a.second[x], b.second[y]) >= cosine - _SLACK
                x, y = x[near], y[near]
                close = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= cosine
                if close.any():
                    yield x[close], y[close]


def _matrix(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8").reshape(-1, width)


def _may_link(a: dict, b: dict, cosine: float) -> bool:
    """Whether the blocks' extents allow a product of ``cosine``."""
    low, high, low2, high2 = (np.array(x) for x in (a["low"], a["high"], b["low"], b["high"]))
    most = np.max([low * low2, low * high2, high * low2, high * high2], axis=0).sum() + a["rest"] * b["rest"]
    return bool(most >= cosine - _SLACK)


def compare(own: list[dict], others: list[dict], basis: np.ndarray, cosine: float) -> tuple[np.ndarray, ...]:
    """Of the pairs between two lists of blocks, or within one (``others``
    empty): ``(node, linked rows)`` and a spanning forest ``(node, node)`` of
    the links between their vectors."""
    blocks = own + others
    ids = np.frombuffer(b"".join(x["ids"] for x in blocks), dtype="<i8")
    sizes = np.frombuffer(b"".join(x["sizes"] for x in blocks), dtype="<i8")
    sides = [Side(_matrix(x["vectors"], x["width"]), basis) for x in blocks]
    start = np.concatenate([[0], np.cumsum([len(x.unit) for x in sides])])
    links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
    for p in range(len(own)):
        for q in range(len(own), len(blocks)) if others else range(p, len(own)):
            if not _may_link(blocks[p], blocks[q], cosine):
                continue
            for i, j in linked(sides[p], sides[q], p == q, cosine):
                i, j = i + start[p], j + start[q]
                links += np.bincount(i, weights=sizes[j], minlength=len(ids)).astype(np.int64)
                links += np.bincount(j, weights=sizes[i], minlength=len(ids)).astype(np.int64)
                label = forest(len(ids), label, i, j)
    has, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
    return ids[has], links[has], ids[child], ids[label[child]]


BLOCKS = "width int, low array<double>, high array<double>, rest double, ids binary, sizes binary, vectors binary"


def _packed(basis: dict[int, np.ndarray], block_rows: int):
    """Sorted rows of a partition, packed into blocks of one width."""

    def block(width: int, rows: list[dict]) -> pa.RecordBatch:
        raw = b"".join(r["vec"] for r in rows)
        values = _unit(_matrix(raw, width)) @ basis.get(width, np.eye(width))
        lead = values[:, :LEADING]
        rest = np.sqrt(np.maximum(0, 1 - (lead**2).sum(axis=1))).max()
        columns = {
            "width": width, "low": lead.min(axis=0).tolist(), "high": lead.max(axis=0).tolist(), "rest": float(rest),
            "ids": np.array([r["cid"] for r in rows], dtype="<i8").tobytes(),
            "sizes": np.array([r["size"] for r in rows], dtype="<i8").tobytes(), "vectors": raw,
        }
        types = [pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(columns.values(), types, strict=True)], list(columns))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in (r for b in batches for r in b.to_pylist()):
            if held and (held[0]["width"] != row["width"] or len(held) == block_rows):
                yield block(held[0]["width"], held)
                held = []
            held.append(row)
        if held:
            yield block(held[0]["width"], held)

    return run


def embedding_dedup(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, block_rows: int = BLOCK,
    square: int = SQUARE,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable, itself included), ``kept``
    (``vec_id = component_id``).

    Rows link when their cosine, in double precision, is at least ``cosine``;
    equal vectors always do, repeated rows and ids included. A vector that is
    null, empty, zero, or holds null or non-finite values links with nothing,
    nor do vectors of different lengths with each other. Null ids belong to
    components but do not name them (``kept`` is then null). Other columns are
    ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column("v").to_pylist():
                good = v and None not in v
                x = np.array(v, dtype="<f8") if good else np.zeros(0)
                raw.append((x + 0.0).tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(raw, pa.binary())], ["vec_id", "vec"])

    vectors = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = vectors.mapInArrow(read, f"vec_id {kind}, vec binary")
    # Equal vectors are one node; they meet by digest, aggregated in the tasks first.
    marked = cut_lineage(rows.withColumn("key", F.unhex(F.md5("vec"))))
    nodes = stored(
        marked.where("key IS NOT NULL")
        .groupBy("key")
        .agg(F.max("vec").alias("vec"), F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
        .withColumn("cid", F.monotonically_increasing_id()),
        marked.count(),
        VECTORS_IN_FILE,
    )
    known, widest = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("vec")), F.lit(8))).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // widest))
    fitted_on = max(1, min(FITTED_ON, FITTED_BYTES // widest))
    sample = nodes.select("key", "vec").orderBy("key").limit(fitted_on).collect()  # the bounded sample
    by_width: dict[int, list[bytes]] = {}
    for r in sample:
        by_width.setdefault(len(r["vec"]) // 8, []).append(bytes(r["vec"]))
    basis = {w: rotation(_matrix(b"".join(v), w)) for w, v in by_width.items()}

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("vec").to_pylist()
            width = [len(x) // 8 for x in raw]
            lead = [float(_unit(_matrix(x, w))[0] @ basis[w][:, 0]) if w in basis else 0.0 for x, w in zip(raw, width, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(width, pa.int32()), pa.array(lead, pa.float64()), *(b.column(c) for c in ("cid", "size", "vec"))],
                ["width", "lead", "cid", "size", "vec"],
            )

    ordered = nodes.select("cid", "size", "vec").mapInArrow(placed, "width int, lead double, cid long, size long, vec binary")
    parts = max(1, -(-known // block_rows))
    packed = ordered.repartitionByRange(parts, "width", "lead").sortWithinPartitions("width", "lead")
    blocks = packed.select("width", "cid", "size", "vec").mapInArrow(_packed(basis, block_rows), BLOCKS)
    blocks = cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))
    found = cut_lineage(_compared(blocks, basis, cosine, square))

    links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b"), ROWS_IN_FILE).withColumnRenamed("node", "cid")
    rooted = nodes.select("key", "cid", "first_id", "size").join(roots, "cid", "left").join(links, "cid", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("root", "cid")), known, ROWS_IN_FILE)
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), known, ROWS_IN_FILE)
    n_links = (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links")
    named = stored(rooted.join(least, "root").select("key", "component_id", n_links), known, ROWS_IN_FILE)
    out = marked.select("vec_id", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _compared(blocks: DataFrame, basis: dict[int, np.ndarray], cosine: float, square: int) -> DataFrame:
    """``a, b, links``: link counts (``b`` null) and forests of all block pairs
    that the bounds allow."""
    # Consecutive numbers for the blocks: a row of some hundred bytes each.
    number = (F.row_number().over(Window.orderBy("block")) - 1).cast("long")
    short = cut_lineage(blocks.select("block", "width", "low", "high", "rest", number.alias("at")))
    count = short.count()
    # With few blocks, small squares keep many tasks at work.
    side = max(1, min(square, count // 8))
    last = F.lit(max(0, count - 1)).cast("long")
    one = short.withColumn("other_at", F.explode(F.sequence("at", last)))
    two = short.select(*(F.col(c).alias(f"{c}2") for c in short.columns))
    # The most that two vectors' products can be, from the blocks' extents.
    ends = F.arrays_zip("low", "high", "low2", "high2")
    most = F.aggregate(
        ends,
        F.lit(0.0),
        lambda s, x: s + F.greatest(x["low"] * x["low2"], x["low"] * x["high2"], x["high"] * x["low2"], x["high"] * x["high2"]),
    )
    pairs = one.join(two, F.col("other_at") == F.col("at2")).where("width = width2")
    pairs = pairs.where(most + F.col("rest") * F.col("rest2") >= cosine - _SLACK)
    # A block is sent to each square that holds a pair of it, once.
    p, q = (F.floor(F.col(c) / side).cast("long") for c in ("at", "at2"))
    ends = F.array(F.struct(F.col("block").alias("block"), p.alias("half")), F.struct(F.col("block2").alias("block"), q.alias("half")))
    sent = pairs.select(p.alias("p"), q.alias("q"), "width", F.explode(ends).alias("end"))
    sent = sent.select("p", "q", "width", "end.block", (F.col("end.half") == F.col("p")).alias("own")).distinct()
    dealt = sent.join(blocks.drop("width"), "block")

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["block"])
        own, others = [r for r in rows if r["own"]], [r for r in rows if not r["own"]]
        width = rows[0]["width"]
        node, links, x, y = compare(own, others, basis.get(width, np.eye(width)), cosine)
        none, empty = pa.nulls(len(node), pa.int64()), pa.nulls(len(x), pa.int64())
        return pa.concat_tables(
            [
                pa.table({"a": pa.array(node), "b": none, "links": pa.array(links)}),
                pa.table({"a": pa.array(x), "b": pa.array(y), "links": empty}),
            ]
        )

    return dealt.groupBy("p", "q", "width").applyInArrow(run, "a long, b long, links long")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))
