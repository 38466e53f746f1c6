"""Hard negatives by exact integer products of Kronecker-packed candidates.

A candidate's components are biased to be non-negative, and those of several
candidates are put into separated fields of one wide integer: wide enough that
a field's sum over all components cannot reach the next field. One
multiplication per anchor component then serves all of them, and the fields of
the total, less what the biases added, are exact scores. Where two or more
fields fit, the wide integer is the 53-bit integer range of a double, whose
products and sums are exact there and run as one matrix product; for larger
components it is a Python integer that holds a whole tile of candidates.

Anchors are a stated query set that meets all rows in blocks. Both sides are
dealt into buckets by row number, and Spark brings each pair of buckets
together (``cogroup``): a bucket is bounded in bytes, so a task's memory is
too, and a vector travels once per bucket of the other side. The best
positives and negatives of a bucket pair are found in the task (a few rows per
anchor) and merged by ranking windows per anchor. The first pass multiplies
anchors with the candidates of their own label only, the second with all.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table

#: The query's contract.
SCALE, POSITIVES, NEGATIVES, WINDOW = 256, 5, 3, (50, 95)
#: Bytes of vectors in a bucket: at most the first; no fewer than the second
#: only to have so many buckets that the work spreads.
BUCKET, SMALL_BUCKET, BUCKETS = 32 << 20, 1 << 20, 64
#: Candidates in a tile, and anchors in one matrix product.
TILE, AT_ONCE = 2048, 256
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)
_EXACT = 52  # bits of a double's integers, one left over


class Packed:
    """A tile of candidates (rows of integers held in doubles) in wide
    integers, for anchors whose components are between ``low`` and ``high``."""

    def __init__(self, rows: np.ndarray, low: int, high: int) -> None:
        self.count, self.width = rows.shape
        self.shift = max(0, -low)  # makes anchors non-negative
        self.bias = max(0, -int(rows.min(initial=0)))
        top = int(rows.max(initial=0)) + self.bias
        bits = max(1, (top * (high + self.shift) * self.width).bit_length())
        self.fields = _EXACT // bits
        if self.fields >= 2:
            self.bits = bits
            words = -(-self.count // self.fields)
            biased = np.zeros((words * self.fields, self.width))
            biased[: self.count] = rows + self.bias
            self.own = biased[: self.count].sum(axis=1)
            grouped = biased.reshape(words, self.fields, self.width)
            self.words = sum(grouped[:, f] * 2.0 ** (bits * f) for f in range(self.fields))
        else:
            self.size = -(-bits // 8)  # bytes of a field
            biased = [[int(v) + self.bias for v in r] for r in rows.tolist()]
            self.own = [sum(r) for r in biased]
            self.words = [int.from_bytes(b"".join(v.to_bytes(self.size, "little") for v in c), "little") for c in zip(*biased, strict=True)]

    def scores(self, anchors: np.ndarray) -> Iterator[np.ndarray]:
        """The exact inner products of each anchor with the tile's candidates,
        as longs (cut to the ends of the range where they are beyond it)."""
        if self.fields >= 2:
            extra = self.shift * self.own.astype(np.int64) - self.width * self.shift * self.bias
            for k in range(0, len(anchors), AT_ONCE):
                shifted = anchors[k : k + AT_ONCE] + self.shift
                total = (shifted @ self.words.T).astype(np.int64)
                split = [(total >> (self.bits * f)) & ((1 << self.bits) - 1) for f in range(self.fields)]
                raw = np.stack(split, axis=2).reshape(len(shifted), -1)[:, : self.count]
                yield from raw - extra - self.bias * shifted.sum(axis=1).astype(np.int64)[:, None]
            return
        for anchor in anchors.tolist():
            shifted = [int(v) + self.shift for v in anchor]
            raw = sum(map(mul, shifted, self.words)).to_bytes(self.size * self.count, "little")
            fields = (int.from_bytes(raw[i : i + self.size], "little") for i in range(0, len(raw), self.size))
            constant = self.width * self.shift * self.bias - self.bias * sum(shifted)
            exact = (x - self.shift * o + constant for x, o in zip(fields, self.own, strict=True))
            yield np.array([min(_MOST, max(_LEAST, x)) for x in exact], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best: higher scores first, then smaller ids."""
    places = np.arange(len(scores))
    if len(scores) > most:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[-most])
    return places[np.lexsort((ids[places], -scores[places].astype(object) if scores.min(initial=0) == _LEAST else -scores[places]))][:most]


class Side:
    """One bucket's rows as arrays, their labels as places in ``labels``. Null
    ids come last among equal scores."""

    def __init__(self, rows: pa.Table, width: int, labels: dict[str, int]) -> None:
        rows = rows.combine_chunks()
        self.rid = rows.column("rid").to_numpy()
        null = rows.column("id").is_null().to_numpy(zero_copy_only=False)
        self.id = np.where(null, _MOST, rows.column("id").fill_null(0).to_numpy())
        self.null = null
        self.label = np.array([labels.setdefault(x, len(labels)) for x in rows.column("label").to_pylist()])
        self.vectors = np.frombuffer(b"".join(rows.column("vec").to_pylist()), dtype="<f8").reshape(len(self.rid), width)

    def tiles(self, places: np.ndarray) -> Iterable[np.ndarray]:
        return (places[k : k + TILE] for k in range(0, len(places), TILE))

    def id_of(self, place: int) -> int | None:
        return None if self.null[place] else int(self.id[place])


def _ends(anchors: np.ndarray) -> tuple[int, int]:
    return int(anchors.min(initial=0)), int(anchors.max(initial=0))


FOUND = "rid long, place int, positive_id long, positive_score long, found_id long, found_rid long, score long"


def _found(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in FOUND.split(", ")]
    kinds = [pa.int32() if c == "place" else pa.int64() for c in names]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def positives_of(anchors: Side, rows: Side, most: int) -> Iterator[tuple]:
    """Each anchor's best other rows of its own label."""
    by_label, anchors_by_label = np.argsort(rows.label, kind="stable"), np.argsort(anchors.label, kind="stable")
    for label in np.unique(anchors.label):
        mine = anchors_by_label[slice(*np.searchsorted(anchors.label[anchors_by_label], [label, label + 1]))]
        for tile in rows.tiles(by_label[slice(*np.searchsorted(rows.label[by_label], [label, label + 1]))]):
            packed = Packed(rows.vectors[tile], *_ends(anchors.vectors[mine]))
            for a, scores in zip(mine, packed.scores(anchors.vectors[mine]), strict=True):
                other = rows.rid[tile] != anchors.rid[a]
                places, own = tile[other], scores[other]
                for p in _best(own, rows.id[places], most):
                    yield (int(anchors.rid[a]), None, None, None, rows.id_of(places[p]), int(rows.rid[places[p]]), int(own[p]))


def negatives_of(anchors: Side, positives: list[list[dict]], rows: Side, most: int, window: tuple[int, int]) -> Iterator[tuple]:
    """Each anchor's and positive's best rows of another label whose score is
    within ``window`` (per cent) of the positive's."""
    ends = _ends(anchors.vectors)
    for tile in rows.tiles(np.arange(len(rows.rid))):
        packed = Packed(rows.vectors[tile], *ends)
        for a, scores in enumerate(packed.scores(anchors.vectors)):
            other = rows.label[tile] != anchors.label[a]
            places, own = tile[other], scores[other]
            for positive in positives[a]:
                at = positive["score"]
                low, high = -(-window[0] * at // 100), window[1] * at // 100
                if low > high:
                    continue
                inside = np.flatnonzero((own >= low) & (own <= high))
                for p in inside[_best(own[inside], rows.id[places[inside]], most)]:
                    yield (
                        int(anchors.rid[a]), positive["place"], positive["id"], at,
                        rows.id_of(places[p]), int(rows.rid[places[p]]), int(own[p]),
                    )


def _buckets(rows: DataFrame, at_least: int) -> int:
    size = rows.agg(F.coalesce(F.sum(F.octet_length("vec") + 32), F.lit(0)).alias("s")).first()["s"]
    return max(1, -(-size // BUCKET), min(at_least, -(-size // SMALL_BUCKET)))


def _usable(df: DataFrame, scale: int, is_anchor: Column, id_col: str, label_col: Column, vector_col: str) -> DataFrame:
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for v in b.column("v").to_pylist():
                x = np.array(v, dtype="<f8") if v is not None and None not in v else np.array([math.nan])
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x) + 0.0
                raw.append(x.tobytes() if np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(raw, pa.binary())], ["id", "label", "anchor", "vec"])

    thin = df.select(
        F.col(id_col).cast("long").alias("id"), label_col.cast("string").alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"),
    )
    rows = thin.where("label IS NOT NULL").mapInArrow(read, "id long, label string, anchor boolean, vec binary")
    rows = rows.where("vec IS NOT NULL").withColumn("width", (F.octet_length("vec") / 8).cast("int"))
    return cut_lineage(rows.withColumn("rid", F.monotonically_increasing_id()))


def hard_negatives(
    df: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: Column | str = "label",
    vector_col: str = "embedding",
    scale: int = SCALE,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: for each row where ``is_anchor``, its best ``positives``
    other rows of the same label, and for each of them the best ``negatives``
    rows of another label whose score is between ``window`` per cent of the
    positive's.

    A score is the inner product of the vectors' components floor(scale * x),
    as an exact integer (beyond 64 bits it counts as the end of the range);
    higher scores come first, then smaller ids (null ids last). Rows with a
    null label or vector, or with a component that is null or not finite (also
    after scaling), take no part; vectors of different lengths are not
    compared, and empty ones score 0. Repeated rows and ids are rows of their
    own; a null id is no anchor unless ``is_anchor`` says so. Other columns are
    ignored. An empty table, no anchors and a single label give an empty
    result.
    """
    label_col = F.col(label) if isinstance(label, str) else label
    rows = _usable(df, scale, is_anchor, id_col, label_col, vector_col)
    anchors = rows.where("anchor").drop("anchor")
    by_anchor, by_row = _buckets(anchors, 1), _buckets(rows, BUCKETS)

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    key = ["width", "ga", "gr"]
    dealt = rows.drop("anchor").withColumn("gr", F.pmod(F.xxhash64("rid"), F.lit(by_row)).cast("int")).withColumn("ga", numbers(by_anchor))
    bucket = F.pmod(F.xxhash64("rid"), F.lit(by_anchor)).cast("int")

    def met(left: DataFrame, function) -> DataFrame:
        # Columns of its own: those that both sides share would be pruned from one of them.
        left = left.select(*(F.col(c).alias(c) for c in left.columns))
        spread = left.withColumn("ga", bucket).withColumn("gr", numbers(by_row))
        return spread.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(function, FOUND)

    def first_pass(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        width, labels = key[0].as_py(), {}
        return _found(list(positives_of(Side(left, width, labels), Side(right, width, labels), positives)))

    def second_pass(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        width, labels = key[0].as_py(), {}
        given = left.column("positives").to_pylist()
        found = negatives_of(Side(left, width, labels), given, Side(right, width, labels), negatives, window)
        return _found(list(found))

    order = [F.desc("score"), F.col("found_id").asc_nulls_last(), "found_rid"]
    place = F.row_number().over(Window.partitionBy("rid").orderBy(*order))
    best = met(anchors, first_pass).withColumn("place", place).where(F.col("place") <= positives)
    chosen = best.groupBy("rid").agg(F.collect_list(F.struct("place", F.col("found_id").alias("id"), "score")).alias("positives"))
    rank = F.row_number().over(Window.partitionBy("rid", "place").orderBy(*order))
    with_positives = cut_lineage(anchors.join(chosen, "rid"))
    mined = met(with_positives, second_pass).withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = anchors.select("rid", F.col("id").alias("anchor_id"))
    return mined.join(names, "rid").select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


OP12_SQL = """WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
    FROM r a JOIN r o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
  positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
  SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id,
         p.positive_score, s.score AS negative_score
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id
  WHERE NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
  WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
  QUALIFY row_number() OVER w <= 3"""
