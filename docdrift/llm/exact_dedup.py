"""Exact deduplication with a two-pass Bloom filter (DataFrame functions only).

Texts are equal when they are identical after all ASCII white space is
deleted. Texts leave the scan as a SHA-256 digest and a length; they are never
shuffled.

Pass 1 sets each row's pattern (three bits of one 64-bit word) and counts, with
map-side aggregation, how often each pattern was set; the patterns set twice or
more form a register-blocked Bloom filter of possibly repeated digests. Pass 2
tests every row against the filter. Only rows that the filter reports are
shuffled by digest and grouped; all others pass straight through as groups of
one. A false report costs a little shuffling and nothing else: groups are
formed on the whole digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import power_of_two, table, text_or_empty

#: ASCII white space, deleted before texts are compared (fixed values).
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Bits of filter for each input row; the filter grows with the input.
BITS_PER_ROW = 32


def squeezed(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _pattern(digest: Column) -> Column:
    h = F.xxhash64(digest, F.lit(1))
    place = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in place]
    return bit[0].bitwiseOR(bit[1]).bitwiseOR(bit[2])


def possibly_repeated(digests: DataFrame, bits_per_row: int = BITS_PER_ROW) -> DataFrame:
    """Add ``suspect`` to a stored table with a binary column ``sha``: false
    only where no other row can have the same digest."""
    blocks = power_of_two(digests.count() * bits_per_row / 64)
    marked = digests.withColumns(
        {"block": F.pmod(F.xxhash64("sha"), F.lit(blocks)), "pattern": _pattern(F.col("sha"))}
    )
    twice = marked.groupBy("block", "pattern").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    words = cut_lineage(twice.groupBy("block").agg(F.bit_or("pattern").alias("word")))
    # The stored filter is broadcast only if its measured size allows it.
    tested = marked.join(words, "block", "left")
    hit = F.coalesce(F.col("word").bitwiseAND(F.col("pattern")) == F.col("pattern"), F.lit(False))
    return tested.select(*digests.columns, hit.alias("suspect"))


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = BITS_PER_ROW
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the most code points, then the smallest id,
    stays (null ids come last; of rows that tie in both, one stays). Null text
    counts as empty; all empty texts are one group. Other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    text = text_or_empty(text_col)
    thin = df.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(squeezed(text).cast("binary"), 256)).alias("sha"),
        F.length(text).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("rid"),
    )
    flagged = possibly_repeated(cut_lineage(thin), bits_per_row)
    suspects = cut_lineage(flagged.where("suspect").drop("suspect"))
    order = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")
    groups = cut_lineage(
        suspects.groupBy("sha")
        .agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("sha", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"), "group_size")
    )
    digest = F.lower(F.hex("sha")).alias("text_sha256")
    single = flagged.where("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        digest,
    )
    grouped = suspects.join(groups, "sha").select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), digest
    )
    return single.unionByName(grouped)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), h AS (
  SELECT doc_id, length(text) AS n,
         sha256(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM t
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS pos,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, pos = 1 AS kept, text_sha256 FROM r
"""
