"""Connected components of a link table, by alternating star operations.

Every step is a minimum per node (aggregated before the shuffle) joined back
to the links, so no task ever holds the links of one node together, and the
driver sees counts only. Each round is written to the shared checkpoint
folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def stored(df: DataFrame, rows: int, rows_in_file: int | None) -> DataFrame:
    """``df`` of at most about ``rows`` rows, stored in files of about
    ``rows_in_file`` rows (None: a file for each task), so that small tables
    do not become hundreds of tasks again."""
    return cut_lineage(df if rows_in_file is None else df.coalesce(rows // rows_in_file + 1))


def _least(links: DataFrame, rows: int, rows_in_file: int | None) -> DataFrame:
    """``u, least``: the smallest of each node and its neighbours in ``(u, v)``."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("least"))
    return stored(least, rows, rows_in_file)


def _large_star(links: DataFrame, rows: int, rows_in_file: int | None) -> DataFrame:
    """Larger neighbours of each node hang on the node's least neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least(both, 2 * rows, rows_in_file), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(links: DataFrame, rows: int, rows_in_file: int | None) -> DataFrame:
    """Smaller neighbours of each node, and the node, hang on the least of them."""
    joined = links.join(_least(links, rows, rows_in_file), "u")
    return (
        joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v")).where("u > v").distinct()
    )


def _print_of(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, rows_in_file: int | None = None) -> DataFrame:
    """``node, root`` for every node of ``links(a, b)`` that is not itself the
    smallest of its component: ``root`` is that smallest node.

    Nodes are comparable values of one type. Repeated links, links in either
    direction and links of a node with itself are allowed; links with a null
    end are ignored. No links give no rows.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stored(links.distinct(), 0 if rows_in_file is None else links.count(), rows_in_file)
    before = _print_of(now)
    while before[0]:
        rows = before[0]
        now = stored(_small_star(_large_star(now, rows, rows_in_file), rows, rows_in_file), rows, rows_in_file)
        after = _print_of(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
