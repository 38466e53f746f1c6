"""Running totals in a given order, for groups of any size.

Rows are dealt out by ranges of (group, order). What comes before a row is the
total of its group's earlier ranges (a row per range and group) plus the total
inside its own range, so no task holds more of a group than a range does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def totals_before(rows: DataFrame, group: list[str], order: list[str], size: str, name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with ``name``: the sum of ``size`` over the rows of the same
    ``group`` that come before in ``order`` (which tells the rows of a group
    apart). Stored once in the checkpoint folder."""
    by = [*group, *order]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    stored = cut_lineage(dealt.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = stored.groupBy("_range", *group).agg(F.sum(size).alias("_t"))
    totals = totals.select("_range", *group, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(size).over(inside), F.lit(0))
    return stored.withColumn("_inside", within).join(totals, ["_range", *group]).withColumn(
        name, (F.col("_before") + F.col("_inside")).cast("long")
    ).drop("_range", "_inside", "_before")
