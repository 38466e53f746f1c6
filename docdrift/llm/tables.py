"""Small helpers the training-data operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def power_of_two(n: float) -> int:
    """The least power of two that is at least ``n`` (and at least 1)."""
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def whole_row() -> Column:
    """All columns of the input as one struct, so that helper columns beside
    it cannot clash with the input's names. Unpack with ``select("row.*")``."""
    return F.struct("*").alias("row")
