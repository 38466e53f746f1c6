"""Registered keys: one Spark query and (where SQL can say it) one DuckDB
oracle query per operator of the inventory.

``QUERIES[key](spark, sf_dir) -> DataFrame`` and ``ORACLE[key] -> str``.
Column names are identical on both sides; arrays are flattened to text so
value hashes agree across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco
