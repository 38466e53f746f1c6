"""Text files on shared storage, one row per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _plain(path: Column) -> Column:
    """A path without scheme and authority, leading slashes as one."""
    return F.regexp_replace(F.regexp_replace(path, _SCHEME, ""), "^/+", "/")


def read_texts(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """``path`` (relative to ``root``, however that is spelt) and ``content``
    of every file below ``root`` whose name ends with ``suffix``.

    ``wholetext`` gives one row per file; the suffix filter is pushed into the
    file listing. Spark reports paths percent-encoded; they are decoded (a
    plus sign stays one)."""
    df = (
        # keyword arguments of ``text`` override ``.option`` values, so
        # ``wholetext`` must be passed here to get one row per file
        spark.read.text(root, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True)
        .select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("_abs"))
    )
    full = _plain(F.url_decode(F.replace("_abs", F.lit("+"), F.lit("%2B"))))
    base = F.concat(F.regexp_replace(_plain(F.lit(root)), "/+$", ""), F.lit("/"))
    return df.select(F.when(full.startswith(base), F.substr(full, F.length(base) + 1)).otherwise(full).alias("path"), "content")
