"""Change detection between two snapshots.

Plan shape: the first full outer join compares only ``(repo, path,
content_hash)`` - column pruning keeps ``content`` out of that shuffle. The
text is fetched afterwards for the changed paths only, with joins against
the snapshot scans; Spark's runtime Bloom filter on the (small) changed side
prunes the big scan before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rtrim_newlines

KEYS = ["repo", "path"]


def changed_paths(old: DataFrame, new: DataFrame) -> DataFrame:
    """``repo, path, change`` for paths added, removed or whose hash
    differs. Empty paths are dropped; each path appears once."""
    o = old.filter(F.col("path") != "").select(*KEYS, F.col("content_hash").alias("_oh")).dropDuplicates(KEYS)
    n = new.filter(F.col("path") != "").select(*KEYS, F.col("content_hash").alias("_nh")).dropDuplicates(KEYS)
    j = o.join(n, KEYS, "full_outer").filter(~F.col("_oh").eqNullSafe(F.col("_nh")))
    change = F.when(F.col("_oh").isNull(), "added").when(F.col("_nh").isNull(), "removed").otherwise("modified")
    return j.select(*KEYS, change.alias("change"))


def normalise_content(c, trim_old: bool = True):
    """The stored old version loses trailing newlines (as a version
    store's show command prints it); the working copy keeps them."""
    return rtrim_newlines(c) if trim_old else c


def changed_files(old: DataFrame, new: DataFrame, trim_old: bool = True) -> DataFrame:
    """``repo, path, old_content, new_content`` for changed paths; the
    missing side is ``''``. Snapshots hold one row per ``(repo, path)``."""
    ch = changed_paths(old, new)
    keys = ch.select(*KEYS)
    # texts of changed paths only: the (usually small) changed-key side is
    # the semi-join's build side, so unchanged texts are never shuffled
    oc = old.select(*KEYS, F.col("content").alias("_oc")).join(keys, KEYS, "left_semi")
    nc = new.select(*KEYS, F.col("content").alias("_nc")).join(keys, KEYS, "left_semi")
    out = ch.join(oc, KEYS, "left").join(nc, KEYS, "left")
    return out.select(
        *KEYS,
        F.coalesce(normalise_content(F.col("_oc"), trim_old), F.lit("")).alias("old_content"),
        F.coalesce(F.col("_nc"), F.lit("")).alias("new_content"),
    )


def split_lines(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per line (``line_no`` from 1); ``\\r\\n`` becomes ``\\n``;
    empty content gives no lines."""
    keep = keep if keep is not None else [c for c in df.columns if c != content]
    return (
        df.filter(F.col(content) != "")
        .select(*keep, F.posexplode(F.split(F.replace(F.col(content), F.lit("\r\n"), F.lit("\n")), "\n", -1)).alias("_i", "line"))
        .select(*keep, (F.col("_i") + 1).alias("line_no"), "line")
    )
