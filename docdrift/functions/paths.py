"""Path rules as column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_


def stays_inside_root(path) -> Column:
    """True when a relative path never climbs above the root.

    The path is folded segment by segment: ``..`` is one level up, ``.`` and
    empty segments stay, anything else is one level down. A leading ``/`` is
    read as relative to the root. A path that leaves the root at any point is
    rejected, even if it comes back.
    """
    segs = F.split(col_(path), "/")
    zero = F.struct(F.lit(0).alias("d"), F.lit(False).alias("bad"))

    def step(acc, seg):
        delta = F.when(seg == "..", -1).when((seg == ".") | (seg == ""), 0).otherwise(1)
        d = acc["d"] + delta
        return F.struct(d.alias("d"), (acc["bad"] | (d < 0)).alias("bad"))

    return F.aggregate(segs, zero, step, lambda acc: ~acc["bad"])


def has_suffix(path, suffix: str) -> Column:
    return col_(path).endswith(suffix)


def under_root(path, root) -> Column:
    """``path`` equals ``root`` or sits below it (segment-aligned)."""
    p, r = col_(path), col_(root)
    return (p == r) | p.startswith(F.concat(r, F.lit("/"))) | (r == "") | (r == ".")
