"""Change summaries (A2, A3): ordered chunks, and one text per repository.

The summary of a repository is kept as chunk rows, one per ``(repo, section,
path)`` or ``(repo, path)``, each no longer than a file's changes; in the order
of their keys they are the text. ``text_parts`` gives that text in parts of a
bounded size with their byte offsets, whatever the size of a repository.
``summary_verbose`` and ``summary_compact`` put a repository's chunks together
where one text is asked for (a request); that text is one row, so it is for
repositories whose summary fits one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space
from .ordered import totals_before

# The text used when a repository has no changes, and the
# section headings of the verbose summary in section order.
NO_CHANGES = "No changes to exported symbols"
SECTIONS = ["## Added", "## Removed", "## Modified", "## Renamed"]
#: Bytes of a part of a text.
PART_BYTES = 1 << 20


def _ordered_join(items: Column, sep: str) -> Column:
    # items: array<struct<k..., line>>; sort by the struct order, keep lines
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["line"]), sep)


def verbose_lines(diffs: DataFrame) -> DataFrame:
    """One row per summary line: ``repo, section, path, name, j, line``."""
    prefix = F.concat(F.lit("- "))
    single = diffs.filter(F.col("change_ord") != 2).select(
        "repo",
        F.col("change_ord").alias("section"),
        "path",
        "name",
        F.lit(0).alias("j"),
        F.when(F.col("change_ord") == 0, F.concat(prefix, F.col("signature")))
        .when(F.col("change_ord") == 1, F.concat(prefix, F.col("old_signature")))
        .otherwise(
            F.concat(prefix, F.col("old_name"), F.lit(" -> "), F.col("name"), F.lit(": "), F.col("signature"))
        )
        .alias("line"),
    )
    modified = diffs.filter(F.col("change_ord") == 2).select(
        "repo",
        F.lit(2).alias("section"),
        "path",
        "name",
        "kind",
        F.posexplode("changes").alias("j", "c"),
    ).select(
        "repo",
        "section",
        "path",
        "name",
        "j",
        F.concat(prefix, F.col("kind"), F.lit(" "), F.col("name"), F.lit(": "), F.col("c.description")).alias("line"),
    )
    return single.unionByName(modified)


def verbose_chunks(diffs: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A2: ``repo, section, path, chunk``: the lines of one file under one of
    the sections Added / Removed / Modified / Renamed, one line per sub-change
    for modified symbols. A repository of ``repos`` without changes has one
    chunk that says so."""
    chunks = verbose_lines(diffs).groupBy("repo", "section", "path").agg(
        _ordered_join(F.collect_list(F.struct("name", "j", "line")), "\n").alias("chunk")
    )
    return _say_empty(chunks, repos)


def summary_verbose(diffs: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A2: ``repo, summary``, the verbose chunks under their headings."""
    chunks = verbose_chunks(diffs)
    sections = chunks.groupBy("repo", "section").agg(
        _ordered_join(F.collect_list(F.struct("path", F.col("chunk").alias("line"))), "\n").alias("body")
    )
    head = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section") + 1)
    per_repo = sections.groupBy("repo").agg(
        _ordered_join(
            F.collect_list(F.struct("section", F.concat(head, F.lit("\n"), F.col("body")).alias("line"))),
            "\n\n",
        ).alias("summary")
    )
    return _fill_empty(per_repo, repos)


def compact_chunks(diffs: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A3: ``repo, path, chunk`` - one short entry per diff of the file, in
    diff order. A repository of ``repos`` without changes has one chunk that
    says so."""
    line = (
        F.when(F.col("change_ord") == 0, F.concat(F.lit("+ ADDED   "), F.col("name"), F.lit(": "), F.col("signature")))
        .when(F.col("change_ord") == 1, F.concat(F.lit("- REMOVED "), F.col("name"), F.lit(": "), F.col("old_signature")))
        .when(
            F.col("change_ord") == 2,
            F.concat(
                F.lit("~ CHANGED "), F.col("name"), F.lit("\n  was: "), F.col("old_signature"),
                F.lit("\n  now: "), F.col("signature"),
            ),
        )
        .otherwise(
            F.concat(F.lit("→ RENAMED "), F.col("old_name"), F.lit(" → "), F.col("name"), F.lit(": "), F.col("signature"))
        )
    )
    chunks = diffs.groupBy("repo", "path").agg(
        _ordered_join(F.collect_list(F.struct("change_ord", "name", line.alias("line"))), "\n").alias("chunk")
    )
    return _say_empty(chunks, repos)


def summary_compact(diffs: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """A3: ``repo, summary``, the compact chunks in path order."""
    chunks = compact_chunks(diffs)
    per_repo = chunks.groupBy("repo").agg(
        trim_space(_ordered_join(F.collect_list(F.struct("path", F.col("chunk").alias("line"))), "\n")).alias("summary")
    )
    return _fill_empty(per_repo, repos)


def text_parts(chunks: DataFrame, order: list[str], part_bytes: int = PART_BYTES, ranges: int | None = None) -> DataFrame:
    """A2/A3: ``repo, part, offset, text``: the ``chunks(repo, *order, chunk)``
    of a repository in their order, one line feed after each but the last, in
    parts. A part holds the chunks that start inside its ``part_bytes`` bytes
    of the text (numbers of parts without a chunk are left out); ``offset`` is
    where it starts. The parts in their order are the text."""
    sized = chunks.withColumn("_n", (F.octet_length("chunk") + 1).cast("long"))
    placed = totals_before(sized, ["repo"], order, "_n", "_at", ranges)
    placed = placed.withColumn("part", F.floor(F.col("_at") / part_bytes).cast("long"))
    parts = placed.groupBy("repo", "part").agg(
        F.min("_at").alias("offset"),
        _ordered_join(F.collect_list(F.struct("_at", F.concat(F.col("chunk"), F.lit("\n")).alias("line"))), "").alias("text"),
    )
    ends = placed.groupBy("repo").agg(F.max("part").alias("_last"))
    last = F.col("part") == F.col("_last")
    text = F.when(last, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return parts.join(ends, "repo").select("repo", "part", "offset", text.alias("text"))


def compact_parts(diffs: DataFrame, repos: DataFrame | None = None, part_bytes: int = PART_BYTES, ranges: int | None = None) -> DataFrame:
    """A3 in parts: ``repo, part, offset, text``."""
    return text_parts(compact_chunks(diffs, repos), ["path"], part_bytes, ranges)


def verbose_parts(diffs: DataFrame, repos: DataFrame | None = None, part_bytes: int = PART_BYTES, ranges: int | None = None) -> DataFrame:
    """A2 in parts: a section's heading is a chunk of its own in front of the
    section's files, with an empty line before all but the first section."""
    chunks = verbose_chunks(diffs)
    heads = chunks.groupBy("repo", "section").agg(F.lit("").alias("path"))
    first = F.col("section") == F.min("section").over(Window.partitionBy("repo"))
    title = F.element_at(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section") + 1)
    heads = heads.select("repo", "section", "path", F.lit(0).alias("k"), F.when(first, title).otherwise(F.concat(F.lit("\n"), title)).alias("chunk"))
    rows = chunks.withColumn("k", F.lit(1)).unionByName(heads)
    return text_parts(_say_empty(rows, repos), ["section", "k", "path"], part_bytes, ranges)


def _say_empty(chunks: DataFrame, repos: DataFrame | None) -> DataFrame:
    if repos is None:
        return chunks
    return repos.select("repo").distinct().join(chunks, "repo", "left").withColumn("chunk", F.coalesce("chunk", F.lit(NO_CHANGES)))


def _fill_empty(per_repo: DataFrame, repos: DataFrame | None) -> DataFrame:
    if repos is None:
        return per_repo
    return (
        repos.select("repo")
        .distinct()
        .join(per_repo, "repo", "left")
        .select("repo", F.coalesce("summary", F.lit(NO_CHANGES)).alias("summary"))
    )
