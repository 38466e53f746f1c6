"""Validation and reporting (V1-V4, A6) and the ready-to-write filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import stays_inside_root
from ..functions.text import go_quote, percent0, preview

# Content-loss share above which an update is rejected, and
# single-delete share above which an edit is flagged.
CONTENT_LOSS_THRESHOLD = 0.50
SINGLE_DELETE_THRESHOLD = 0.30


def validate_edits(edits: DataFrame) -> DataFrame:
    """V1: per-edit warnings (never rejections) on ``file, action, old_text,
    new_text, file_len``: a replace with empty new text; a delete removing
    more than 30 % of a non-empty file. Adds ``message`` (null = fine)."""
    old = F.coalesce(F.col("old_text"), F.lit(""))
    frac = F.octet_length(old) / F.col("file_len")
    msg = F.when(
        (F.col("action") == "replace") & (F.coalesce(F.col("new_text"), F.lit("")) == ""),
        F.concat(F.lit("replace has empty new_text for "), go_quote(preview(old, 80))),
    ).when(
        (F.col("action") == "delete") & (F.col("file_len") > 0) & (frac > SINGLE_DELETE_THRESHOLD),
        F.format_string(
            "single delete removes %s%% of file (%d of %d bytes)",
            percent0(frac * 100), F.octet_length(old), F.col("file_len"),
        ),
    )
    return edits.withColumn("message", msg).withColumn("rejected", F.lit(False))


def validate_updates(originals: DataFrame, updates: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V2: ``issues(repo, file, message, rejected)`` for updates of known
    documents that are empty or lose more than half of their bytes."""
    keys = keys or ["repo", "path"]
    # only byte lengths are compared: take them before the join so the
    # shuffle carries two integers per document, not both texts
    j = updates.select(*keys, F.octet_length("content").alias("_new_len")).join(
        originals.select(*keys, F.octet_length("content").alias("_old_len")), keys, "inner"
    )
    old_len, new_len = F.col("_old_len"), F.col("_new_len")
    loss = (old_len - new_len) / old_len
    msg = F.when(new_len == 0, F.lit("updated content is empty")).when(
        (old_len > 0) & (loss > CONTENT_LOSS_THRESHOLD),
        F.format_string(
            "content shrank by %s%% (%d → %d bytes), exceeds %s%% threshold",
            percent0(loss * 100), old_len, new_len, F.lit(str(int(CONTENT_LOSS_THRESHOLD * 100))),
        ),
    )
    return (
        j.withColumn("message", msg)
        .filter(F.col("message").isNotNull())
        .select(keys[0], F.col(keys[1]).alias("file"), "message", F.lit(True).alias("rejected"))
    )


def blocked_docs(updates: DataFrame, issues: DataFrame, force: bool = False, keys: list[str] | None = None) -> DataFrame:
    """V3: updates with ``blocked`` = has a rejecting issue (never with
    ``force``)."""
    keys = keys or ["repo", "path"]
    if force:
        return updates.withColumn("blocked", F.lit(False))
    rej = issues.filter("rejected").select(keys[0], F.col("file").alias(keys[1])).distinct().withColumn("_r", F.lit(True))
    return updates.join(rej, keys, "left").withColumn("blocked", F.col("_r").isNotNull()).drop("_r")


def dry_run_report(flagged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V4: ``would update`` / ``would block`` per updated path."""
    keys = keys or ["repo", "path"]
    return flagged.select(
        *keys, F.when(F.col("blocked"), "would block").otherwise("would update").alias("action")
    )


def write_ready_docs(flagged: DataFrame, existing: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """S6 (filter part): of the unblocked updates keep those with content,
    a path that stays inside the root and an existing target; the content
    gets a final newline if it lacks one. Adds ``outcome``: ``written``,
    ``blocked``, ``empty``, ``unsafe_path`` or ``missing_target``."""
    keys = keys or ["repo", "path"]
    ex = existing.select(*keys).distinct().withColumn("_exists", F.lit(True))
    j = flagged.join(ex, keys, "left")
    outcome = (
        F.when(F.col("blocked"), "blocked")
        .when(F.col("content") == "", "empty")
        .when(~stays_inside_root(F.col(keys[1])), "unsafe_path")
        .when(F.col("_exists").isNull(), "missing_target")
        .otherwise("written")
    )
    content = F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    return j.select(*keys, content.alias("content"), outcome.alias("outcome"))


def write_docs(ready: DataFrame, out_path: str) -> None:
    """S6 (sink): write the ``written`` rows to a new dataset location,
    partitioned by repository, replacing only the partitions present."""
    (
        ready.filter(F.col("outcome") == "written")
        .drop("outcome")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo")
        .parquet(out_path)
    )


def outcome_counts(ready: DataFrame, key: str = "repo") -> DataFrame:
    """Per repository, how many updates were written, blocked or refused."""
    o = F.col("outcome")
    return ready.groupBy(key).agg(
        F.count_if(o == "written").alias("written"),
        F.count_if(o == "blocked").alias("blocked"),
        F.count_if(~o.isin("written", "blocked")).alias("refused"),
    )
