"""Ordered edit application.

All edits of one reply already sit in one row (the decoded ``edits``
array), so applying them is a left fold over that array with SQL's
``aggregate``: no explode, no regroup, no shuffle beyond the join that
brings the document text next to its reply. Each edit sees the result of
the one before; matching is literal (``instr`` / ``substring``), never a
regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains, let, trim_space

LOG_T = "array<struct<seq:int,file:string,action:string,old_text:string,new_text:string,file_len:int,applied:boolean,error:string>>"


def _step(path: Column):
    def step(acc, e):
        c = acc["content"]
        file_ = F.coalesce(e["file"], F.lit(""))
        action = F.coalesce(e["action"], F.lit(""))
        old = F.coalesce(e["old_text"], F.lit(""))
        new = F.coalesce(e["new_text"], F.lit(""))

        def with_pos(pos):
            def with_error(error):
                insert_text = F.when(action == "insert_after", F.concat(old, F.lit("\n"), new)).when(
                    action == "replace", new
                ).otherwise(F.lit(""))
                applied = F.concat(
                    F.substring(c, F.lit(1), pos - 1),
                    insert_text,
                    F.substring(c, pos + F.length(old), F.lit(2147483647)),
                )
                entry = F.struct(
                    e["seq"].alias("seq"),
                    file_.alias("file"),
                    action.alias("action"),
                    old.alias("old_text"),
                    new.alias("new_text"),
                    F.octet_length(c).alias("file_len"),
                    error.isNull().alias("applied"),
                    error.alias("error"),
                )
                return F.struct(
                    F.when(error.isNull(), applied).otherwise(c).alias("content"),
                    F.concat(acc["log"], F.array(entry)).alias("log"),
                )

            found = pos > 0
            error = (
                F.when(file_ != path, F.lit("unknown_file"))
                .when(~action.isin("replace", "delete", "insert_after"), F.lit("unknown_action"))
                .when(~found & (action == "insert_after"), F.lit("anchor_not_found"))
                .when(~found, F.lit("not_found"))
                .when((action == "insert_after") & contains(c, trim_space(new)), F.lit("duplicate"))
            )
            return let(error, with_error)

        return let(F.instr(c, old), with_pos)

    return step


def apply_edits(docs: DataFrame, replies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """R8 + R11: ``docs(repo, path, content)`` and ``replies(repo, path,
    edits)`` -> ``repo, path, content, new_content, log``.

    ``log`` holds one entry per edit: its fields, the byte length of the text
    it saw, whether it was applied and why not (``unknown_file`` - the edit
    names another document; ``not_found``; ``anchor_not_found``;
    ``duplicate`` - the trimmed insert is already present; ``unknown_action``).
    """
    keys = keys or ["repo", "path"]
    j = docs.join(replies.select(*keys, "edits"), keys, "inner")
    numbered = F.transform(
        F.coalesce(F.col("edits"), F.array()),
        lambda e, i: F.struct(
            i.alias("seq"), e["file"].alias("file"), e["action"].alias("action"),
            e["old_text"].alias("old_text"), e["new_text"].alias("new_text"),
        ),
    )
    zero = F.struct(F.col("content").alias("content"), F.array().cast(LOG_T).alias("log"))
    folded = F.aggregate(numbered, zero, _step(F.col("path")))
    # a generator row: a filter on the result is not pushed into the fold, so
    # the fold runs once per document however often its result is read
    return j.select(*keys, "content", F.inline(F.array(folded)).alias("new_content", "log"))


def skipped_edits(applied: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per edit that changed nothing, with its reason."""
    keys = keys or ["repo", "path"]
    return (
        applied.select(*keys, F.explode("log").alias("l"))
        .filter(~F.col("l.applied"))
        .select(*keys, "l.seq", "l.file", "l.action", "l.error")
    )


def changed_docs(applied: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Only documents whose text changed: ``repo, path, content``
    (the new text)."""
    keys = keys or ["repo", "path"]
    return applied.filter(F.col("new_content") != F.col("content")).select(
        *keys, F.col("new_content").alias("content")
    )


def scope_edits(edits: DataFrame, path: str = "path") -> DataFrame:
    """R11 on exploded edits: flag edits naming a document other than the
    one the reply was for (``in_scope = false``)."""
    return edits.withColumn("in_scope", F.coalesce(F.col("file"), F.lit("")) == F.col(path))
