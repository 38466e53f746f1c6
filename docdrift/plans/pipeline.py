"""The whole run as two lazy plans, for all repositories at once.

``plan_updates`` goes from two snapshots to requests, ``plan_version_updates``
from two versions of a content-addressed store; ``finish_updates``
goes from stored replies to the rows to write. Two points are materialised
in the shared checkpoint folder (``spark.checkpoint.dir``): the symbol diffs
(read by three consumers) and the replies (an answered request is not asked
again). ``apply_updates`` merges the result into the document store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import diff as D
from ..operators import edits as E
from ..operators import mining as MI
from ..operators import requests as RQ
from ..operators import select as M
from ..operators import summary as A
from ..operators import validate as V
from ..sources import doc_store as DS
from ..sources import docs as SD
from ..sources import replies as SR
from ..sources import snapshots as SS
from ..sources import text_store as TS
from ..session import cut_lineage


def plan_updates(
    old_snapshot: DataFrame,
    new_snapshot: DataFrame,
    docs: DataFrame,
    roots: DataFrame,
    mappings: DataFrame | None = None,
    excludes: DataFrame | None = None,
    max_tokens: int = M.DEFAULT_MAX_TOKENS,
    model: str = "",
    parts: dict[str, str] | None = None,
    suffix: str = ".go",
) -> dict[str, DataFrame]:
    """Snapshots, documents and configuration -> diffs, summaries, selected
    documents (keys and sizes), budget and requests (one per document of a
    repository with an API change and within budget)."""
    old_src = SS.filter_source_files(old_snapshot, suffix)
    new_src = SS.filter_source_files(new_snapshot, suffix)
    return plan_changes(C.changed_files(old_src, new_src), docs, roots, mappings, excludes, max_tokens, model, parts)


def plan_version_updates(
    spark: SparkSession,
    store: str,
    old_ref: str,
    new_ref: str,
    docs: DataFrame,
    roots: DataFrame,
    suffix: str = ".go",
    **options,
) -> dict[str, DataFrame]:
    """``plan_updates`` for two versions of the content-addressed store at
    ``store``: hashes alone decide which files changed; texts are then read
    from the partitions that hold those of changed files. ``options`` are those
    of ``plan_changes``."""
    return plan_changes(TS.stored_changes(spark, store, old_ref, new_ref, suffix=suffix), docs, roots, **options)


def plan_changes(
    changed: DataFrame,
    docs: DataFrame,
    roots: DataFrame,
    mappings: DataFrame | None = None,
    excludes: DataFrame | None = None,
    max_tokens: int = M.DEFAULT_MAX_TOKENS,
    model: str = "",
    parts: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """The plan from ``changed(repo, path, old_content, new_content)`` on."""
    files = cut_lineage(changed)  # read by mining, selection and summary
    old_syms = MI.mine_declarations(files.select("repo", "path", F.col("old_content").alias("content"))).drop("exported")
    new_syms = MI.mine_declarations(files.select("repo", "path", F.col("new_content").alias("content"))).drop("exported")
    unread = _errors(files, "old").unionByName(_errors(files, "new"))
    # stored inside, before renames are paired
    diffs = D.symbol_diff(old_syms, new_syms, failed=unread)
    repos = files.select("repo").distinct()
    summary = A.summary_compact(diffs, repos)
    with_api_change = summary.filter(F.col("summary") != A.NO_CHANGES)

    # decided on keys and byte counts; the texts are fetched once, for the requests
    sizes = cut_lineage(docs.select("repo", "path", F.octet_length("content").alias("n_bytes")))
    scanned = cut_lineage(SD.scan_docs(sizes, roots, excludes))
    if mappings is not None:
        mapped = M.mapped_docs(files.select("repo", "path"), SD.mapping_pairs(mappings))
    else:
        mapped = files.sparkSession.createDataFrame([], "repo string, doc_path string")
    selected = cut_lineage(M.select_docs(scanned, mapped))
    budget = M.budget_gate(M.token_estimate(selected), max_tokens)
    passed = budget.filter("within_budget").select("repo").join(with_api_change.select("repo"), "repo", "left_semi")
    chosen = selected.join(passed, "repo", "left_semi").select("repo", "path")
    ok = docs.select("repo", "path", "content").join(chosen, ["repo", "path"], "left_semi")
    requests = RQ.build_requests(ok, with_api_change, model=model, parts=parts)
    return {
        "changed_files": files,
        "diffs": diffs,
        "summary": summary,
        "selected": selected,
        "budget": budget,
        "requests": RQ.request_json(requests),
        "extract_errors": unread,
    }


def _errors(files: DataFrame, side: str) -> DataFrame:
    """E12 rows of one version of the changed files."""
    rows = files.select("repo", "path", F.col(f"{side}_content").alias("content"))
    return MI.extract_errors(rows).withColumn("side", F.lit(side))


def complete(requests_json: DataFrame, summaries: DataFrame, completer: Callable[[str], str], store: str, **calls) -> DataFrame:
    """R0 with the reply store in shared storage (one stored reply per
    request); ``calls`` are the options of ``complete_requests``."""
    return RQ.complete_requests(requests_json, completer, summaries, store, **calls)


def finish_updates(
    replies: DataFrame,
    docs: DataFrame,
    force: bool = False,
) -> dict[str, DataFrame]:
    """Stored replies ``(repo, path, body)`` and the original documents ->
    gate status, applied edits, skipped edits, issues and the ready rows
    with their outcome."""
    gated = SR.gate_replies(SR.decode_replies(replies))
    decoded = SR.decode_edits(gated)
    applied = E.apply_edits(docs, decoded.filter(F.col("decode_status") == "ok"))
    updates = cut_lineage(E.changed_docs(applied))  # read by validation and blocking
    issues = V.validate_updates(docs, updates)
    flagged = V.blocked_docs(updates, issues, force=force)
    ready = V.write_ready_docs(flagged, docs)
    return {
        "status": decoded.select("repo", "path", "reply_status", "decode_status"),
        "applied": applied,
        "skipped": E.skipped_edits(applied),
        "issues": issues,
        "report": V.dry_run_report(flagged),
        "ready": ready,
        "counts": V.outcome_counts(ready),
    }


def apply_updates(ready: DataFrame, store: str, run: str) -> int:
    """Merge the rows to write into the document store at ``store``; the
    version that holds them. Documents without an update stay as they are, and
    a run that was already applied is not applied again."""
    return DS.merge_docs(ready, store, run)
