"""Impact selection (M1-M3) and the size budget (A4, A5).

The prefix join of changed code paths against mapping prefixes is turned
into an equi-join: every changed path is cut to each distinct prefix length
that occurs among the mappings (a set bounded by the longest prefix, passed
as a scalar subquery), the cut prefixes are de-duplicated map-side, and then
joined to the mapping prefixes on ``(repo, prefix)``. No nested-loop join,
no cross product, and a prefix shared by many paths becomes one row before
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import totals_before

# Bytes per token of the size estimate, and the default token
# limit of one run.
BYTES_PER_TOKEN = 4
DEFAULT_MAX_TOKENS = 50_000


def match_prefixes(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """M1: ``repo, mapping_id`` for every mapping with a code prefix that
    some changed path starts with (plain string prefix, not aligned to path
    segments). ``changed(repo, path)``, ``pairs(repo, mapping_id,
    code_prefix, ...)``."""
    prefixes = pairs.select("repo", "mapping_id", "code_prefix").distinct()
    lengths = prefixes.select(F.array_sort(F.collect_set(F.length("code_prefix"))).alias("l")).scalar()
    cut = changed.select("repo", "path", lengths.alias("_lens")).select(
        "repo",
        F.explode(
            F.transform(
                F.filter("_lens", lambda n: n <= F.length("path")),
                lambda n: F.substring("path", F.lit(1), n),
            )
        ).alias("code_prefix"),
    ).distinct()
    return cut.join(prefixes, ["repo", "code_prefix"]).select("repo", "mapping_id").distinct()


def mapped_docs(changed: DataFrame, pairs: DataFrame) -> DataFrame:
    """M2: ``repo, doc_path`` named by any matching mapping (union, distinct)."""
    hit = match_prefixes(changed, pairs)
    return pairs.join(hit, ["repo", "mapping_id"], "left_semi").select("repo", "doc_path").distinct()


def select_docs(docs: DataFrame, mapped: DataFrame) -> DataFrame:
    """M3: per repository, the documents named by matching mappings; when
    there are none (no mappings, no match, or only names of documents that
    do not exist) all documents of the repository.

    Per-repository flag by aggregation and an equi-join back on keys only
    (not an unpartitioned window); a large repository is split by AQE's
    skew-join handling."""
    m = mapped.select("repo", F.col("doc_path").alias("path"), F.lit(True).alias("_hit")).distinct()
    flagged = docs.select("repo", "path").join(m, ["repo", "path"], "left").withColumn(
        "_hit", F.coalesce("_hit", F.lit(False))
    )
    any_hit = flagged.groupBy("repo").agg(F.max("_hit").alias("_any"))
    chosen = flagged.join(any_hit, "repo").filter(F.col("_hit") | ~F.col("_any")).select("repo", "path")
    # decided on keys; the texts are fetched once
    return docs.join(chosen, ["repo", "path"], "left_semi")


def _size(docs: DataFrame) -> Column:
    return F.col("n_bytes") if "n_bytes" in docs.columns else F.octet_length("content")


def token_estimate(docs: DataFrame) -> DataFrame:
    """A4: ``repo, n_docs, total_bytes, est_tokens`` - UTF-8 bytes summed,
    integer-divided by four after the sum. ``docs`` carries ``content`` or
    its byte count ``n_bytes``."""
    return (
        docs.groupBy("repo")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(_size(docs)).alias("total_bytes"))
        .withColumn("est_tokens", F.floor(F.col("total_bytes") / BYTES_PER_TOKEN).cast("bigint"))
    )


def budget_gate(estimates: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS) -> DataFrame:
    """A5: flag each repository as within the budget (estimate not above the
    limit). A repository over the limit stops alone; the others go on."""
    return estimates.withColumn("within_budget", F.col("est_tokens") <= F.lit(max_tokens))


def docs_within_budget(docs: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS) -> DataFrame:
    """Documents of the repositories that pass ``budget_gate``."""
    ok = budget_gate(token_estimate(docs), max_tokens).filter("within_budget").select("repo")
    return docs.join(ok, "repo", "left_semi")


def budget_cut(docs: DataFrame, max_tokens: int = DEFAULT_MAX_TOKENS, ranges: int | None = None) -> DataFrame:
    """A5 with an ordered cut: ``repo, path, n_bytes, bytes_before, fits``. A
    document fits while the estimate of its repository's documents up to it, in
    path order, is not above the limit; so what fits is a beginning of the
    repository, and ``fits`` on its last document is the all-or-nothing flag of
    ``budget_gate``. Only keys and sizes move."""
    sized = docs.select("repo", "path", F.coalesce(_size(docs), F.lit(0)).cast("long").alias("n_bytes"))
    placed = totals_before(sized, ["repo"], ["path"], "n_bytes", "bytes_before", ranges)
    upto = F.floor((F.col("bytes_before") + F.col("n_bytes")) / BYTES_PER_TOKEN)
    return placed.select("repo", "path", "n_bytes", "bytes_before", (upto <= max_tokens).alias("fits"))
