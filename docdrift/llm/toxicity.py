"""Toxicity severity by cumulative-link ordinal regression.

A document's features are the terms that occur in it (sparse, binary): its words
and their stems, ``STEMS`` letters from the front, so endings that are rare one
by one count together. An L1 penalty keeps the few terms that explain the
labels next to each other (no term has to pass a test over the vocabulary), and
the ordinal model is fitted on these. One weight vector is shared by all thresholds: P(grade > k) is the
logistic function of ``weights . features - threshold[k]`` with thresholds in
increasing order. The expected severity is the sum of these probabilities, and
a document is toxic when P(grade > 0) is at least one half.

The model is fitted by numpy on a bounded, documented sample of labelled rows
(``max_rows``, stratified by class); counting terms, scoring and everything else cover all rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table, whole_row

#: Production parameters: labelled rows fitted on, indicative terms kept, the
#: least lift of the toxic share among documents that hold a term, the highest
#: grade, the weights' penalty and the steps of the fit.
MAX_ROWS, MAX_TERMS, MIN_LIFT, GRADES, PENALTY, STEPS = 20_000, 2_000, 3.0, 3, 0.05, 400
#: The L1 penalty in documents: a term must explain more toxic documents than
#: this beyond the usual share and beyond what other terms explain.
SPARSITY = 1.0
#: Lengths of the stems; a stem is written with a star, which no word has.
STEMS = range(3, 9)

_WORD = re.compile(r"\w+")
_REMEMBERED = 200_000


def terms_of(text: str | None) -> set[str]:
    """The distinct lower-case words of a whole text and their stems."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:k] + "*" for w in words for k in STEMS if k < len(w)}


def indicative(fitted_on: DataFrame) -> list[str]:
    """Terms of ``fitted_on(toxic boolean, terms array)`` that may point to
    toxicity: the toxic share of the documents that hold the term is at least
    ``MIN_LIFT`` times the usual one, and there are more toxic ones than usual
    by over ``SPARSITY`` (with fewer, the L1 penalty leaves no weight). Terms
    are counted by Spark; at most ``MAX_TERMS``, those of the highest
    likelihood ratio, come to the driver. A stem in the same documents as a
    longer term is left out."""
    total = fitted_on.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("k")).first()
    if not 0 < total["k"] < total["n"]:
        return []
    usual = total["k"] / total["n"]
    counts = (
        fitted_on.select("toxic", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("k"))
    )
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    clean = F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - usual)))).otherwise(0.0)
    cause = k * F.log(k / (n * usual)) + clean
    sure = counts.where((k - n * usual > SPARSITY) & (k / n >= min(MIN_LIFT * usual, (1 + usual) / 2)))
    best = sure.select("term", "n", cause.alias("cause")).orderBy(F.desc("cause"), "term").limit(MAX_TERMS).collect()
    # What begins with a stem is in documents that hold the stem: with equal
    # counts these are the same documents.
    longer = {(r["term"].rstrip("*")[:i], r["n"]) for r in best for i in STEMS if i < len(r["term"].rstrip("*"))}
    return [r["term"] for r in best if not (r["term"].endswith("*") and (r["term"][:-1], r["n"]) in longer)]


def terms_column(text: Column) -> Column:
    """The distinct lower-case words and stems of each text."""

    @F.arrow_udf("array<string>")
    def terms(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            kind = pa.list_(pa.string())
            each = [pa.array([sorted(terms_of(t.as_py()))], kind) for t in texts]
            yield pa.concat_arrays([pa.array([], kind), *each])

    return terms(text)


def severity(held: np.ndarray, toxic: np.ndarray, count: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Grades for labels that only tell toxic from clean: 0 for clean, and for
    toxic ones 1 to ``grades`` by how many of the terms that point to toxicity
    they hold, cut at the toxic documents' own quantiles. Each row stands for
    ``count`` documents."""
    if not toxic.any():
        return np.zeros(len(held), dtype=int)
    cuts = np.quantile(np.repeat(held[toxic], count[toxic]), np.arange(1, grades) / grades)
    return np.where(toxic, 1 + (held[:, None] > cuts).sum(axis=1), 0)


def explaining(held: list[list[int]], width: int, toxic: np.ndarray, count: np.ndarray) -> list[int]:
    """Of ``width`` terms those with a weight in a sparse logistic model of
    toxic against clean: weights of at least zero under an L1 penalty of
    ``SPARSITY``, by accelerated proximal steps. ``held`` has the terms of each
    row, which stands for ``count`` documents."""
    size = np.array([len(h) for h in held])
    row, term = np.repeat(np.arange(len(held)), size), np.array([t for h in held for t in h], dtype=np.int64)
    share = (count * toxic).sum() / count.sum()
    w, b, last = np.zeros(width), float(np.log(share / (1 - share))), 1.0
    at_w, at_b = w, b
    # Bounds of the curvature, by term.
    by_term = 0.25 * np.bincount(term, weights=(count * (size + 1))[row], minlength=width) + 1e-9
    by_base = 0.25 * (count * (size + 1)).sum()
    for _ in range(2 * STEPS):
        score = np.bincount(row, weights=at_w[term], minlength=len(held)) + at_b
        off = count * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - toxic)
        slope = np.bincount(term, weights=off[row], minlength=width)
        new_w = np.maximum(at_w - (slope + SPARSITY) / by_term, 0)
        new_b, this = at_b - off.sum() / by_base, (1 + math.sqrt(1 + 4 * last * last)) / 2
        at_w, at_b = new_w + (last - 1) / this * (new_w - w), new_b + (last - 1) / this * (new_b - b)
        w, b, last = new_w, new_b, this
    return [int(i) for i in np.flatnonzero(w > 1e-3)]


@dataclass(frozen=True)
class Ordinal:
    """A fitted model: weight by term, increasing thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, by row."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - score[:, None], -50, 50)))


def fit_ordinal(
    features: np.ndarray, grade: np.ndarray, levels: int, count: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by gradient steps
    (Adam) on the penalised likelihood; thresholds are a first value and the
    exponentials of free gaps, so they stay in order. Grades that no row has
    widen no gap. Each row stands for ``count`` documents (one if not given)."""
    rows, width = features.shape
    count = np.ones(rows) if count is None else count.astype(float)
    share = np.array([count[grade > k].sum() / count.sum() for k in range(levels)])
    logit = -np.log(np.clip(share, 1e-4, 1 - 1e-4) / (1 - np.clip(share, 1e-4, 1 - 1e-4)))
    gaps = np.log(np.maximum(np.diff(logit), 1e-2))
    params = np.concatenate([np.zeros(width), logit[:1], gaps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    at = np.arange(rows)
    for step in range(1, STEPS + 1):
        w, b, g = params[:width], params[width], np.exp(params[width + 1 :])
        cuts = b + np.concatenate([[0], np.cumsum(g)])
        s = features @ w
        cum = 1 / (1 + np.exp(np.clip(cuts[None, :] - s[:, None], -50, 50)))  # P(grade > k)
        full = np.concatenate([np.ones((rows, 1)), cum, np.zeros((rows, 1))], axis=1)
        p = np.maximum(full[at, grade] - full[at, grade + 1], 1e-12)
        slope = full * (1 - full)  # d P(grade > k) / d (s - cut)
        d_cut = np.zeros((rows, levels + 2))
        np.add.at(d_cut, (at, grade), -slope[at, grade] / p)
        np.add.at(d_cut, (at, grade + 1), slope[at, grade + 1] / p)
        d_cut *= count[:, None]
        d_s = -d_cut.sum(axis=1)
        by_cut = d_cut[:, 1 : levels + 1].sum(axis=0)
        later = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([features.T @ d_s - PENALTY * w, [by_cut.sum()], later[1:] * g]) / count.sum()
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        params = params + 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return params[:width], params[width] + np.concatenate([[0], np.cumsum(np.exp(params[width + 1 :]))])


def train(
    documents: DataFrame,
    labels: DataFrame,
    max_rows: int = MAX_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    grade_col: str | None = None,
) -> Ordinal:
    """Fit on at most ``max_rows`` labelled documents: of either class, toxic
    and clean, half as many or all there are, those whose ids hash lowest (the
    same ones on every run). Where that takes more of one class, clean ones
    weigh accordingly. ``grade_col`` names an ordinal label
    0, 1, ...; without one, grades are derived from the 0/1 label (see
    ``severity``). Rows without an id, a label or a text are passed over;
    repeated ids count as often as they occur. Without both classes the model
    has no weights and calls nothing toxic."""
    label = F.col(grade_col or label_col).cast("int")
    wanted = labels.select(F.col(id_col).alias("id"), label.alias("grade")).where("id IS NOT NULL AND grade IS NOT NULL")
    # The bounded sample: ids and grades of at most max_rows labels.
    total = wanted.agg(F.count_if(F.col("grade") > 0).alias("toxic"), F.count_if(F.col("grade") <= 0).alias("clean")).first()
    toxic_rows = min(total["toxic"], max(max_rows // 2, max_rows - total["clean"]))
    clean_rows = min(total["clean"], max_rows - toxic_rows)
    parts = [
        wanted.where(of).orderBy(F.xxhash64("id"), "id", "grade").limit(n)
        for of, n in (("grade > 0", toxic_rows), ("grade <= 0", clean_rows))
    ]
    chosen = cut_lineage(parts[0].unionByName(parts[1]))
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "id")
    fitted_on = cut_lineage(
        rows.select("id", "grade", (F.col("grade") > 0).alias("toxic"), terms_column(F.col("text")).alias("terms"))
    )
    names = indicative(fitted_on)
    levels = GRADES
    if grade_col:
        levels = max(1, fitted_on.agg(F.max("grade")).first()[0] or 1)
    if not names:
        return Ordinal({}, tuple(float(k) for k in range(1, levels + 1)))
    held = F.array_sort(F.array_intersect("terms", F.lit(names)))
    # Documents of one grade with the same terms are one row with a count.
    alike = fitted_on.groupBy("grade", held.alias("held")).agg(F.count(F.lit(1)).alias("n")).collect()
    weight = total["clean"] * toxic_rows / max(1, clean_rows * total["toxic"])  # of a clean row beside a toxic one
    place = {w: i for i, w in enumerate(sorted(names))}
    sample = sorted((r["grade"], [place[w] for w in r["held"]], r["n"]) for r in alike)
    toxic = np.array([g > 0 for g, _, _ in sample])
    count = np.array([n for _, _, n in sample], dtype=int)
    names = sorted(names)
    names = [names[i] for i in explaining([h for _, h, _ in sample], len(names), toxic, np.where(toxic, 1, weight) * count)]
    place = {place[w]: i for i, w in enumerate(names)}
    merged: Counter[tuple[int, tuple[int, ...]]] = Counter()
    for g, own, n in sample:
        merged[g, tuple(place[t] for t in own if t in place)] += n
    grade = np.array([g for g, _ in merged], dtype=int)
    words = [h for _, h in merged]
    count = np.array(list(merged.values()), dtype=int)
    toxic = grade > 0
    if not grade_col:
        grade = severity(np.array([len(h) for h in words]), toxic, count)
    features = np.zeros((len(words), len(names)), dtype=np.float32)
    for i, own in enumerate(words):
        features[i, list(own)] = 1
    weights, thresholds = fit_ordinal(features, grade, levels, np.where(toxic, 1, weight) * count)
    return Ordinal({w: float(x) for w, x in zip(names, weights, strict=True)}, tuple(float(x) for x in thresholds))


class _Chunks(dict):
    """Chunk of text between white space -> its terms with a weight, remembered."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.stems = sorted({len(w) - 1 for w in weights if w.endswith("*")})

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        words = _WORD.findall(chunk.lower())
        stems = (w[:k] + "*" for w in words for k in self.stems if k < len(w))
        found = tuple(w for w in (*words, *stems) if w in self.weights)
        if len(self) > _REMEMBERED:
            self.clear()
        if len(chunk) < 64:
            self[chunk] = found
        return found


def severity_column(model: Ordinal, text: Column) -> Column:
    """``struct<severity double, p_toxic double, grade int>`` of a text."""

    @F.arrow_udf("severity double, p_toxic double, grade int")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        chunks = _Chunks(model.weights)
        for texts in batches:
            score = np.zeros(len(texts))
            for i, t in enumerate(texts):
                found = {w for c in set((t.as_py() or "").split()) for w in chunks[c]}
                score[i] = sum(model.weights[w] for w in sorted(found))
            above = model.above(score)
            levels = np.concatenate([np.ones((len(score), 1)), above, np.zeros((len(score), 1))], axis=1)
            grade = np.argmax(levels[:, :-1] - levels[:, 1:], axis=1).astype("int32")
            columns = [pa.array(np.ascontiguousarray(x)) for x in (above.sum(axis=1), above[:, 0], grade)]
            yield pa.StructArray.from_arrays(columns, ["severity", "p_toxic", "grade"])

    return scored(text.cast("string"))


def score_toxicity(df: DataFrame, model: Ordinal, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The input's rows as ``struct row`` with ``severity`` (the expected
    grade), ``p_toxic``, ``grade`` (the likeliest) and ``toxic``.

    Whole texts are scored; null and empty ones have no terms and are scored
    as such. Repeated rows are scored alike, columns of any name and value are
    kept inside ``row``, and an empty table gives an empty result."""
    scored = df.select(whole_row(), severity_column(model, F.col(text_col)).alias("s"))
    return scored.select("row", "s.severity", "s.p_toxic", "s.grade", (F.col("s.p_toxic") >= limit).alias("toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by a model fitted on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", "severity", "p_toxic", "grade", "toxic")
