"""Ordinal severity: the model, its training sample and held-out accuracy."""

import numpy as np
from pyspark.sql import functions as F

from docdrift.llm import toxicity as T


def test_fit_finds_shared_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 5)) < 0.4).astype(np.float32)
    true = np.array([2.5, 1.5, 0.0, -1.0, 0.5])
    latent = x @ true + rng.logistic(size=4000)
    grade = np.digitize(latent, [1.0, 3.0, 4.5])
    w, cuts = T.fit_ordinal(x, grade, 3)
    assert np.all(np.diff(cuts) > 0)
    assert np.allclose(w, true, atol=0.35) and np.allclose(cuts, [1.0, 3.0, 4.5], atol=0.35)


def test_gradient_is_that_of_the_likelihood():
    model = T.Ordinal({}, (0.0, 1.0, 2.0))
    above = model.above(np.array([0.0, 50.0, -50.0]))
    assert np.allclose(above[0], 1 / (1 + np.exp([0.0, 1.0, 2.0])))
    assert (np.diff(above, axis=1) <= 0).all()


def test_indicative_terms_need_cause(llm):
    rng = np.random.default_rng(1)
    rows = [(i < 100, sorted({f"w{k}" for k in rng.integers(0, 400, size=20)})) for i in range(1000)]
    for i in range(100):
        rows[i][1].append("bad" if i % 2 else "worse")
    schema = "toxic boolean, terms array<string>"
    assert sorted(T.indicative(llm.createDataFrame(rows, schema))) == ["bad", "worse"]
    assert T.indicative(llm.createDataFrame([(False, w) for _, w in rows], schema)) == []
    assert T.indicative(llm.createDataFrame([], schema)) == []


def test_severity_grows_with_toxic_terms():
    one = np.ones(4, dtype=int)
    assert T.severity(np.array([0, 1, 2, 3]), np.array([False, True, True, True]), one).tolist() == [0, 1, 2, 3]


def test_counted_rows_fit_like_repeated_ones():
    rng = np.random.default_rng(3)
    x = (rng.random((50, 3)) < 0.5).astype(np.float32)
    grade, count = rng.integers(0, 3, size=50), rng.integers(1, 5, size=50)
    a = T.fit_ordinal(x, grade, 2, count)
    b = T.fit_ordinal(np.repeat(x, count, axis=0), np.repeat(grade, count), 2)
    assert np.allclose(a[0], b[0], atol=1e-3) and np.allclose(a[1], b[1], atol=1e-3)


def corpus(llm):
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = " ".join(f"w{(i * 7 + k) % 97}" for k in range(30)) + (" Vile, nasty!" if bad else "")
        rows.append((i, text, "x"))
        labels.append((i, int(bad)))
    return llm.createDataFrame(rows, "doc_id long, text string, severity string"), llm.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_of_odd_tables(llm):
    docs, labels = corpus(llm)
    labels = labels.unionByName(llm.createDataFrame([(None, 1), (1, None), (99_999, 1)], "doc_id long, toxic int"))
    model = T.train(docs, labels)
    assert set(model.weights) == {"vile", "nasty"}
    odd = llm.createDataFrame([(1, None, "a"), (2, "", None), (3, "VILE\nnasty", "b"), (3, "VILE\nnasty", "b"), (None, "w1 " * 200_000 + "nasty vile", "c")], docs.schema)
    got = T.score_toxicity(odd, model).select("row.doc_id", "row.severity", F.col("severity").alias("s"), "toxic").collect()
    assert sorted((str(r.doc_id), r.severity, r.toxic) for r in got) == [("1", "a", False), ("2", None, False), ("3", "b", True), ("3", "b", True), ("None", "c", True)]
    assert all(0 <= r.s <= T.GRADES for r in got)
    assert T.score_toxicity(odd.limit(0), model).collect() == []
    none = T.train(docs, labels.where("toxic = 0"))
    assert not none.weights and not any(r.toxic for r in T.score_toxicity(odd, none).collect())
    graded = T.train(docs, labels.selectExpr("doc_id", "toxic * 2 as level"), grade_col="level")
    assert len(graded.thresholds) == 2


def test_training_sample_is_bounded_and_repeatable(llm):
    docs, labels = corpus(llm)
    a, b = T.train(docs, labels, max_rows=300), T.train(docs.repartition(7), labels.repartition(5), max_rows=300)
    assert a.weights == b.weights and a.thresholds == b.thresholds


def test_held_out_accuracy(llm):
    sf = "/root/testdata/sf0.1"
    docs, labels = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/labels.parquet")
    model = T.train(docs, labels.where("doc_id % 5 <> 0"))
    held = docs.join(labels.where("doc_id % 5 = 0").selectExpr("doc_id", "toxic as label"), "doc_id")
    counts = {(r.label, r.toxic): r["count"] for r in T.score_toxicity(held, model).groupBy("row.label", "toxic").count().collect()}
    assert counts.get((0, True), 0) <= 0.01 * counts[0, False]
    assert counts[1, True] >= 0.85 * (counts[1, True] + counts.get((1, False), 0))


def test_endings_that_are_rare_alone_are_found_by_their_stem(llm):
    def text(i, ending):
        return " ".join(f"w{(i * 7 + k) % 97}" for k in range(30)) + f" bomente{ending}"

    def ending(i):
        return "".join("aeiou"[i // 10 // 5**k % 5] for k in range(4))

    rows = [(i, text(i, ending(i)) if i % 10 == 0 else text(i, "")[:-8]) for i in range(400)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i % 10 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    new = llm.createDataFrame([(1, text(1, "xyz")), (2, text(2, "")[:-8]), (3, "w1 bom")], docs.schema)
    assert {r.doc_id: r.toxic for r in T.score_toxicity(new, model).select("row.doc_id", "toxic").collect()} == {1: True, 2: False, 3: False}


def test_bounded_sample_holds_the_rare_class(llm):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(30)) + (" vile" if i % 100 == 0 else "")) for i in range(2000)]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    labels = llm.createDataFrame([(i, int(i % 100 == 0)) for i in range(2000)], "doc_id long, toxic int")
    model = T.train(docs, labels, max_rows=100)
    assert set(model.weights) == {"vile"}
    assert sum(r.toxic for r in T.score_toxicity(docs, model).collect()) == 20


def test_recall_in_every_language(llm):
    sf = "/root/testdata/sf0.1"
    docs, labels = llm.read.parquet(f"{sf}/documents.parquet"), llm.read.parquet(f"{sf}/labels.parquet")
    model = T.train(docs, labels.where("doc_id % 5 <> 0"))
    held = docs.join(labels.where("toxic = 1 AND doc_id % 5 = 0").select("doc_id"), "doc_id")
    found = T.score_toxicity(held, model).groupBy("row.lang").agg(F.avg(F.col("toxic").cast("int")).alias("recall")).collect()
    assert {r.lang for r in found} == {"de", "en", "es", "fr"} and all(r.recall >= 0.5 for r in found)
