"""Packed products and mined negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docdrift.llm import hard_negatives as H


def ints(v, scale=256):
    if v is None or None in v or not all(math.isfinite(scale * x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def plain(rows):
    rows = [(i, lab, ints(v)) for i, lab, v in rows]
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    least, most = -(1 << 63), (1 << 63) - 1
    out = []
    for k, (anchor, label, a) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(min(most, max(least, sum(x * y for x, y in zip(a, v, strict=True)))), i, lab) for j, (i, lab, v) in enumerate(rows) if j != k and len(v) == len(a)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1]))
        for p, pid, _ in [s for s in scored if s[2] == label][:5]:
            fits = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p]
            out += [(anchor, pid, r + 1, n[1], p, n[0]) for r, n in enumerate(fits[:3])]
    return sorted(out, key=str)


def mined(df):
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()), key=str)


@pytest.mark.parametrize("size", [0.5, 90.0, 2.0**40, 1e150])
def test_packed_products_are_exact(size):
    rng = np.random.default_rng(int(math.log(size) * 10) % 97)
    rows, anchors = (np.floor(rng.normal(size=(n, 24)) * size) for n in (37, 5))
    for low in (rows, np.abs(rows)):
        packed = H.Packed(low, int(anchors.min()), int(anchors.max()))
        assert (packed.fields >= 2) == (size < 2.0**40)
        for a, got in zip(anchors, packed.scores(anchors), strict=True):
            exact = [sum(int(x) * int(y) for x, y in zip(a, r, strict=True)) for r in low]
            assert got.tolist() == [min(H._MOST, max(H._LEAST, e)) for e in exact]


def data(seed, n=400, width=12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(width)] for _ in range(4)]
    rows = []
    for i in range(n):
        c = centres[0 if rng.random() < 0.4 else rng.randrange(4)]
        spread = 0 if rng.random() < 0.2 else 0.2  # equal vectors: ties
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), [x + rng.gauss(0, spread) for x in c]))
    return rows


ODD = [
    (1000, None, [1.0] * 12), (1050, 1, None), (1100, 1, [None] + [0.1] * 11), (1150, 2, [float("nan")] + [0.1] * 11),
    (1200, 2, [float("inf")] + [0.1] * 11), (None, 1, [0.1] * 12), (None, 2, [0.05] * 12), (1250, 1, [0.1] * 12), (1250, 1, [0.1] * 12),
    (1300, 9, []), (1301, 9, []), (1302, 8, []), (1350, 1, [0.5, 0.5]), (1351, 1, [0.5, 0.5]), (1352, 2, [0.4, 0.4]),
    (1400, 5, [-0.1] * 12), (1401, 5, [0.1] * 12), (1450, 6, [1e307] * 12),
]


@pytest.mark.parametrize("small", [H.SMALL_BUCKET, 4000])
def test_against_brute_force(llm, monkeypatch, small):
    monkeypatch.setattr(H, "SMALL_BUCKET", small)
    monkeypatch.setattr(H, "BUCKET", 8 * small)
    rows = data(small) + ODD
    df = llm.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS id", "2 AS rid", "3 AS score")
    expected = plain(rows)
    assert len(expected) > 20 and mined(df.repartition(5)) == expected
    assert mined(df.limit(0)) == [] and mined(df.where("label = 2")) == []


def test_very_large_components(llm):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(1, 0.2) * 1e18 for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, i % 2, [rng.gauss(1, 0.2) * 5e3 for _ in range(6)]) for i in range(120)]
    df = llm.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == plain(rows)


def test_query_against_brute_force(llm):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.label, list(r.embedding)) for r in llm.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows]
    got = H.op12_hard_negatives(llm, sf)
    assert dict(got.dtypes) == {"rank": "int"} | dict.fromkeys(["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"], "bigint")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)
