"""Tiled comparison of vectors against brute force."""

import numpy as np
import pytest

from docdrift.llm import embedding_dedup as E


def plain(rows, cosine=0.9):
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        x = np.array(v, dtype=float)
        return x / np.linalg.norm(x / np.abs(x).max()) / np.abs(x).max()

    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    root = [None] * n
    for i in range(n):
        if root[i] is None:
            todo, group = [i], []
            while todo:
                k = todo.pop()
                if root[k] is None:
                    root[k] = i
                    group.append(k)
                    todo += near[k]
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root[i]] = min(rows[i][0], least.get(root[i], rows[i][0]))
    out = []
    for i in range(n):
        c = least.get(root[i])
        out.append((rows[i][0], len(near[i]), c, None if None in (c, rows[i][0]) else c == rows[i][0]))
    return sorted(out, key=str)


def data(seed, n=300, width=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, width))
    picks = base[rng.integers(0, len(base), size=n)] + rng.normal(size=(n, width)) * rng.choice([0, 0.05, 0.25, 0.4], size=(n, 1))
    crowd = base[0] + rng.normal(size=(n // 3, width)) * 0.1  # one large group of near copies
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(np.concatenate([picks, crowd]).astype(np.float32))]


@pytest.mark.parametrize("block_rows", [32, 150, 16384])
def test_links_and_components(llm, block_rows):
    rows = data(block_rows)
    odd = [
        (9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23),
        (9005, [float("inf")] + [1.0] * 23), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e-300, 2e-300]), (9009, [1.0, 1.9]),
        (None, [1.0, 2.0]), (None, [-5.0, 1.0]), (5, rows[5][1]), (5, rows[5][1]), (8999, [1e300, 2e300]),
    ]
    rows += odd
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as key", "2 as size")
    got = E.embedding_dedup(df, block_rows=block_rows).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert E.embedding_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("square", [2, 5])
def test_squares_of_blocks_and_files_of_few_rows(llm, monkeypatch, square):
    """Many small blocks: each travels once for each square it is needed in."""
    rows = data(square)
    sent = []
    compared = E._compared

    def counted(blocks, basis, cosine, side):
        sent.append(blocks.count())
        return compared(blocks, basis, cosine, side)

    monkeypatch.setattr(E, "_compared", counted)
    monkeypatch.setattr(E, "VECTORS_IN_FILE", 40)
    monkeypatch.setattr(E, "ROWS_IN_FILE", 100)
    # Blocks are bounded in bytes as well as in rows.
    monkeypatch.setattr(E, "BLOCK_BYTES", 10 * 24 * 8)
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = E.embedding_dedup(df, square=square).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    assert sent[0] >= len({tuple(v) for _, v in rows}) / 10


def test_only_unusable_vectors(llm):
    df = llm.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, E.embedding_dedup(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_query_against_brute_force(llm):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, list(r.embedding)) for r in llm.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in E.op10_embedding_dedup(llm, sf).collect()), key=str) == plain(rows)
