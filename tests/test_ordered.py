"""Running totals over ranges, texts in parts, and the ordered budget cut."""

import random

import pytest

from docdrift.operators import select as M
from docdrift.operators import summary as A
from docdrift.operators.ordered import totals_before

from collected import rows


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_totals_do_not_depend_on_the_ranges(spark, ranges):
    rng = random.Random(ranges)
    data = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", k, rng.randrange(100)) for k in range(600)]
    df = spark.createDataFrame(data, "g string, k int, n int").repartition(7)
    seen, expected = {}, []
    for g, k, n in data:
        expected.append((g, k, n, seen.get(g, 0)))
        seen[g] = seen.get(g, 0) + n
    assert rows(totals_before(df, ["g"], ["k"], "n", "before", ranges)) == sorted(expected)
    assert totals_before(df.limit(0), ["g"], ["k"], "n", "before", ranges).collect() == []


def _diffs(spark):
    rng, out = random.Random(1), []
    for k in range(400):
        repo = "hot" if k % 3 else f"r{k % 5}"
        out.append((repo, f"p{k % 37}.go", f"N{k}", "", rng.choice([0, 1, 3]), "func", f"func N{k}(é)", f"func O{k}()", []))
    schema = (
        "repo string, path string, name string, old_name string, change_ord int, kind string, signature string, old_signature string, "
        "changes array<struct<ord:int,aspect:string,description:string>>"
    )
    return spark.createDataFrame(out, schema).repartition(6)


@pytest.mark.parametrize(("part_bytes", "ranges"), [(100, 9), (100, 1), (4000, 3), (1 << 20, None)])
def test_parts_are_the_text(spark, part_bytes, ranges):
    diffs, repos = _diffs(spark), spark.createDataFrame([("hot",), ("quiet",)], "repo string")
    for parts_of, text_of in ((A.compact_parts, A.summary_compact), (A.verbose_parts, A.summary_verbose)):
        parts = {}
        for r in sorted(parts_of(diffs, repos, part_bytes, ranges).collect(), key=lambda r: r.part):
            so_far = parts.setdefault(r.repo, "")
            assert r.offset == len(so_far.encode()) and r.part == r.offset // part_bytes
            parts[r.repo] = so_far + r.text
        expected = dict(rows(text_of(diffs, repos)))
        assert set(expected) == {"hot", "quiet"} and {k: parts[k] for k in expected} == expected


def test_a_large_text_is_spread(spark):
    parts = A.compact_parts(_diffs(spark), part_bytes=200, ranges=8).where("repo = 'hot'")
    assert parts.count() > 20 and max(len(r.text.encode()) for r in parts.collect()) < 2000


def test_what_fits_is_a_beginning(spark):
    docs = spark.createDataFrame([("r", f"d{k}", "x" * 40) for k in range(9)] + [("s", "a", None), ("s", "b", "")], "repo string, path string, content string")
    got = {(r.repo, r.path): (r.bytes_before, r.fits) for r in M.budget_cut(docs, max_tokens=35, ranges=4).collect()}
    assert [got["r", f"d{k}"] for k in range(9)] == [(40 * k, k < 3) for k in range(9)]
    assert got["s", "a"] == (0, True) and got["s", "b"] == (0, True)
    gate = {r.repo: r.within_budget for r in M.budget_gate(M.token_estimate(docs), 35).collect()}
    assert gate["r"] is False and gate["s"] is True
    assert {r.repo for r in M.docs_within_budget(docs, 35).collect()} == {"s"}
