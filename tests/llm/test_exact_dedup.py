"""Exact duplicates against a plain dictionary."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from docdrift.llm import exact_dedup as X


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = Counter()
    for text, own in groups.items():
        own.sort(key=lambda r: r[:3])
        digest = hashlib.sha256(text.encode()).hexdigest()
        for k, (_, _, _, i) in enumerate(own):
            out[i, own[0][3], len(own), k == 0, digest] += 1
    return out


ROWS = [
    (5, "a b"), (3, "ab"), (9, " a  b\n"), (9, " a  b\n"), (1, "a b"), (2, None), (4, ""), (None, " \t\x0b\x0c\r\n"),
    (None, "only"), (None, "only"), (7, "x" * 200_000), (8, "x" * 100_000 + " " + "x" * 100_000), (6, "é"), (10, "é"), (11, "A B"),
] + [(100 + i, "same text") for i in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]


@pytest.mark.parametrize("bits", [1, 32])
def test_groups(llm, bits):
    df = llm.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 as sha", "2 as rid", "3 as n").repartition(5)
    got = Counter(tuple(r) for r in X.exact_dedup(df, bits_per_row=bits).collect())
    assert got == plain(ROWS)


def test_empty_table(llm):
    df = llm.createDataFrame([], "doc_id long, text string")
    assert X.exact_dedup(df).collect() == []


def test_only_possible_repeats_are_suspects(llm):
    df = llm.range(4000).selectExpr("unhex(sha2(cast(if(id < 100, id % 50, id) as string), 256)) as sha", "id")
    flags = {r.id: r.suspect for r in X.possibly_repeated(df).collect()}
    assert all(flags[i] for i in range(100))
    assert sum(flags.values()) < 300  # few false reports


def test_plan_runs_no_python_and_moves_no_text(llm):
    plan = X.op2_exact_dedup(llm, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan
