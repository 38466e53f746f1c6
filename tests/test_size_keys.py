"""The size keys measure all documents and the selection of a run."""

import pytest

from __spark_entry__ import queries

TEXT = "0123456789" * 2


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sizes")
    rows = [(k, "a", "src1", TEXT) for k in range(1, 31)] + [(k, "b", "src2", TEXT) for k in (104, 105, 106)]
    rows += [(k, "c", "src2", None if k == 205 else TEXT) for k in (204, 205)] + [(306, None, "src3", TEXT), (117, "d", "src3", TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_selection_is_sized_beside_all_documents(spark, sf):
    got = {r.repo: tuple(r)[1:] for r in queries()["token_estimate"](spark, sf).collect()}
    # a: mapped by a number divisible by 3, not by 9 (.txt) or 13; b: no change, so all but 104 (left out by 13)
    assert got["a"] == (30, 600, 150, 7, 140, 35)
    assert got["b"] == (3, 60, 15, 2, 40, 10)
    assert got["c"] == (2, 20, 5, 2, 20, 5)
    assert got[None] == (1, 20, 5, 0, 0, 0) and got["d"] == (1, 20, 5, 0, 0, 0)


def test_selection_is_gated_beside_all_documents(spark, sf):
    gate = {r.repo: r.asDict() for r in queries()["budget_gate"](spark, sf).collect()}
    assert gate["a"]["selected_tokens"] == 35 and gate["d"]["n_selected"] == 0
    assert all(r["within_budget"] and r["selected_within_budget"] for r in gate.values())
