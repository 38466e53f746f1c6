"""Plan checks: core keys plan without Cartesian products, nested-loop joins,
row-at-a-time Python UDFs or single-partition exchanges, and scans read
only the columns they need."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"

CORE = [
    "snapshot_diff",
    "detect_renames",
    "summary_compact",
    "changed_files",
    "select_docs",
    "match_prefixes",
    "apply_edits",
    "validate_updates",
    "mine_declarations",
    "final_attempt",
    "build_requests",
]


def _plan(spark, key):
    df = queries()[key](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def _indent(line):
    i = line.find("+-")
    return i if i >= 0 else len(line) - len(line.lstrip(" :"))


def _outside_subqueries(plan):
    """Plan lines that are not inside a scalar subquery. A subquery over a
    bounded set (the distinct mapping-prefix lengths) may end in a
    single-partition merge of a few hundred values; the main plan may not."""
    out, sub_indent = [], None
    for line in plan.split("\n"):
        ind = _indent(line)
        if sub_indent is not None and ind > sub_indent:
            continue
        sub_indent = ind if "Subquery subquery" in line else None
        if sub_indent is None:
            out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("key", CORE)
def test_no_bad_operators(spark, key):
    plan = _plan(spark, key)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan, (key, bad)
    assert "SinglePartition" not in _outside_subqueries(plan), key


def test_hash_scan_prunes_content(spark):
    from docdrift.operators import changes as C
    from docdrift.plans import bindings as B

    ch = C.changed_paths(B.code_snapshot(spark, SF, "old"), B.code_snapshot(spark, SF, "new"))
    plan = ch._jdf.queryExecution().executedPlan().toString()
    # only the documents' key and text feed the hash; no unrelated columns are read
    assert "n_chars" not in plan


@pytest.mark.parametrize("key", ["changed_docs", "validate_updates"])
def test_edit_fold_is_planned_once(spark, key):
    plan = queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 1, key


def test_selection_moves_no_text(spark):
    plan = _plan(spark, "select_docs")
    for line in plan.split("\n"):
        assert not ("Exchange" in line and "text#" in line)


def test_lineage_is_cut_only_in_a_named_folder():
    from types import SimpleNamespace

    from docdrift.session import checkpoint_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=context))
