"""Final attempts of logs of different length, and the order of diffs."""

from docdrift.operators import attempts as AT
from docdrift.operators import diff as D


def test_outcome_depends_on_the_attempts_left(spark):
    logs = {
        "one": [True], "four": [True] * 4, "five": [True] * 5, "late": [True, True, True, False], "bad": [True, False, True],
    }
    rows = [
        (q, i, 503 if retry else 200, "server_error" if retry else "ok", retry, f"m{i}")
        for q, log in logs.items() for i, retry in enumerate(log)
    ]
    df = spark.createDataFrame(rows, "request_id string, attempt int, status int, outcome string, retryable boolean, message string")
    got = {r["request_id"]: (r["final_outcome"], r["final_attempt"], r["succeeded"]) for r in AT.final_attempt(df).collect()}
    assert got == {
        "one": ("unfinished", 0, False), "four": ("exhausted", 3, False), "five": ("exhausted", 3, False),
        "late": ("ok", 3, True), "bad": ("ok", 1, True),
    }


def test_diffs_are_ordered_by_file_change_and_name(spark):
    keys = [("r", "b.go", 0, "A"), ("r", "a.go", 2, "B"), ("r", "a.go", 0, "Z"), ("q", "z.go", 1, "C"), ("r", "a.go", 0, "Y")]
    df = spark.createDataFrame(keys, "repo string, path string, change_ord int, name string").repartition(4)
    assert [tuple(r) for r in D.order_diffs(df).collect()] == sorted(keys)
