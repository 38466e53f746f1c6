"""Calls of one task: overlap, order, and the breakers."""

import sys
import tempfile
import threading
import time

from pyspark import cloudpickle
from pyspark.sql import functions as F

from docdrift.operators import requests as RQ

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def test_calls_overlap_and_keep_their_order():
    running, most, lock = [0], [0], threading.Lock()

    def slow(request):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.3 if request == "0" else 0.02)
        with lock:
            running[0] -= 1
        if request == "7":
            raise ValueError("seven")
        return request + "!"

    start = time.time()
    got = RQ._Calls(slow, 8, None, 20).over([str(k) for k in range(40)])
    assert most[0] == 8 and time.time() - start < 0.8  # one after the other: over one second
    assert got == [(f"{k}!", None) if k != 7 else (None, "ValueError: seven") for k in range(40)]


def test_a_task_stops_at_a_broken_endpoint():
    asked = []

    def broken(request):
        asked.append(request)
        raise OSError("down")

    got = RQ._Calls(broken, 4, 0.5, 10).over([str(k) for k in range(200)])
    assert 10 <= len(asked) <= 14
    assert {e for _, e in got[: len(asked)]} == {"OSError: down"} and {e for _, e in got[len(asked) :]} == {RQ.NOT_ASKED}
    assert RQ._Calls(broken, 4, None, 10).over([]) == []


def test_single_calls_stay_in_the_tasks_thread():
    def caller(request):
        return str(threading.get_ident())

    assert RQ._Calls(caller, 1, None, 20).over(["a", "b"]) == [(str(threading.get_ident()), None)] * 2


def test_one_call_at_a_time_stops_at_a_broken_endpoint():
    asked = []

    def broken(request):
        asked.append(request)
        raise OSError("down")

    got = RQ._Calls(broken, 1, 0.5, 10).over([str(k) for k in range(50)])
    assert len(asked) == 10 and got == [(None, "OSError: down")] * 10 + [(None, RQ.NOT_ASKED)] * 40


def _requests(spark, n):
    return spark.range(n).select(
        F.lit("r").alias("repo"), F.concat(F.lit("d"), "id").alias("path"), F.concat(F.lit("h"), "id").alias("request_hash"),
        F.col("id").cast("string").alias("request_json"),
    )


def down(request):
    raise OSError("down")


def up(request):
    return "reply " + request


def test_parts_behind_a_broken_one_are_asked_in_the_next_run(spark):
    store = tempfile.mkdtemp(prefix="docdrift-calls-", dir="/tmp") + "/replies"
    part = F.col("request_json").cast("int") % 4
    first = RQ.complete_requests(_requests(spark, 120), down, store=store, batches=4, batch_of=part, breaker=0.5, parallel=3)
    errors = {r.path: r.error for r in first.collect()}
    assert all(errors[f"d{k}"] == ("OSError: down" if k % 4 == 0 else RQ.NOT_ASKED) for k in range(120))
    again = RQ.complete_requests(_requests(spark, 120), up, store=store, batches=4, batch_of=part, breaker=0.5, parallel=3)
    assert {(r.path, r.body, r.error) for r in again.collect()} == {(f"d{k}", f"reply {k}", None) for k in range(120)}


def test_few_failures_break_nothing(spark):
    store = tempfile.mkdtemp(prefix="docdrift-calls-", dir="/tmp") + "/replies"
    part = F.col("request_json").cast("int") % 2
    few = RQ.complete_requests(_requests(spark, 10), down, store=store, batches=2, batch_of=part, breaker=0.5)
    assert {r.error for r in few.collect()} == {"OSError: down"}  # fewer calls than ``min_calls``
