"""Bodies of requests: put together at the call, a summary once for each task."""

import json
import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import functions as F

from docdrift.operators import requests as RQ
from docdrift.plans.q_requests import failing_completer, local_completer
from docdrift.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMMARIES = [
    ("a", 'added pkg/a.go\nremoved pkg/"é\\\x01".go'),
    ("b", 'modified <DOCUMENT path="pkg/9.md">\nfirst'),
    ("c", "added pkg/\U0001f600.go\n" * 50),
    ("d", ""),
]


def _summaries(spark):
    return spark.createDataFrame(SUMMARIES, "repo string, summary string")


def _requests(spark, summaries):
    docs = [(r, f"docs/{k}.md", t) for r in "abcde" for k, t in enumerate(["one two", "", ' "q" \\ é\n', None, "</CODE_CHANGES>"] * 3)]
    docs = spark.createDataFrame(docs, "repo string, path string, content string")
    return RQ.request_json(RQ.build_requests(docs, summaries, model="m", parts={"TONE": 'as "is"\t'}))


def _same(request):
    return request


class Keeping:
    """Says which beginning it was given, and refuses whole bodies of
    requests that have one."""

    def __call__(self, request):
        assert "CODE_CHANGES" not in request
        return request

    def after(self, beginning):
        name = uuid.uuid4().hex
        return lambda rest: json.dumps([name, beginning + rest])


def test_plain_completers_get_whole_bodies(spark):
    summaries = _summaries(spark)
    requests = _requests(spark, summaries)
    whole = requests.join(summaries, "repo").select("repo", "path", RQ.request_body("request_json", F.col("summary")).alias("body"))
    want = {(r.repo, r.path): r.body for r in whole.collect()}
    assert len(want) == 60
    for options in ({}, {"concurrency": 2}, {"store": tempfile.mkdtemp(prefix="docdrift-bodies-", dir="/tmp") + "/r", "batches": 2, "parallel": 3}):
        got = RQ.complete_requests(requests, _same, summaries, **options).collect()
        assert {(r.repo, r.path): r.body for r in got} == want and {r.error for r in got} == {None}, options


def test_a_task_gets_a_beginning_once(spark):
    summaries = _summaries(spark)
    requests = _requests(spark, summaries)
    want = {r.body for r in RQ.complete_requests(requests, _same, summaries).collect()}
    got = [r.body for r in RQ.complete_requests(requests, Keeping(), summaries, concurrency=2).collect()]
    kept = [json.loads(b) for b in got if b.startswith("[")]
    assert len(kept) == 48 and {b for _, b in kept} <= want
    assert len({name for name, _ in kept}) <= 2 * len(SUMMARIES)


def test_requests_without_their_summary_are_not_sent(spark):
    summaries = _summaries(spark)
    some = summaries.filter("repo <> 'c'")
    got = RQ.complete_requests(_requests(spark, summaries), _same, some).collect()
    assert {r.repo for r in got} == {"a", "b", "d"}


def test_a_beginning_is_read_as_part_of_the_whole(spark):
    requests = _requests(spark, _summaries(spark)).join(_summaries(spark), "repo").filter("path not like '%/3.md' and path not like '%/8.md'")
    rows = requests.select(RQ.body_parts("request_json").alias("b"), RQ.summary_part("summary").alias("s")).filter("b.tail is not null").collect()
    assert len(rows) == 48
    for completer in (local_completer, failing_completer):
        for r in rows:
            ends = []
            for call in (lambda: completer(r.b.head + r.s + r.b.tail), lambda: completer.after(r.b.head + r.s)(r.b.tail)):
                try:
                    ends.append(call())
                except ConnectionError as exc:
                    ends.append(str(exc))
            assert ends[0] == ends[1]


def test_parts_do_not_build_their_requests_again(spark):
    seen = tempfile.mkdtemp(prefix="docdrift-bodies-", dir="/tmp")

    def noted(pdfs):
        open(os.path.join(seen, uuid.uuid4().hex), "w").close()
        yield from pdfs

    schema = "repo string, path string, request_hash string, request_json string"
    one = F.col("id").cast("string")
    requests = spark.range(0, 40, 1, 1).select(F.lit("r").alias("repo"), one.alias("path"), one.alias("request_hash"), one.alias("request_json"))
    got = RQ.complete_requests(requests.mapInPandas(noted, schema), _same, store=seen + "-replies", batches=4)
    assert {(r.path, r.body) for r in got.collect()} == {(str(k), str(k)) for k in range(40)}
    assert len(os.listdir(seen)) == 1


class Whole:
    """``local_completer`` for whole bodies only."""

    def __call__(self, request):
        return local_completer(request)


def test_replies_are_those_to_whole_bodies(spark):
    summaries = _summaries(spark)
    requests = _requests(spark, summaries)
    assert hasattr(local_completer, "after") and not hasattr(Whole(), "after")
    replies = [RQ.complete_requests(requests, c, summaries, concurrency=3).collect() for c in (local_completer, Whole())]
    by_path = [{(r.repo, r.path): (r.body, r.error) for r in rows} for rows in replies]
    assert by_path[0] == by_path[1] and len(by_path[0]) == 60
    # without a document's text there is no user text
    assert {e for (_, p), (_, e) in by_path[0].items() if p == "docs/3.md"} == {"KeyError: 'content'"}


def test_a_request_without_a_part_is_asked_with_its_copy(spark):
    schema = "repo string, path string, request_hash string, request_json string, n int"
    rows = [("r", "a", "h", "x", None), ("r", "b", "h", "x", 1), ("r", "c", "g", "y", 0), ("r", "d", "f", "z", None)]
    store = tempfile.mkdtemp(prefix="docdrift-bodies-", dir="/tmp") + "/r"
    got = RQ.complete_requests(spark.createDataFrame(rows, schema), _same, store=store, batches=2, batch_of=F.col("n"))
    assert sorted((r.path, r.body) for r in got.collect()) == [("a", "x"), ("b", "x"), ("c", "y")]


def _once(spark, rows):
    stored = cut_lineage(spark.createDataFrame(rows, "_id long, request_hash string, _part int, request_json string"))
    return RQ.once_each(stored)


def test_distinct_requests_are_not_dealt_out_to_find_copies(spark):
    once = _once(spark, [(k, f"h{k}", k % 3, f"text {k}") for k in range(200)])
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan, plan
    assert once.count() == 200


def test_a_request_is_kept_once_however_many_copies(spark):
    rows = [(k, "hot", 2 if k % 2 else None, "x") for k in range(500)] + [(500, "hot", 1, "x"), (501, "one", None, "y")]
    rows += [(502, "two", None, "z"), (503, "two", None, "z"), (504, None, 0, "n"), (505, None, 0, "n")]
    got = sorted((r.request_hash or "", r._part, r._id) for r in _once(spark, rows).collect())
    assert got == [("", 0, 504), ("hot", 1, 500), ("one", None, 501), ("two", None, 502)]
