"""Request building (P1-P5, S5) and the completion fan-out.

One request per document: the repository's change summary and the
document, wrapped in tags, behind a system text the caller composes from
named parts. A request names the summary by key; its text goes once to each
task that makes calls, not to each request.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, let, preview
from ..session import cut_lineage

# The comment pattern removed from documents, the tag order of
# the system text, and the separator between its parts.
COMMENT_PATTERN = r"<!--[\s\S]*?-->"
SYSTEM_TAGS = ["ROLE", "CONTEXT", "SCALE", "RULES", "TONE", "EDGE_CASES", "EXAMPLES"]
PART_SEPARATOR = "\n\n"

# Our own short default wording; callers pass their own parts.
DEFAULT_PARTS = {
    "ROLE": "You keep technical documents accurate after code changes.",
    "CONTEXT": "The code changes below were detected between two versions of a repository.",
    "SCALE": "Change only what the code changes make wrong.",
    "RULES": 'Answer with one JSON object {"edits": [...]}; each edit has file, action, old_text, new_text.',
    "TONE": "Keep the document's voice.",
    "EDGE_CASES": "If nothing needs to change, answer {\"edits\": []}.",
    "EXAMPLES": '{"edits": [{"file": "README.md", "action": "replace", "old_text": "Old()", "new_text": "New()"}]}',
}


def strip_comments(c) -> Column:
    """Remove every ``<!-- ... -->`` (non-greedy, across lines)."""
    return F.regexp_replace(col_(c), COMMENT_PATTERN, "")


def wrap(tag: str, c) -> Column:
    """``<TAG>\\n...\\n</TAG>``."""
    return F.concat(F.lit(f"<{tag}>\n"), col_(c), F.lit(f"\n</{tag}>"))


def wrap_doc(path, content) -> Column:
    """The document tag carries the path attribute (not escaped)."""
    return F.concat(F.lit('<DOCUMENT path="'), col_(path), F.lit('">\n'), col_(content), F.lit("\n</DOCUMENT>"))


def wrap_code_diff(summary) -> Column:
    return wrap("CODE_CHANGES", summary)


def system_text(parts: dict[str, str] | None = None) -> str:
    """The system text - the seven named parts, each wrapped in its tag,
    joined by a blank line. Built once on the driver from the caller's
    configuration (a few kilobytes)."""
    parts = {**DEFAULT_PARTS, **(parts or {})}
    return PART_SEPARATOR.join(f"<{t}>\n{parts[t]}\n</{t}>" for t in SYSTEM_TAGS)


def system_texts(parts: DataFrame) -> DataFrame:
    """P3 for a table of parts ``(repo, tag, text)``: ``repo, system_text``,
    the named parts in their fixed order, each in its tag, joined by a blank
    line. A part that a repository does not set has the default text; unknown
    tags are left out; of several texts for one tag the smallest counts. At
    most seven parts a repository."""
    given = F.map_from_entries(F.collect_list(F.struct("tag", "text")))
    one = parts.filter(F.col("tag").isin(SYSTEM_TAGS)).groupBy("repo", "tag").agg(F.min("text").alias("text"))
    named = parts.select("repo").distinct().join(one.groupBy("repo").agg(given.alias("g")), "repo", "left")
    texts = [wrap(t, F.coalesce(F.try_element_at("g", F.lit(t)), F.lit(DEFAULT_PARTS[t]))) for t in SYSTEM_TAGS]
    return named.select("repo", F.concat_ws(PART_SEPARATOR, *texts).alias("system_text"))


def build_requests(
    docs: DataFrame,
    summaries: DataFrame,
    model: str = "",
    parts: dict[str, str] | None = None,
    max_tokens: int = 0,
    temperature: float = 0.0,
) -> DataFrame:
    """``docs(repo, path, content)`` of the repositories in
    ``summaries(repo, summary)`` -> ``repo, path, request``: model, messages
    (system, and the wrapped document as user), ``summary_key``, max_tokens
    (null when 0, so it is left out of the JSON) and temperature.

    A request names its repository's summary by key and does not hold it: the
    summary is one text per repository, and a copy in each document's row
    would grow with the square of the repository. ``request_body`` puts it in
    front of the document when the request is sent.

    The keys, a short row per repository, are stored: few are then broadcast,
    and where many are not, the join reads both sides straight from their
    exchanges, so the documents of a large repository can be split."""
    sys_text = system_text(parts)
    keyed = cut_lineage(summaries.select("repo", F.sha2("summary", 256).alias("summary_key")))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(sys_text).alias("content")),
        F.struct(F.lit("user").alias("role"), wrap_doc(F.col("path"), strip_comments(F.col("content"))).alias("content")),
    )
    request = F.struct(
        F.lit(model).alias("model"),
        messages.alias("messages"),
        F.col("summary_key"),
        (F.lit(max_tokens) if max_tokens else F.lit(None)).cast("int").alias("max_tokens"),
        F.lit(float(temperature)).cast("double").alias("temperature"),
    )
    return docs.join(keyed, "repo").select("repo", "path", request.alias("request"))


def request_json(requests: DataFrame) -> DataFrame:
    """The request as JSON text (``max_tokens`` omitted when null,
    ``temperature`` always present), its ``summary_key`` and its SHA-256 as
    ``request_hash`` (which covers the summary through its key)."""
    return requests.select(
        "repo", "path", F.col("request.summary_key").alias("summary_key"),
        let(F.to_json("request"), lambda j: F.struct(j.alias("j"), F.sha2(j, 256).alias("h"))).alias("_r"),
    ).select("repo", "path", "summary_key", F.col("_r.j").alias("request_json"), F.col("_r.h").alias("request_hash"))


_REQUEST = (
    "model string, messages array<struct<role string, content string>>, summary_key string, max_tokens int, temperature double"
)


def request_body(json_text, summary) -> Column:
    """The body to send: the change summary, a blank line and the document as
    the user message; the key is left out."""

    def full(r):
        user = F.concat(wrap_code_diff(summary), F.lit("\n\n"), r["messages"][1]["content"])
        messages = F.array(r["messages"][0], F.struct(F.lit("user").alias("role"), user.alias("content")))
        return F.to_json(
            F.struct(r["model"].alias("model"), messages.alias("messages"), r["max_tokens"].alias("max_tokens"), r["temperature"].alias("temperature"))
        )

    return let(F.from_json(col_(json_text), _REQUEST), full)


def body_parts(json_text) -> Column:
    """``request_body`` in parts, ``struct<head, tail>``: ``summary_part`` goes
    between them. The body of a request without a document's text has no user
    text: all of it is ``head``, and ``tail`` is null."""

    def cut(r):
        system, user = r["messages"][0], r["messages"][1]["content"]
        model, limits = r["model"].alias("model"), [r[k].alias(k) for k in ("max_tokens", "temperature")]
        messages = F.array(system, F.struct(F.lit("user").alias("role"), user.alias("content")))
        before = F.to_json(F.struct(model, F.array(system).alias("messages")))
        # all but its closing brackets, then the user message up to its text
        n = F.length(before) - 2 + len(',{"role":"user","content":"')
        return let(
            F.struct(F.to_json(F.struct(model, messages.alias("messages"), *limits)).alias("body"), F.when(user.isNotNull(), n).alias("n")),
            lambda b: F.struct(
                F.when(b["n"].isNull(), b["body"]).otherwise(F.substring(b["body"], F.lit(1), b["n"])).alias("head"),
                F.substring(b["body"], b["n"] + 1, F.length(b["body"])).alias("tail"),
            ),
        )

    return let(F.from_json(col_(json_text), _REQUEST), cut)


def summary_part(summary) -> Column:
    """The summary as it stands in the JSON text of ``request_body``."""
    text = F.to_json(F.array(F.concat(wrap_code_diff(summary), F.lit("\n\n"))))
    return let(text, lambda j: F.substring(j, F.lit(3), F.length(j) - 4))


def write_requests(requests_json: DataFrame, out_path: str) -> None:
    """S5 (sink): JSON lines partitioned by repository."""
    requests_json.write.mode("overwrite").partitionBy("repo").json(out_path)


def preview_text(c, n: int = 500, suffix: str = "\n...(truncated)") -> Column:
    """P5: text over ``n`` bytes cut to ``n`` characters plus a suffix."""
    return preview(c, n, suffix)


# --- R0 -----------------------------------------------------------------------

STORED = T.StructType(
    [
        T.StructField("request_hash", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


#: What a task is dealt: the text of a summary, or a request in parts.
DEALT = ["summary_key", "summary", "request_hash", "head", "tail"]
#: The error of a request that was not sent because too many others failed.
NOT_ASKED = "not_asked"
#: Calls that a task makes before its share of failures can stop it.
MIN_CALLS = 20


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The stored replies; None where nothing was stored yet (any other
    failure to read is an error, never an empty store)."""
    try:
        return spark.read.schema(STORED).parquet(store)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _ask(completer: Callable[[str], str], last: dict, request: tuple[str, str | None, str | None]) -> str:
    """One call, for a request in parts: head, summary, tail. A completer with
    ``after`` gets a beginning only where it differs from the ``last`` one."""
    head, summary, tail = request
    if tail is None:
        return completer(head)
    if not hasattr(completer, "after"):
        return completer(head + summary + tail)
    known = last.get("after")
    if known is None or known[0] != (head, summary):
        last["after"] = known = (head, summary), completer.after(head + summary)
    return known[1](tail)


class _Calls:
    """Calls of one task: up to ``parallel`` at a time, results in the order of
    the requests. With ``breaker`` no further call is made once at least
    ``min_calls`` have ended and that share of them failed."""

    def __init__(self, completer: Callable, parallel: int, breaker: float | None, min_calls: int) -> None:
        self.completer, self.parallel, self.breaker, self.min_calls = completer, parallel, breaker, min_calls
        self.ended = self.failed = 0

    def one(self, request) -> tuple[str | None, str | None]:
        try:
            return self.completer(request), None
        except Exception as exc:  # recorded per row
            return None, f"{type(exc).__name__}: {exc}"

    def broken(self) -> bool:
        return self.breaker is not None and self.ended >= self.min_calls and self.failed >= self.breaker * self.ended

    def over(self, requests: list) -> list[tuple[str | None, str | None]]:
        results: list = [(None, NOT_ASKED)] * len(requests)
        if self.parallel == 1:  # in the task's own thread: handing over costs more than a short call
            for at, request in enumerate(requests):
                if self.broken():
                    break
                results[at] = self.one(request)
                self.ended += 1
                self.failed += results[at][1] is not None
            return results
        running: deque[tuple[int, Future]] = deque()

        def end_first() -> None:
            at, call = running.popleft()
            results[at] = call.result()
            self.ended += 1
            self.failed += results[at][1] is not None

        with ThreadPoolExecutor(self.parallel) as pool:
            for at, request in enumerate(requests):
                if len(running) == self.parallel:
                    end_first()
                while running and running[0][1].done():
                    end_first()
                if self.broken():
                    break
                running.append((at, pool.submit(self.one, request)))
            while running:
                end_first()
        return results


def once_each(requests: DataFrame) -> DataFrame:
    """One row for each request: of stored rows ``request_hash, _part, _id`` and
    more (``_id`` tells them apart) with one hash, one that belongs to a part,
    and to the first. Decided on these three columns; the rows to leave out are
    stored, and where they are few no request is sorted or dealt out for it."""
    first = F.min(F.struct(F.col("_part").isNull().alias("none"), F.col("_part").alias("part"), F.col("_id").alias("id")))
    repeated = requests.groupBy("request_hash").agg(F.count(F.lit(1)).alias("_n"), first.alias("_first")).filter("_n > 1")
    repeated = repeated.select(F.col("request_hash").alias("_hash"), F.col("_first.id").alias("_kept"))
    same = F.col("request_hash").eqNullSafe(F.col("_hash")) & (F.col("_id") != F.col("_kept"))
    copies = cut_lineage(requests.select("request_hash", "_id").join(repeated, same).select("_id"))
    return requests.join(copies, "_id", "left_anti")


def complete_requests(
    requests_json: DataFrame,
    completer: Callable[[str], str],
    summaries: DataFrame | None = None,
    store: str | None = None,
    concurrency: int | None = None,
    batches: int = 1,
    parallel: int = 1,
    breaker: float | None = None,
    task_breaker: float | None = None,
    min_calls: int = MIN_CALLS,
    batch_of: Column | None = None,
) -> DataFrame:
    """Call ``completer(request body) -> reply body`` once per distinct
    request and give every ``(repo, path)`` that asks it the reply: ``repo,
    path, request_hash, body, error``. The body holds the summary that the
    request names, from ``summaries(repo, summary)``; without them it is the
    request as it stands.

    A task gets each summary that its requests name once, in front of them, and
    a body is put together when it is sent, so what is moved and kept grows
    with the requests. ``completer`` reads whole bodies; one that can keep what
    many of them begin with (a prompt cache) has ``after(beginning)``, which
    returns the function to call with the rest of a body.

    Runs in ``mapInPandas`` (Arrow batches); an exception becomes the row's
    ``error`` so one failure never loses the other replies. With ``store`` (a
    shared path) replies without an error are kept there by request hash and
    not requested again; failed ones are, so a re-run picks up where it
    stopped. The guarantee is at least once: a retried or speculative task
    repeats the calls of its part that were not committed. ``batches`` commits
    the replies in so many parts, which bounds what can be repeated;
    ``concurrency`` bounds the number of tasks calling out at once, and each
    task makes up to ``parallel`` calls at a time (``completer`` must then be
    safe to call from several threads). With a store the requests are stored
    once for all parts. Without one the plan is lazy and each evaluation calls
    again.

    ``task_breaker`` is the share of a task's calls (of ``min_calls`` or more)
    whose failure ends its calls of this part; ``breaker`` is the share of all
    calls of the parts so far (of ``min_calls`` or more) whose failure ends the
    run's calls. Requests that are not sent have the error ``not_asked`` and
    are asked in the next run. ``batch_of`` says which part (from 0) a request belongs to;
    by default its hash does."""

    named = summaries is not None
    none = F.lit(None).cast("string")

    def run(pdfs: Iterator) -> Iterator:
        last: dict = {}
        calls = _Calls(lambda request: _ask(completer, last, request), parallel, task_breaker, min_calls)
        key = summary = None
        for pdf in pdfs:
            hashes, requests = [], []
            for k, text, h, head, tail in zip(*(pdf[c] for c in DEALT)):
                if text is not None:
                    key, summary = k, text
                elif not named or (summary is not None and k == key):  # else its summary is not there
                    hashes.append(h)
                    requests.append((head, summary, tail))
            bodies, errors = zip(*calls.over(requests)) if requests else ((), ())
            yield pd.DataFrame({"request_hash": hashes, "body": bodies, "error": errors}, dtype=object)

    def called(rows: DataFrame) -> DataFrame:
        if not named:
            rows = rows.repartition(concurrency, "request_hash") if concurrency else rows
            rows = rows.select(none.alias("summary_key"), none.alias("summary"), "request_hash", F.col("request_json").alias("head"), none.alias("tail"))
            return rows.mapInPandas(run, STORED)
        # so many tasks, and copies of a summary, however many the requests
        tasks = concurrency or 4 * rows.sparkSession.sparkContext.defaultParallelism
        rows = rows.withColumn("_task", F.pmod(F.xxhash64("request_hash"), F.lit(tasks)).cast("int"))
        first = rows.select("_task", "summary_key").distinct().join(texts, "summary_key")
        first = first.select("_task", "summary_key", "summary", *[none.alias(c) for c in ("request_hash", "head", "tail")])
        own = rows.select("_task", "summary_key", none.alias("summary"), "request_hash", body_parts("request_json").alias("_b"))
        dealt = first.unionByName(own.select(*first.columns[:4], "_b.head", "_b.tail")).repartitionById(tasks, "_task")
        return dealt.sortWithinPartitions("summary_key", F.col("summary").isNull(), "head").select(*DEALT).mapInPandas(run, STORED)

    part_of = F.pmod(F.xxhash64("request_hash"), F.lit(batches)) if batch_of is None else batch_of
    requests = requests_json.withColumn("_part", part_of.cast("int"))
    texts = summaries.select(F.sha2("summary", 256).alias("summary_key"), summary_part("summary").alias("summary")).distinct() if named else None
    if store is not None:
        requests = cut_lineage(requests.withColumn("_id", F.monotonically_increasing_id()))
        texts = cut_lineage(texts) if named else None
    asked = requests.select("repo", "path", "request_hash")
    if store is None:
        # of rows with the same request, one that belongs to a part, and to the first
        one = F.struct(F.col("_part").isNull().alias("_no_part"), "_part", *["summary_key"] * named, "request_json")
        todo = requests.groupBy("request_hash").agg(F.min(one).alias("r")).select("request_hash", "r.*").drop("_no_part")
        replies = called(todo)
    else:
        todo = once_each(requests)
        spark = requests_json.sparkSession
        before, broken = _outcomes(_stored(spark, store)), False
        for part in range(batches):
            wanted = todo if batches == 1 else todo.filter(F.col("_part") == part)
            done = _stored(spark, store)
            if done is not None:
                good = done.filter(F.col("error").isNull()).select("request_hash")
                wanted = wanted.join(good, "request_hash", "left_anti")
            if broken:
                skipped = wanted.select("request_hash", F.lit(None).cast("string").alias("body"), F.lit(NOT_ASKED).alias("error"))
                skipped.write.mode("append").parquet(store)
                continue
            called(wanted).write.mode("append").parquet(store)
            if breaker is not None and part + 1 < batches:
                ended, failed = (now - then for now, then in zip(_outcomes(_stored(spark, store)), before))
                broken = ended >= min_calls and failed >= breaker * ended
        # of several rows for one request (failed, then answered) the answer;
        # an error of a call rather than that there was none
        order = F.struct(F.col("error").isNotNull(), F.col("error") == NOT_ASKED, "error", "body")
        replies = _stored(spark, store).groupBy("request_hash").agg(
            F.min_by(F.struct("body", "error"), order).alias("r")
        ).select("request_hash", "r.body", "r.error")
    return asked.join(replies, "request_hash").select("repo", "path", "request_hash", "body", "error")


def _outcomes(stored: DataFrame | None) -> tuple[int, int]:
    """Calls in the store, and failed ones among them."""
    if stored is None:
        return 0, 0
    sent = F.coalesce(F.col("error") != NOT_ASKED, F.lit(True))
    r = stored.agg(F.count_if(sent).alias("ended"), F.count_if(sent & F.col("error").isNotNull()).alias("failed")).first()
    return r["ended"], r["failed"]
