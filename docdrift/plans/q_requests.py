"""Keys P1-P5, S5, R0-R3 bound to ``documents``, ``pages`` and ``events``."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from ..operators import attempts as AT
from ..operators import requests as RQ
from ..session import checkpoint_dir, cut_lineage
from ..sources import snapshots as SS
from ..operators import changes as C
from . import bindings as B
from .q_docs import CHANGED, DOCS
from .registry import register

MODEL = "doc-model"

# --- Spark side ---------------------------------------------------------------------


def _summaries(spark, sf):
    # hashed at the scan: no text is dealt out for a comparison of hashes
    ch = C.changed_paths(B.code_snapshot(spark, sf, "old", spread=False), B.code_snapshot(spark, sf, "new", spread=False))
    return B.change_summaries(SS.filter_source_files(ch))


def _requests(spark, sf, summaries=None):
    summaries = _summaries(spark, sf) if summaries is None else summaries
    return RQ.build_requests(B.docs_table(spark, sf), summaries, model=MODEL)


class LocalCompleter:
    """Deterministic stand-in for a model: put the first word of the document
    in brackets. A summary, with which many bodies begin, is read once."""

    def __call__(self, request: str) -> str:
        return self._reader(json.loads(request)["messages"][1]["content"])("")

    def after(self, beginning: str):
        reply = self._reader(json.loads(beginning + '"}]}')["messages"][1]["content"])
        return lambda rest: reply(json.loads('{"messages":[{"content":"' + rest)["messages"][0]["content"])

    def _reader(self, start: str):
        """From the end of a user text that begins with ``start`` to the reply."""
        end, n_bytes = start.find("</CODE_CHANGES>"), len(start.encode())
        # nothing that is searched for can begin in other starts
        searched = start if not start.endswith("\n") or '">\n' in start or '<DOCUMENT path="' in start else ""

        def reply(own: str) -> str:
            at = end if end >= 0 else (start + own).index("</CODE_CHANGES>")
            return self._reply(searched + own, at, n_bytes + len(own.encode()))

        return reply

    def _reply(self, text: str, end: int, n_bytes: int) -> str:
        m = re.search(r'<DOCUMENT path="([^"]*)">\n(\S*)', text)
        path, word = (m.group(1), m.group(2)) if m else ("", "")
        edits = {"edits": [{"file": path, "section": str(end - len("<CODE_CHANGES>\n") - 1), "action": "replace", "old_text": word, "new_text": "[" + word + "]"}]}
        reply = {
            "choices": [{"message": {"role": "assistant", "content": json.dumps(edits)}, "finish_reason": "stop"}],
            "usage": {"prompt_tokens": n_bytes // 4, "completion_tokens": 1, "total_tokens": n_bytes // 4 + 1},
        }
        return json.dumps(reply)


local_completer = LocalCompleter()


# --- SQL side -----------------------------------------------------------------------

SYSTEM_SQL = "'" + RQ.system_text().replace("'", "''") + "'"
SUMMARIES = f"""{CHANGED},
  sums AS (SELECT repo, string_agg(change || ' ' || path, chr(10) ORDER BY path) AS summary
           FROM changed WHERE ends_with(path, '.go') GROUP BY repo),
  docs AS ({DOCS}),
  reqs AS (
    SELECT d.repo, d.path, d.content,
           sha256(s.summary) AS summary_key, length(s.summary) AS n_summary,
           '<DOCUMENT path="' || d.path || '">' || chr(10) || regexp_replace(d.content, '<!--[\\s\\S]*?-->', '', 'g') ||
           chr(10) || '</DOCUMENT>' AS user_text
    FROM docs d JOIN sums s ON d.repo = s.repo)"""

STATUS_SQL = """CASE (user_id + event_id) % 7 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 500 WHEN 3 THEN 400
                      WHEN 4 THEN 401 WHEN 5 THEN 0 ELSE 503 END"""


def _body_sql() -> str:
    parts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.ATTEMPT_BODIES.items())
    return f"CASE event_type {parts} ELSE 'upstream ' || event_type || ' ' || props END"


ATTEMPTS = f"""att AS (
    SELECT 'q' || CAST(event_id // 4 AS VARCHAR) AS request_id, CAST(event_id % 4 AS INTEGER) AS attempt,
           CAST({STATUS_SQL} AS INTEGER) AS status,
           CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS INTEGER) AS VARCHAR) ELSE 'soon' END AS retry_after,
           {_body_sql()} AS body
    FROM events),
  parsed AS (
    SELECT *, json_valid(body) AND starts_with(trim(body), '{{') AS is_obj FROM att),
  pj AS (SELECT *, CASE WHEN is_obj THEN body END AS jbody FROM parsed),
  p2 AS (
    SELECT *, coalesce(json_type(json_extract(jbody, '$.error')) NOT IN ('NULL'), false) AS has_error,
           coalesce(json_array_length(jbody, '$.choices'), 0) > 0 AS has_choices FROM pj),
  p3 AS (
    SELECT *, CASE WHEN has_error THEN coalesce(json_extract_string(jbody, '$.error.message'), '') ELSE body END AS msg FROM p2),
  cls AS (
    SELECT *, CASE WHEN status = 200 THEN CASE WHEN has_choices AND NOT has_error THEN 'ok' ELSE 'api_error' END
                   WHEN status = 0 THEN 'network_error' WHEN status = 401 THEN 'auth_failed' WHEN status = 429 THEN 'rate_limited'
                   WHEN status = 400 AND (contains(msg, 'context_length') OR contains(msg, 'maximum context') OR contains(msg, 'too long')
                        OR contains(msg, 'token')) THEN 'context_length'
                   WHEN status = 400 THEN 'bad_request' WHEN status >= 500 THEN 'server_error' ELSE 'http_error' END AS outcome
    FROM p3),
  cls2 AS (
    SELECT request_id, attempt, status, retry_after, body, outcome,
           outcome IN ('api_error', 'network_error', 'rate_limited', 'server_error') AS retryable,
           CASE WHEN outcome = 'rate_limited' THEN TRY_CAST(retry_after AS INTEGER) END AS retry_after_s,
           CASE outcome WHEN 'auth_failed' THEN 'authentication failed: ' || msg WHEN 'rate_limited' THEN 'rate limited: ' || msg
                        WHEN 'context_length' THEN 'context length exceeded: ' || msg WHEN 'server_error' THEN 'server error: ' || msg
                        WHEN 'ok' THEN '' ELSE msg END AS message
    FROM cls)"""


# --- keys ---------------------------------------------------------------------------


@register(
    "strip_comments",
    """SELECT page_id, octet_length(encode(s)) AS n_bytes, md5(s) AS md5
       FROM (SELECT page_id, regexp_replace(html, '<!--[\\s\\S]*?-->', '', 'g') AS s FROM pages)""",
)
def q_strip_comments(spark, sf):
    p = B.table(spark, sf, "pages", spread=True)
    s = RQ.strip_comments("html")
    return p.select("page_id", F.octet_length(s).alias("n_bytes"), F.md5(s).alias("md5"))


@register(
    "wrap_tags",
    f"""WITH docs AS ({DOCS}) SELECT repo, path,
        md5('<DOCUMENT path="' || path || '">' || chr(10) || content || chr(10) || '</DOCUMENT>') AS doc_md5,
        md5('<RULES>' || chr(10) || repo || chr(10) || '</RULES>') AS tag_md5 FROM docs""",
)
def q_wrap_tags(spark, sf):
    d = B.docs_table(spark, sf)
    return d.select(
        "repo", "path", F.md5(RQ.wrap_doc("path", "content")).alias("doc_md5"), F.md5(RQ.wrap("RULES", "repo")).alias("tag_md5")
    )


# The parts that every repository leaves at their default text.
_DEFAULTS = {t: RQ.DEFAULT_PARTS[t].replace("'", "''") for t in ("CONTEXT", "TONE", "EXAMPLES")}


@register(
    "system_text",
    f"""WITH n AS (SELECT lang AS repo, count(*) AS c, min(doc_id) AS first, max(n_chars) AS longest FROM documents GROUP BY lang),
    t AS (SELECT repo,
        '<ROLE>' || chr(10) || 'Editor of ' || repo || chr(10) || '</ROLE>' || chr(10) || chr(10) ||
        '<CONTEXT>' || chr(10) || '{_DEFAULTS["CONTEXT"]}' || chr(10) || '</CONTEXT>' || chr(10) || chr(10) ||
        '<SCALE>' || chr(10) || c || ' documents' || chr(10) || '</SCALE>' || chr(10) || chr(10) ||
        '<RULES>' || chr(10) || 'Start at ' || first || chr(10) || '</RULES>' || chr(10) || chr(10) ||
        '<TONE>' || chr(10) || '{_DEFAULTS["TONE"]}' || chr(10) || '</TONE>' || chr(10) || chr(10) ||
        '<EDGE_CASES>' || chr(10) || 'Up to ' || longest || ' characters' || chr(10) || '</EDGE_CASES>' || chr(10) || chr(10) ||
        '<EXAMPLES>' || chr(10) || '{_DEFAULTS["EXAMPLES"]}' || chr(10) || '</EXAMPLES>' AS system_text FROM n)
    SELECT repo, octet_length(encode(system_text)) AS system_bytes, md5(system_text) AS system_md5 FROM t""",
)
def q_system_text(spark, sf):
    d = B.table(spark, sf, "documents").groupBy(F.col("lang").alias("repo"))
    n = d.agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("first"), F.max("n_chars").alias("longest"))
    part = [
        ("ROLE", F.concat(F.lit("Editor of "), "repo")),
        ("SCALE", F.concat(F.col("c").cast("string"), F.lit(" documents"))),
        ("RULES", F.concat(F.lit("Start at "), F.col("first").cast("string"))),
        ("EDGE_CASES", F.concat(F.lit("Up to "), F.col("longest").cast("string"), F.lit(" characters"))),
        ("OTHER", F.lit("not a part")),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), x.alias("text")) for t, x in part]))
    texts = RQ.system_texts(n.select("repo", rows.alias("p")).select("repo", "p.*"))
    return texts.select("repo", F.octet_length("system_text").alias("system_bytes"), F.md5("system_text").alias("system_md5"))


@register(
    "build_requests",
    f"""WITH {SUMMARIES} SELECT repo, path, 2 AS n_messages, md5({SYSTEM_SQL}) AS system_md5,
        octet_length(encode(user_text)) AS user_bytes, md5(user_text) AS user_md5, summary_key, CAST(0.0 AS DOUBLE) AS temperature, true AS no_max_tokens FROM reqs""",
)
def q_build_requests(spark, sf):
    r = _requests(spark, sf)
    return r.select(
        "repo", "path", F.size("request.messages").alias("n_messages"),
        F.md5(F.col("request.messages")[0]["content"]).alias("system_md5"),
        F.octet_length(F.col("request.messages")[1]["content"]).alias("user_bytes"),
        F.md5(F.col("request.messages")[1]["content"]).alias("user_md5"),
        F.col("request.summary_key").alias("summary_key"),
        F.col("request.temperature").alias("temperature"),
        F.col("request.max_tokens").isNull().alias("no_max_tokens"),
    )


@register(
    "request_json",
    f"""WITH {SUMMARIES} SELECT repo, path, '{MODEL}' AS model, '0.0' AS temperature, false AS has_max_tokens,
        md5(user_text) AS user_md5, summary_key FROM reqs""",
)
def q_request_json(spark, sf):
    j = RQ.request_json(_requests(spark, sf))
    g = lambda p: F.get_json_object("request_json", p)
    return j.select(
        "repo", "path", g("$.model").alias("model"), g("$.temperature").alias("temperature"),
        F.col("request_json").contains('"max_tokens"').alias("has_max_tokens"),
        F.md5(g("$.messages[1].content")).alias("user_md5"), "summary_key",
    )


@register(
    "preview_text",
    """SELECT doc_id, md5(p) AS md5, length(p) AS n_chars FROM (
         SELECT doc_id, CASE WHEN octet_length(encode(text)) > 500 THEN substring(text, 1, 500) || chr(10) || '...(truncated)'
                             ELSE text END AS p FROM documents)""",
)
def q_preview_text(spark, sf):
    d = B.table(spark, sf, "documents", spread=True)
    p = RQ.preview_text("text")
    return d.select("doc_id", F.md5(p).alias("md5"), F.length(p).alias("n_chars"))


@register(
    "complete_requests",
    f"""WITH {SUMMARIES} SELECT repo, path, CAST(NULL AS VARCHAR) AS error, 1 AS n_edits, path AS file, CAST(n_summary AS VARCHAR) AS section,
        regexp_extract(regexp_replace(content, '<!--[\\s\\S]*?-->', '', 'g'), '^(\\S*)', 1) AS old_text,
        '[' || regexp_extract(regexp_replace(content, '<!--[\\s\\S]*?-->', '', 'g'), '^(\\S*)', 1) || ']' AS new_text FROM reqs""",
)
def q_complete_requests(spark, sf):
    store = f"{checkpoint_dir(spark)}/docdrift-replies-{uuid.uuid4().hex}"
    summaries = cut_lineage(_summaries(spark, sf))
    rep = RQ.complete_requests(RQ.request_json(_requests(spark, sf, summaries)), local_completer, summaries, store)
    content = F.get_json_object("body", "$.choices[0].message.content")
    return rep.select(
        "repo", "path", "error",
        F.json_array_length(F.get_json_object(content, "$.edits")).alias("n_edits"),
        F.get_json_object(content, "$.edits[0].file").alias("file"),
        F.get_json_object(content, "$.edits[0].section").alias("section"),
        F.get_json_object(content, "$.edits[0].old_text").alias("old_text"),
        F.get_json_object(content, "$.edits[0].new_text").alias("new_text"),
    )


class FailingCompleter(LocalCompleter):
    """``local_completer`` behind an endpoint that refuses every fourth of the
    odd documents' numbers."""

    def _reply(self, text: str, end: int, n_bytes: int) -> str:
        number = int(re.search(r'/([0-9]+)\.[a-z]+">\n', text).group(1))
        if number % 8 == 1:
            raise ConnectionError(f"no route for {number}")
        return super()._reply(text, end, n_bytes)


failing_completer = FailingCompleter()


@register(
    "call_outcomes",
    f"""WITH {SUMMARIES}, numbered AS (SELECT *, CAST(regexp_extract(path, '/([0-9]+)\\.', 1) AS INTEGER) AS n FROM reqs),
    shares AS (SELECT count(*) AS ended, count(*) FILTER (WHERE n % 8 = 1) AS failed FROM numbered WHERE n % 4 < 2)
    SELECT repo, path, CASE WHEN n % 4 >= 2 AND ended >= 20 AND failed >= 0.1 * ended THEN 'not_asked'
             WHEN n % 8 = 1 THEN 'ConnectionError: no route for ' || n ELSE 'ok' END AS outcome,
        CASE WHEN (n % 4 < 2 OR ended < 20 OR failed < 0.1 * ended) AND n % 8 <> 1 THEN path END AS file
    FROM numbered, shares""",
)
def q_call_outcomes(spark, sf):
    """R0 in four parts with a breaker: the second part fails too often, so the
    last two are not asked."""
    store = f"{checkpoint_dir(spark)}/docdrift-replies-{uuid.uuid4().hex}"
    number = F.regexp_extract("path", r"/([0-9]+)\.", 1).cast("int")
    summaries = cut_lineage(_summaries(spark, sf))
    rep = RQ.complete_requests(
        RQ.request_json(_requests(spark, sf, summaries)), failing_completer, summaries, store,
        batches=4, batch_of=number % 4, parallel=4, breaker=0.1,
    )
    content = F.get_json_object("body", "$.choices[0].message.content")
    return rep.select("repo", "path", F.coalesce("error", F.lit("ok")).alias("outcome"), F.get_json_object(content, "$.edits[0].file").alias("file"))


@register(
    "classify_attempts",
    f"WITH {ATTEMPTS} SELECT request_id, attempt, status, outcome, retryable, retry_after_s, message FROM cls2",
)
def q_classify_attempts(spark, sf):
    c = AT.classify_attempts(B.attempts(spark, sf))
    return c.select("request_id", "attempt", "status", "outcome", "retryable", "retry_after_s", "message")


@register(
    "final_attempt",
    f"""WITH {ATTEMPTS},
    ranked AS (SELECT *, outcome = 'ok' OR NOT retryable AS terminal,
                      CASE WHEN outcome = 'ok' OR NOT retryable THEN attempt ELSE 1000 - attempt END AS rk
               FROM cls2 WHERE attempt < 4),
    pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rk) AS rn FROM ranked) WHERE rn = 1)
    SELECT request_id, attempt AS final_attempt, status AS final_status,
           CASE WHEN terminal THEN outcome WHEN attempt = 3 THEN 'exhausted' ELSE 'unfinished' END AS final_outcome,
           terminal AND outcome = 'ok' AS succeeded, attempt + 1 AS attempts_used, message FROM pick""",
)
def q_final_attempt(spark, sf):
    return AT.final_attempt(AT.classify_attempts(B.attempts(spark, sf)))


@register(
    "backoff_bounds",
    f"""WITH {ATTEMPTS} SELECT request_id, attempt, least(pow(2.0, attempt), 30.0) AS delay_min_s,
        least(pow(2.0, attempt), 30.0) * 1.25 AS delay_max_s FROM att WHERE attempt >= 1""",
)
def q_backoff_bounds(spark, sf):
    return AT.backoff_bounds(B.attempts(spark, sf))
