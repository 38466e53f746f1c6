"""Attempt-log analysis (R1-R3): classify each call attempt, pick the final
outcome per request, and state the retry delay bounds.

Input ``attempts(request_id, attempt, status, retry_after, body)``; status 0
means no HTTP status (network failure). All column expressions; the only
shuffle is the per-request aggregation of R2 (partial aggregation first).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, trim_space
from ..schemas import REPLY

# Attempts per request (first try plus three retries), the
# backoff cap in seconds, the jitter share, and the markers that make a
# 400 answer a context-length error.
MAX_ATTEMPTS = 4
BACKOFF_CAP_S = 30
JITTER = 0.25
CONTEXT_MARKERS = ["context_length", "maximum context", "too long", "token"]


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Add ``outcome``, ``retryable``, ``retry_after_s`` and
    ``message`` per attempt."""

    def with_parsed(p):
        status = F.col("status")
        body = F.coalesce(F.col("body"), F.lit(""))
        has_error = p.isNotNull() & p["error"].isNotNull()
        msg = F.when(has_error, F.coalesce(p["error"]["message"], F.lit(""))).otherwise(body)
        ctx = F.lit(False)
        for m in CONTEXT_MARKERS:
            ctx = ctx | msg.contains(m)
        ok200 = p.isNotNull() & ~has_error & (F.coalesce(F.size(p["choices"]), F.lit(0)) > 0)
        outcome = (
            F.when(status == 200, F.when(ok200, F.lit("ok")).otherwise(F.lit("api_error")))
            .when(status == 0, F.lit("network_error"))
            .when(status == 401, F.lit("auth_failed"))
            .when(status == 429, F.lit("rate_limited"))
            .when((status == 400) & ctx, F.lit("context_length"))
            .when(status == 400, F.lit("bad_request"))
            .when(status >= 500, F.lit("server_error"))
            .otherwise(F.lit("http_error"))
        )

        def with_outcome(o):
            retryable = o.isin("api_error", "network_error", "rate_limited", "server_error")
            message = (
                F.when(o == "auth_failed", F.concat(F.lit("authentication failed: "), msg))
                .when(o == "rate_limited", F.concat(F.lit("rate limited: "), msg))
                .when(o == "context_length", F.concat(F.lit("context length exceeded: "), msg))
                .when(o == "server_error", F.concat(F.lit("server error: "), msg))
                .when(o == "ok", F.lit(""))
                .otherwise(msg)
            )
            return F.struct(
                o.alias("outcome"),
                retryable.alias("retryable"),
                F.when(o == "rate_limited", F.col("retry_after").try_cast("int")).alias("retry_after_s"),
                message.alias("message"),
            )

        return let(outcome, with_outcome)

    t = trim_space(F.coalesce(F.col("body"), F.lit("")))
    parsed = F.when(t.startswith("{") & t.endswith("}"), F.from_json(F.col("body"), REPLY))
    return attempts.withColumn("_c", let(parsed, with_parsed)).select(
        *attempts.columns, "_c.outcome", "_c.retryable", "_c.retry_after_s", "_c.message"
    )


def final_attempt(classified: DataFrame) -> DataFrame:
    """R2: per request, the first attempt that succeeded or failed for good,
    among the first four; if there is none, the last of them, with outcome
    ``exhausted`` after the fourth and ``unfinished`` while attempts are
    left."""
    within = classified.filter(F.col("attempt") < MAX_ATTEMPTS)
    terminal = (F.col("outcome") == "ok") | ~F.col("retryable")
    # terminal attempts rank by attempt number and before every other row;
    # without any, the latest attempt ranks first
    rank = F.when(terminal, F.col("attempt")).otherwise(F.lit(1000) - F.col("attempt"))
    picked = within.groupBy("request_id").agg(
        F.min_by(F.struct("attempt", "status", "outcome", "message", terminal.alias("terminal")), rank).alias("p"),
        F.count(F.lit(1)).alias("n_seen"),
    )
    return picked.select(
        "request_id",
        F.col("p.attempt").alias("final_attempt"),
        F.col("p.status").alias("final_status"),
        F.when(F.col("p.terminal"), F.col("p.outcome")).when(
            F.col("p.attempt") == MAX_ATTEMPTS - 1, "exhausted"
        ).otherwise("unfinished").alias("final_outcome"),
        (F.col("p.terminal") & (F.col("p.outcome") == "ok")).alias("succeeded"),
        (F.col("p.attempt") + 1).alias("attempts_used"),
        F.col("p.message").alias("message"),
    )


def backoff_bounds(attempts: DataFrame) -> DataFrame:
    """For each retry (attempt >= 1) the wait before it lies in
    ``[min(2^attempt, 30), 1.25 * that)`` seconds; the table states the
    bounds, not a random draw."""
    base = F.least(F.pow(F.lit(2.0), F.col("attempt")), F.lit(float(BACKOFF_CAP_S)))
    return attempts.filter(F.col("attempt") >= 1).select(
        "request_id", "attempt", base.alias("delay_min_s"), (base * (1 + JITTER)).alias("delay_max_s")
    )
