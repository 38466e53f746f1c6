"""Reply decoding.

Replies are stored bodies (one JSON text per request). Decoding is
``from_json`` with explicit schemas; gating, fence removal and edit decoding
are column expressions, so a bad reply becomes a status value on its row,
never a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let, trim_space
from ..schemas import EDIT_RESPONSE, REPLY

#: A column that the parser fills when the text is not valid JSON of the schema.
CORRUPT = "_corrupt_record"
JSON_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
PARSED = T.StructType([*REPLY.fields, T.StructField(CORRUPT, T.StringType())])


def decode_replies(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``reply`` (choices / usage / error struct) decoded from the
    body text and ``reply_ok`` (false when the body is not one JSON object,
    malformed JSON included).

    The chain is written with ``let`` so the parse runs once per row even
    where the optimizer copies the expression (a filter pushed below the
    projection copies every expression it reads)."""
    dec = let(
        F.col(body),
        lambda b: let(
            trim_space(b),
            lambda t: let(
                F.when(t.startswith("{") & t.endswith("}"), F.from_json(b, PARSED, JSON_OPTS)),
                lambda r: let(
                    r.isNotNull() & r[CORRUPT].isNull(),
                    lambda ok: F.struct(
                        F.when(ok, F.struct(*[r[f.name].alias(f.name) for f in REPLY.fields])).alias("reply"), ok.alias("reply_ok")
                    ),
                ),
            ),
        ),
    )
    return df.withColumn("_dec", dec).select(
        *[c for c in df.columns], F.col("_dec.reply").alias("reply"), F.col("_dec.reply_ok").alias("reply_ok")
    )


def _gate(x: Column) -> Column:
    def with_first(first):
        content = first["message"]["content"]
        status = (
            F.when(~x["reply_ok"], F.lit("bad_body"))
            .when(F.coalesce(F.size(x["reply"]["choices"]), F.lit(0)) <= 0, F.lit("no_choices"))
            .when(F.coalesce(content, F.lit("")) == "", F.lit("empty_content"))
            .when(first["finish_reason"] == "length", F.lit("truncated"))
            .otherwise(F.lit("ok"))
        )
        return let(
            status,
            lambda st: F.struct(st.alias("reply_status"), F.when(st == "ok", content).alias("raw")),
        )

    return let(F.try_element_at(x["reply"]["choices"], F.lit(1)), with_first)


def gate_replies(df: DataFrame) -> DataFrame:
    """``reply_status`` in order: bad body, no choices, empty content,
    truncated (finish reason ``length``), else ``ok``; ``raw`` is the first
    choice's content (null unless ok)."""
    g = let(F.struct("reply", "reply_ok"), _gate)
    return df.withColumn("_g", g).select(
        *df.columns, F.col("_g.reply_status").alias("reply_status"), F.col("_g.raw").alias("raw")
    )


def strip_fences(c) -> Column:
    """Trim; when the text starts with three backticks take what lies
    between the first newline and the last fence, trimmed; a malformed fence
    leaves the text as it is."""

    def with_raw(raw):
        def with_nl(nl0):  # 0-based index of the first newline, -1 when absent
            def with_last(last0):  # 0-based start of the last fence
                inner = trim_space(F.substring(raw, nl0 + 2, last0 - nl0 - 1))
                ok = raw.startswith("```") & (nl0 != -1) & (last0 > nl0)
                return F.when(ok, inner).otherwise(raw)

            return let(F.length(raw) - F.instr(F.reverse(raw), "```") - 2, with_last)

        return let(F.instr(raw, "\n") - 1, with_nl)

    return let(trim_space(c), with_raw)


_EDITS_T = "array<struct<file:string,section:string,action:string,old_text:string,new_text:string>>"


def _decode(raw: Column) -> Column:
    def with_text(text):
        def with_parsed(p):
            bad = ~(text.startswith("{") & text.endswith("}")) | p.isNull() | p["_corrupt_record"].isNotNull()
            return let(
                bad,
                lambda b: F.struct(
                    F.when(b, F.lit("bad_json")).otherwise(F.lit("ok")).alias("decode_status"),
                    F.when(~b, F.coalesce(p["edits"], F.array().cast(_EDITS_T))).alias("edits"),
                ),
            )

        return let(F.from_json(text, EDIT_RESPONSE, JSON_OPTS), with_parsed)

    return F.when(raw.isNotNull(), let(strip_fences(raw), with_text))


def decode_edits(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``edits`` (array of edit structs, ``[]`` when missing or null) and
    ``decode_status`` (``ok`` / ``bad_json``; null when there is no text)
    from the fence-stripped text.

    ``from_json`` is lenient where a strict decoder is not (trailing text
    after the object, numbers for strings), so the text must first look
    like one JSON object; what remains is documented leniency."""
    return df.withColumn("_d", _decode(F.col(raw))).select(
        *df.columns, F.col("_d.decode_status").alias("decode_status"), F.col("_d.edits").alias("edits")
    )


def explode_edits(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per edit with its 0-based ``seq``; a reply without edits
    keeps one row with null edit fields."""
    return df.select(*keys, F.posexplode_outer("edits").alias("seq", "e")).select(
        *keys, "seq", "e.file", "e.section", "e.action", "e.old_text", "e.new_text"
    )
