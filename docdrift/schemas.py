"""Explicit schemas for every table the operators read or write.

Nothing is inferred. Empty string means "absent" (unnamed parameter, no
receiver, missing side of a file); nulls only appear as the missing side of
an outer join and are coalesced away by the operators.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
L = T.LongType()

PARAM = T.StructType([T.StructField("name", S), T.StructField("type", S)])
FIELD = T.StructType(
    [T.StructField("name", S), T.StructField("type", S), T.StructField("doc", S)]
)
PARAMS = T.ArrayType(PARAM)
FIELDS = T.ArrayType(FIELD)

# one row per version of one file
SNAPSHOT = T.StructType(
    [
        T.StructField("repo", S),
        T.StructField("ref", S),
        T.StructField("path", S),
        T.StructField("content", S),
        T.StructField("content_hash", S),
    ]
)

# one row per exported declaration of one file version
SYMBOLS = T.StructType(
    [
        T.StructField("repo", S),
        T.StructField("path", S),
        T.StructField("ordinal", L),
        T.StructField("name", S),
        T.StructField("kind", S),
        T.StructField("signature", S),
        T.StructField("doc", S),
        T.StructField("recv", S),
        T.StructField("params", PARAMS),
        T.StructField("returns", PARAMS),
        T.StructField("fields", FIELDS),
        T.StructField("methods", FIELDS),
        T.StructField("grp", S),
    ]
)

SYMBOL_VALUE_COLS = [f.name for f in SYMBOLS.fields if f.name not in ("repo", "path", "name")]

CHANGE = T.StructType(
    [T.StructField("ord", I), T.StructField("aspect", S), T.StructField("description", S)]
)

DOCS = T.StructType(
    [T.StructField("repo", S), T.StructField("path", S), T.StructField("content", S)]
)

MAPPINGS = T.StructType(
    [
        T.StructField("repo", S),
        T.StructField("mapping_id", L),
        T.StructField("docs", T.ArrayType(S)),
        T.StructField("code", T.ArrayType(S)),
    ]
)

MESSAGE = T.StructType([T.StructField("role", S), T.StructField("content", S)])

REQUEST = T.StructType(
    [
        T.StructField("model", S),
        T.StructField("messages", T.ArrayType(MESSAGE)),
        T.StructField("max_tokens", I),
        T.StructField("temperature", T.DoubleType()),
    ]
)

REPLY = T.StructType(
    [
        T.StructField(
            "choices",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("message", MESSAGE),
                        T.StructField("finish_reason", S),
                    ]
                )
            ),
        ),
        T.StructField(
            "usage",
            T.StructType(
                [
                    T.StructField("prompt_tokens", I),
                    T.StructField("completion_tokens", I),
                    T.StructField("total_tokens", I),
                ]
            ),
        ),
        T.StructField(
            "error",
            T.StructType(
                [
                    T.StructField("message", S),
                    T.StructField("type", S),
                    T.StructField("code", S),
                ]
            ),
        ),
    ]
)

EDIT = T.StructType(
    [
        T.StructField("file", S),
        T.StructField("section", S),
        T.StructField("action", S),
        T.StructField("old_text", S),
        T.StructField("new_text", S),
    ]
)

EDIT_RESPONSE = T.StructType(
    [T.StructField("edits", T.ArrayType(EDIT)), T.StructField("_corrupt_record", S)]
)

ATTEMPTS = T.StructType(
    [
        T.StructField("request_id", S),
        T.StructField("attempt", I),
        T.StructField("status", I),
        T.StructField("retry_after", S),
        T.StructField("body", S),
    ]
)

ISSUES = T.StructType(
    [
        T.StructField("repo", S),
        T.StructField("file", S),
        T.StructField("message", S),
        T.StructField("rejected", T.BooleanType()),
    ]
)
