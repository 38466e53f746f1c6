"""Column builders for the string rules the operators share.

All sizes are UTF-8 byte counts (``octet_length``), never character counts.
Every builder returns a Column built from ``pyspark.sql.functions`` so it
stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white-space set of a Unicode-aware TrimSpace
# (tab, newline, vertical tab, form feed, carriage return, space, U+0085,
# U+00A0 and every Unicode separator). Plain ``trim`` strips spaces only.
SPACE_CLASS = r"[\t\n\x0B\f\r \x{85}\x{A0}\p{Z}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_MEMO: dict = {}


def memo_column(key: str, build) -> Column:
    """Build a large expression once per Spark application and reuse it.

    Only for expressions that refer to input columns by name: building a
    deep expression tree costs one JVM call per node, which is paid once
    instead of on every plan."""
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    k = (sc.applicationId if sc is not None else None, key)
    c = _MEMO.get(k)
    if c is None:
        c = _MEMO[k] = build()
    return c


def let(value, body) -> Column:
    """Bind ``value`` once and use it in ``body(v)``.

    A one-element ``transform``: the value is computed once however often
    ``body`` reads it, and however often the optimizer copies the whole
    expression (for example when a filter on it is pushed below a
    projection)."""
    return F.element_at(F.transform(F.array(col_(value)), body), 1)


# The same set as characters, for ``btrim`` (which only looks at the ends,
# unlike a regular expression that scans the whole text).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def trim_space(c) -> Column:
    """Strip leading and trailing white space (Unicode-aware)."""
    return F.btrim(col_(c), F.lit(SPACE_CHARS))


def rtrim_newlines(c) -> Column:
    """Strip trailing ``\\n`` characters only."""
    return F.rtrim(col_(c), F.lit("\n"))


def byte_len(c) -> Column:
    return F.octet_length(col_(c))


def go_quote(c) -> Column:
    """Double-quote a string the way a ``%q`` verb does for ordinary text:
    backslash, quote, newline, tab and carriage return are escaped."""
    s = col_(c)
    s = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    s = F.replace(s, F.lit('"'), F.lit('\\"'))
    s = F.replace(s, F.lit("\n"), F.lit("\\n"))
    s = F.replace(s, F.lit("\t"), F.lit("\\t"))
    s = F.replace(s, F.lit("\r"), F.lit("\\r"))
    return F.concat(F.lit('"'), s, F.lit('"'))


def replace_first(content, old, new) -> Column:
    """Literal replacement of the first occurrence of ``old`` (no regex).

    An empty ``old`` matches at the start, so ``new`` is prepended. Callers
    check containment first; when ``old`` is absent the content is returned
    unchanged.
    """
    content, old, new = col_(content), col_(old), col_(new)
    pos = F.instr(content, old)
    return F.when(pos == 0, content).otherwise(
        F.concat(
            F.substring(content, F.lit(1), pos - 1),
            new,
            F.substring(content, pos + F.length(old), F.lit(2147483647)),
        )
    )


def contains(content, needle) -> Column:
    """Literal containment; an empty needle is always contained."""
    return F.instr(col_(content), col_(needle)) > 0


def preview(c, n: int, suffix: str = "...") -> Column:
    """Cut text longer than ``n`` bytes to ``n`` characters plus a suffix.

    The cut is made at characters so the result stays valid UTF-8."""
    s = col_(c)
    return F.when(F.octet_length(s) > n, F.concat(F.substring(s, 1, n), F.lit(suffix))).otherwise(s)


def percent0(x) -> Column:
    """``%.0f`` of a non-negative double: round half to even, no decimals."""
    return F.bround(col_(x), 0).cast("bigint").cast("string")


def upper_initial(c) -> Column:
    """True when the first character is an upper-case letter (exported name)."""
    return col_(c).rlike(r"^\p{Lu}")
