"""Licence scan by canonical digest lookup (DataFrame functions only).

A text is normalised (case, punctuation, copyright lines, equivalent
spellings), its canonical form is digested, and the digest is joined with
those of known licences. The comparison is of entire texts: a text is a licence
when its canonical form is. The lines of the same canonical form are compared
entire with known one-line notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_digests import DIGESTS, MORE_NOTICES
from .tables import table, text_or_empty

# Licence texts, notices and spellings (fixed values).
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
}
#: Further texts; longer licences are known by digest (``license_digests``).
MORE_LICENSES = {
    "BSD-3-Clause": LICENSES["BSD-2-Clause"].replace(
        "THIS SOFTWARE IS",
        """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

THIS SOFTWARE IS""",
        1,
    ),
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of
all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
}
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("whilst", "while"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
)

#: A line that only says whose copyright it is; names below it are not told apart.
_COPYRIGHT = r"\n[^\n\p{L}\p{N}(©]*(copyright[ \t]*(\(c\)|©|[0-9<\[])|(\(c\)|©)[ \t]*(copyright|[0-9<\[])|all rights reserved)[^\n]*"
_MARKS = r"[^\n\p{L}\p{N}]+"
_HEAD = r"^(?:[ \n]*+(?:(?:[^ \n]+ ){0,7}license(?: [^ \n]+){0,5}|copyright [^\n]*?) ?(?=\n|$)){1,50}+"


def canonical_lines(text: Column) -> Column:
    """The normalised text, its lines kept; a title line "X license" is text."""
    out = F.concat(F.lit("\n"), F.lower(text))
    out = F.regexp_replace(out, _COPYRIGHT, "\n")
    out = F.regexp_replace(out, _MARKS, " ")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def without_head(lines: Column) -> Column:
    """Canonical lines without the titles ("X license") and copyright lines, the
    name first or not, that stand before the text."""
    return F.regexp_replace(lines, _HEAD, "")


def digest_of(lines: Column) -> Column:
    """The digest of a canonical text, whatever its line breaks."""
    return F.sha2(F.trim(F.regexp_replace(lines, "[ \n]+", " ")).cast("binary"), 256)


def known_licenses(spark: SparkSession, texts: dict[str, str] = LICENSES) -> DataFrame:
    """``known_digest, license_id`` of a small dictionary of licence texts."""
    rows = spark.createDataFrame(sorted(texts.items()), "license_id string, text string")
    return rows.select(digest_of(canonical_lines(F.col("text"))).alias("known_digest"), "license_id")


def all_known(spark: SparkSession) -> DataFrame:
    """``known_digest, license_id``: the texts and the digests of this package."""
    rows = spark.createDataFrame(sorted(DIGESTS.items()), "known_digest string, license_id string")
    return known_licenses(spark, LICENSES | MORE_LICENSES).unionByName(rows)


def all_notices() -> dict[str, tuple[str, ...]]:
    """The notices of this package with their wordings."""
    return {i: (*([NOTICES[i]] if i in NOTICES else []), *MORE_NOTICES.get(i, ())) for i in dict.fromkeys([*NOTICES, *MORE_NOTICES])}


def license_scan(
    df: DataFrame,
    known: DataFrame | None = None,
    notices: dict[str, str | tuple[str, ...]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id, digest`` (of the canonical text),
    ``license_id`` (null where the entire text, with or without the titles and
    copyright lines at its head, is no known licence) and
    ``notices`` (ids of the known notices that are entire lines, each once, in
    the dictionary's order, comma-separated; empty if none). A notice may have
    several wordings.

    ``known`` has one row per digest. Null text counts as empty; empty texts
    share the digest of the empty text and are no licence. Repeated rows and
    null ids each give a row; other columns are ignored. Whole texts are read.
    """
    # The table of this package is a handful of rows; a caller's table is
    # broadcast only if Spark knows it to be small.
    own_table = known is None
    known = F.broadcast(all_known(df.sparkSession)) if known is None else known
    if notices is None:
        notices = all_notices()
    rows = df.select(F.col(id_col).alias("doc_id"), canonical_lines(text_or_empty(text_col)).alias("lines"))
    wordings = {i: [_one_line(t) for t in ([w] if isinstance(w, str) else w)] for i, w in notices.items()}
    lines = F.transform(F.split("lines", "\n"), lambda x: F.trim(x))
    # One pass over the lines, by hash, finds those that are some notice.
    own = F.array_intersect(lines, F.array(*(x for w in wordings.values() for x in w))) if wordings else F.array().cast("array<string>")
    bare = digest_of(without_head(F.col("lines")))
    marked = rows.select("doc_id", digest_of(F.col("lines")).alias("digest"), bare.alias("bare"), own.alias("own"))
    entire = [F.when(F.arrays_overlap("own", F.array(*w)), F.lit(i)) for i, w in wordings.items()]
    found = F.concat_ws(",", *entire) if entire else F.lit("")
    # No text goes into the joins; texts without a head are looked up once.
    thin = marked.select("doc_id", "digest", F.when(F.col("bare") != F.col("digest"), F.col("bare")).alias("bare"), found.alias("notices"))
    headless = known.select(F.col("known_digest").alias("headless_digest"), F.col("license_id").alias("headless_id"))
    return (
        thin.join(known, F.col("digest") == F.col("known_digest"), "left")
        .join(F.broadcast(headless) if own_table else headless, F.col("bare") == F.col("headless_digest"), "left")
        .select("doc_id", "digest", F.coalesce("license_id", "headless_id").alias("license_id"), "notices")
    )


def _one_line(text: str) -> Column:
    return F.trim(F.regexp_replace(canonical_lines(F.lit(text)), "\n", ""))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    out = f"chr(10) || lower({text})"
    out = f"regexp_replace({out}, {_sql_text(_COPYRIGHT)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_sql_text(_MARKS)}, ' ', 'g')"
    for one, other in SPELLINGS:
        out = f"replace({out}, '{one}', '{other}')"
    return out


def _sql_digest(lines: str) -> str:
    return f"sha256(trim(regexp_replace({lines}, '[ ' || chr(10) || ']+', ' ', 'g'), ' '))"


def _sql_notice(wordings: tuple[str, ...]) -> str:
    lines = ", ".join(f"trim(replace({_sql_canonical(_sql_text(t))}, chr(10), ''), ' ')" for t in wordings)
    return f"list_has_any(own, [{lines}])"


#: From the query's own tables. The lookup without a text's head (titles and
#: names before it) is left out: its pattern has no form in this SQL.
OP9_SQL = f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(t)})" for i, t in sorted((LICENSES | MORE_LICENSES).items()))}),
k AS (
  SELECT license_id, {_sql_digest(_sql_canonical("text"))} AS digest FROM known
  UNION ALL SELECT * FROM (VALUES {", ".join(f"({_sql_text(i)}, {_sql_text(d)})" for d, i in sorted(DIGESTS.items()))}) AS v(license_id, digest)
),
d AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS lines FROM documents),
own AS (
  SELECT doc_id, {_sql_digest("lines")} AS digest,
         list_transform(string_split(lines, chr(10)), lambda x: trim(x, ' ')) AS own
  FROM d
)
SELECT doc_id, own.digest, license_id,
       concat_ws(',', {", ".join(f"CASE WHEN {_sql_notice(w)} THEN {_sql_text(i)} END" for i, w in all_notices().items())}) AS notices
FROM own LEFT JOIN k USING (digest)
"""
