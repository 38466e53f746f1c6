"""Line deduplication by site-relative frequency (DataFrame functions only).

A line is boilerplate on a site when the share of the site's pages that contain
it exceeds ``max_ratio``. Lines are counted by digest, once per page and with
map-side aggregation, so a line that a third of all pages share is one partial
count per task. A site's boilerplate is at most (lines of its longest pages) /
``max_ratio`` lines, whatever the number of its pages, so it fits one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tables import table, whole_row

#: Production parameters of the registered query and of the pipeline stage.
MAX_RATIO, MIN_PAGES = 0.05, 5

_MARGIN = " \t\r"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def _bare(line: Column) -> Column:
    return F.trim(line, F.lit(_MARGIN))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(_bare(line).cast("binary")))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(
    df: DataFrame,
    text: Column,
    site: Column,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """``site, keys``: the digests of each site's boilerplate lines. With
    ``copies_once`` the pages of a site with the same lines are one page."""
    pages = df.select(site.alias("site"), text.alias("text"))
    lines = F.filter(F.transform(_lines(F.col("text")), _bare), lambda x: x != "")
    if copies_once:
        # Digests stand for pages and lines, so no text is shuffled, and a line
        # or a page that many rows hold is spread by (line, page).
        same = F.unhex(F.md5(F.coalesce(F.array_join(lines, "\n"), F.lit("")).cast("binary")))
        pages = pages.select("site", same.alias("page"), "text")
        totals = pages.select("site", "page").distinct()
    else:
        totals = pages
    totals = cut_lineage(totals.groupBy("site").agg(F.count(F.lit(1)).alias("pages")))
    kept = ["site", "page"] if copies_once else ["site"]
    keyed = pages.select(*kept, F.explode(F.array_distinct(lines)).alias("line")).select(
        *kept, F.unhex(F.md5(F.col("line").cast("binary"))).alias("key")
    )
    counted = (
        (keyed.distinct() if copies_once else keyed)
        .groupBy("site", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    return cut_lineage(
        counted.join(totals.withColumnRenamed("site", "its"), F.col("site").eqNullSafe(F.col("its")))
        .where(F.col("n") > F.col("pages") * F.lit(max_ratio))
        .groupBy("site")
        .agg(F.collect_list("key").alias("keys"))
    )


def line_dedup(
    df: DataFrame,
    text_col: str = "text",
    site: Column | None = None,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    copies_once: bool = False,
) -> DataFrame:
    """The input's rows and columns with boilerplate lines deleted from
    ``text_col``, as ``struct row`` (the cleaned row), ``n_lines`` and
    ``n_dropped``.

    A line counts once per page, whatever white space stands around it, and
    every row is a page, repeated rows included; with ``copies_once`` rows of a
    site with the same lines are one page, so a document does not become
    boilerplate by being copied. Lines that are blank, or that
    fewer than ``min_pages`` pages of the site contain, stay. The lines that
    stay keep their order and wording. Rows without a site form a site of
    their own; a null text stays null (no lines) and an empty one stays empty.
    The input's column names cannot clash with the helpers'.
    """
    site = F.col("source") if site is None else site
    found = boilerplate(df, F.col(text_col), site, max_ratio, min_pages, copies_once)
    packed = df.select(whole_row(), site.alias("site"), F.col(text_col).alias("text"))
    # Sites without boilerplate are not in the table; it is broadcast only if
    # its measured size allows it.
    joined = packed.join(found.withColumnRenamed("site", "its"), F.col("site").eqNullSafe(F.col("its")), "left")
    lines = _lines(F.col("text"))
    stay = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(F.col("keys"), _key(x)))
    clean = F.when(F.col("keys").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col("keys").isNull() | F.col("text").isNull(), 0).otherwise(F.size(lines) - F.size(stay))
    fields = [clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return joined.select(F.struct(*fields).alias("row"), count.alias("n_lines"), gone.cast("long").alias("n_dropped"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, their source as the site."""
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("row.doc_id", "row.source", "row.text", "n_lines", "n_dropped")


OP1_SQL = f"""
WITH lines AS (
  SELECT source, unnest(list_distinct(list_filter(
           list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line
  FROM documents
), pages AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT l.source, l.line FROM lines l JOIN pages p ON l.source IS NOT DISTINCT FROM p.source
  GROUP BY l.source, l.line, p.pages
  HAVING count(*) >= {MIN_PAGES} AND count(*) > p.pages * {MAX_RATIO}
), keys AS (
  SELECT source, list(line) AS keys FROM bad GROUP BY source
), cut AS (
  SELECT doc_id, d.source, text, string_split(text, chr(10)) AS parts,
         list_filter(string_split(text, chr(10)),
           lambda x: keys IS NULL OR NOT list_contains(keys, trim(x, ' ' || chr(9) || chr(13)))) AS stay
  FROM documents d LEFT JOIN keys k ON d.source IS NOT DISTINCT FROM k.source
)
SELECT doc_id, source, CASE WHEN text IS NULL THEN NULL ELSE array_to_string(stay, chr(10)) END AS text,
       coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(stay), 0)::BIGINT AS n_dropped
FROM cut
"""
