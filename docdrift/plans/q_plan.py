"""The whole plan (``plan_version_updates``) as a key: ``supplier`` files in two
stored versions, ``documents`` in the repositories of those files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources import text_store as TS
from . import bindings as B
from . import pipeline as P
from .q_mining import BASE, ROWS
from .registry import register

#: Size limit of a repository's documents, in tokens: every repository passes
#: (the limit itself has keys of its own).
LIMIT = 1 << 40
#: Declarations of a generated file that another package sees.
EXPORTED = sum(r.rstrip().endswith("true") for r in ROWS)

DOCS = """SELECT 'r' || CAST(doc_id % 6 AS VARCHAR) AS repo, 'docs/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS path,
                 text AS content FROM documents"""


def _docs(spark, sf):
    d = B.table(spark, sf, "documents")
    repo = F.concat(F.lit("r"), (F.col("doc_id") % 6).cast("string"))
    path = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select(repo.alias("repo"), path.alias("path"), F.col("text").alias("content"))


def plan(spark, sf):
    """Files with k % 10 = 3 are new in the later version, those with
    k % 10 = 5 are gone; repository r5 has documents but no files."""
    files = B.go_sources(spark, sf)
    store = f"{checkpoint_dir(spark)}/docdrift-texts-{uuid.uuid4().hex}"
    TS.put_version(files.where("path NOT LIKE '%3.go'"), store, "base")
    TS.put_version(files.where("path NOT LIKE '%5.go'"), store, "head")
    docs = _docs(spark, sf)
    roots = docs.select("repo").distinct().withColumn("root", F.lit("docs"))
    return P.plan_version_updates(spark, store, "base", "head", docs, roots, max_tokens=LIMIT)


@register(
    "plan_requests",
    f"""WITH {BASE}, docs AS ({DOCS}),
    changed AS (SELECT repo, count(*) FILTER (kn % 10 = 3) * {EXPORTED} AS n_added, count(*) FILTER (kn % 10 = 5) * {EXPORTED} AS n_removed
                FROM s WHERE kn % 10 IN (3, 5) GROUP BY repo),
    plain AS (SELECT repo, path, regexp_replace(content, '<!--.*?-->', '', 'gs') AS content FROM docs)
    SELECT d.repo, d.path, md5(content) AS doc_md5, n_added, n_removed FROM plain d JOIN changed c ON d.repo = c.repo""",
)
def q_plan_requests(spark, sf):
    """Requested documents with their text as the request holds it and the
    changes that their repository's summary tells."""
    made = plan(spark, sf)
    request = F.from_json("request_json", "messages array<struct<role string, content string>>")
    inner = F.regexp_extract(request["messages"][1]["content"], r"(?s)^<DOCUMENT path=\"[^\"]*\">\n(.*)\n</DOCUMENT>$", 1)
    lines = made["summary"].withColumn("line", F.explode(F.split("summary", "\n")))
    told = lines.groupBy("repo").agg(
        F.count_if(F.col("line").startswith("+ ADDED")).alias("n_added"), F.count_if(F.col("line").startswith("- REMOVED")).alias("n_removed")
    )
    return made["requests"].select("repo", "path", F.md5(inner).alias("doc_md5")).join(told, "repo")
