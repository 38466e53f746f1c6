"""From raw documents to packed training sequences, stage by stage.

Each stage takes the documents that its predecessor kept and returns documents
(the last one returns the packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdrift.llm.line_dedup import line_dedup
from docdrift.llm.packing import byte_bpe_path, pack_documents
from docdrift.llm.simhash import keep_one_of_each
from docdrift.llm.tables import table
from docdrift.llm.toxicity import score_toxicity, train
from docdrift.session import cut_lineage


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model fitted on ``labels`` calls toxic."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("not toxic").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete the boilerplate lines of each source; every document stays, and
    copies of a document, which are only dropped later, count as one page."""
    cleaned = line_dedup(docs, copies_once=True).select("row.*")
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences."""
    return pack_documents(docs, byte_bpe_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("packing", packing_stage),
]

#: A fitted model, fingerprints and token ids have no SQL form; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
