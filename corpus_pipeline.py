"""Documents to a training mix: STAGES in order, each written as Parquet and read by the next.

Defined cases, in every stage: an empty table gives an empty one; null and empty texts are scored from the text alone by the
first stage, are no near duplicates, hold no benchmark passage, and have no words that the mix could take; rows
that repeat are one group in the second, of which one stays; documents that the third cuts to nothing go; ties are broken by doc_id; very long texts are read whole; further
columns are kept whatever their names, up to the last two stages, which add their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, mixing, ngramjoin, quality, sharding
from tidemark.llm.common import durable, read

#: SQL cannot express the learned and the drawn stages; tests compare the operators with plain versions.
ORACLE_SQL = None


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below 0.5) go; it learns from all labels."""
    model = quality.train(docs.select("doc_id", "text"), read(spark, sf_dir, "labels"))
    names = docs.columns
    scored = quality.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("text").alias("_text")), model, text="_text")
    return scored.filter("score >= 0.5").select("_row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles at 0.8, the document of least doc_id stays."""
    return ngramjoin.one_of_each(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents left without words go."""
    found = decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), action="cut")
    return decontaminate.kept_after_cut(found, docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.place(docs)


STAGES = [("quality", good), ("near duplicates", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
