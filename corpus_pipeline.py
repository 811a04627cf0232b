"""A training-corpus pipeline: each stage reads what the one before it wrote.

All stages but the last return the columns of ``documents``; the last adds size, source_size, target and taken.
An empty table passes through every stage as an empty table; null texts count as empty and null ids are
kept until the mix decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.llm import contamination, minhash, mixing, quality, secrets
from docforge.llm.common import documents, without, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, does not reject."""
    vectors, model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, vectors, model, payload=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    gone = written(minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id"), "copies")
    return without(docs, "doc_id", gone)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return contamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many of their words it takes."""
    return mixing.mix_sources(docs, payload=True).where("taken > 0")


STAGES = [("quality", keep_good), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("secrets", hide_secrets), ("mixing", mix)]

#: The classifier has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
