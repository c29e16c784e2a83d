"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinquery.llm import decontaminate, packing, secrets, simhash, toxicity
from skeinquery.llm.common import fold, shared_path
from skeinquery.llm.queries import table, vocabulary_path


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled documents of the stage's input, does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids, packed into sequences."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [("toxicity", keep_civil), ("near_duplicates", keep_distinct), ("decontamination", keep_clean), ("secrets", hide_secrets), ("packing", pack)]

#: A trained network, a hash and a tokenizer take part; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
