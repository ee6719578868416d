"""From raw documents to tokens: one cleaning stage after the other, each on all the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.bpe import VOCABULARY, Vocabulary, encode_documents
from hostlens.llm.decontaminate import drop_contaminated
from hostlens.llm.langid import fit, in_training, keep_identified
from hostlens.llm.secrets import mask_secrets
from hostlens.llm.simhash import drop_near_duplicates
from hostlens.sources.scratch import durable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the labelled ones among them."""
    return keep_identified(docs, fit(docs, in_training(F.col("doc_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark text."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking secrets masked in their texts."""
    return mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with hashes of the ids and of the text that they decode to."""
    return encode_documents(docs, Vocabulary(VOCABULARY), also=("ids",))


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
    ("secret_scan", secret_scan), ("encode", encode),
]

ORACLE_SQL = None  # a learnt model, transitive groups and byte-pair merges are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
