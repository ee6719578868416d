"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hostlens.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {
    "op1_secrets": oracles.SECRETS, "op10_warc": oracles.WARC, "op11_divergence": oracles.DIVERGENCE,
    "op12_hard_negatives": oracles.HARD_NEGATIVES,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.bpe import VOCABULARY, Vocabulary, encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), Vocabulary(VOCABULARY), also=())


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query
def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.ppm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.langid import fit, identify, in_training

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs, in_training(F.col("doc_id")))
    return identify(docs, model).select(
        "doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected"
    )


@_query
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.secrets import digest, scan

    return digest(scan(_table(spark, sf_dir, "documents")))


@_query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.pii import digest, extract

    return digest(extract(_table(spark, sf_dir, "documents")))


@_query
def op5_orderhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.orderhash import edit_report

    return edit_report(_table(spark, sf_dir, "documents"))


@_query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"))


@_query
def op6_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.maintext import extract, fit

    pages = _table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))


@_query
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.divergence import divergence

    return divergence(_table(spark, sf_dir, "documents"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.hardneg import mine

    vectors = _table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


@_query
def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hostlens.llm.suffixes import drop_repeats

    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.begin)
    return drop_repeats(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
