"""Typed sources and sinks. No schema is ever inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_URLS = "url STRING, label INT"
RANKED_RAW = "rank INT, raw STRING"
RANKED_DOMAIN = "rank INT, domain STRING"
STRESS = "hostname STRING"
HOSTS = "hostname STRING, registered_domain STRING, label INT, source STRING"
PREDICTION_LOG = (
    "request_id STRING, timestamp TIMESTAMP, hostname STRING, probability DOUBLE, "
    "decision STRING, model_version STRING"
)
DELAYED_LABELS = "request_id STRING, day INT, label INT"

# Fixed value: log times keep their microseconds.
LOG_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LOG_COLUMNS = tuple(part.split()[0] for part in PREDICTION_LOG.split(", "))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header line."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', mode="FAILFAST")


def read_ranked(
    spark: SparkSession, path: str, schema: str = RANKED_RAW, top_n: int | None = None
) -> DataFrame:
    """Headerless rank list; the top N go by the rank column, as file order is not defined."""
    df = spark.read.schema(schema).csv(path, header=False, escape='"', mode="FAILFAST")
    return df if top_n is None else df.where(F.col("rank") <= top_n)


def read_prediction_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION_LOG).json(path, mode="FAILFAST", timestampFormat=LOG_TIME)


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer partitions than cores (one small or unsplittable file) dealt
    out to all cores; any larger input is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Train and test as one table, so a reader of one split prunes the other's files."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def append_prediction_log(scored: DataFrame, path: str) -> None:
    """Append JSON lines with the log columns only: a URL never reaches the log."""
    log_rows(scored).write.mode("append").json(path, timestampFormat=LOG_TIME)


def log_rows(scored: DataFrame) -> DataFrame:
    return scored.select(*LOG_COLUMNS)


def ingest_raw(df: DataFrame) -> DataFrame:
    """Pick and rename the raw columns; the source labels 1 = legitimate, ours 1 = phishing."""
    return df.select(F.col("URL").alias("url"), (1 - F.col("label")).cast("int").alias("label"))
