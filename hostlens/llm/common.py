"""Helpers that several operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.sources.scratch import scratch_path

BATCH_MB = 32
HEAVY_KEYS = 1000


def arrow_batches(spark: SparkSession, mb: int = BATCH_MB) -> None:
    """Bound what one Arrow batch holds by bytes, since texts have no largest length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on and serve later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for some statements only."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that no other name can clash."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))


def hex_of(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text, 256)


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join narrow `rows` to a one-row-per-key `table`, whatever share of the rows one key holds.

    A key with at least 1/1000 of the rows is heavy. There are at most 1000 of those, by
    arithmetic and not by a cap, so their part of the table is broadcast and their rows stay where
    they are; all other rows meet the rest of the table in a shuffle without a hot key. NULL keys
    match nothing.
    """
    total = rows.count()
    counts = rows.groupBy(key).count().where(F.col("count") * HEAVY_KEYS >= max(total, 1))
    heavy = [r[0] for r in counts.where(F.col("count") >= HEAVY_KEYS).select(key).collect()]
    heavy = [k for k in heavy if k is not None]
    if not heavy:
        return rows.join(table, key, how)
    is_heavy = F.col(key).isin(heavy)
    few = F.broadcast(table.where(is_heavy))
    return rows.where(is_heavy).join(few, key, how).unionByName(
        rows.where(~is_heavy | F.col(key).isNull()).join(table.where(~is_heavy), key, how)
    )


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Compute once and store in buckets by `key`, so that grouping by it needs no shuffle."""
    spark = df.sparkSession
    name = f"buckets_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.bucketBy(n, key).option("compression", "zstd").option("path", scratch_path(spark, name))
     .format("parquet").saveAsTable(name))
    return spark.table(name)
