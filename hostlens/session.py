"""Session settings that suit short rows with costly expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def settings(shuffle_partitions: int | None = None) -> dict[str, str]:
    """UTC days, adaptive execution with skew handling, and a small lower bound for merged
    shuffle partitions: a megabyte of hostnames is already more than a second of work."""
    out = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128KB",
    }
    if shuffle_partitions:
        out["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return out


def configure(builder: SparkSession.Builder, shuffle_partitions: int | None = None):
    for key, value in settings(shuffle_partitions).items():
        builder = builder.config(key, value)
    return builder
