"""Deduplication and per-group limits. Everything that can combines before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The first row per key by `order` (unique per key).

    An aggregate, not a window: copies combine on the map side, so a key that holds a large
    share of all rows costs one row per task in the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return first.select(*keys, "_first.*").select(*df.columns)


def conflicting_keys(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Keys that carry more than one distinct label."""
    spread = df.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return spread.where(F.col("_lo") != F.col("_hi")).select(key)


def drop_conflicts(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    return df.join(conflicting_keys(df, key, label), key, "left_anti")


def cap_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows per group. The limit on row_number runs in every task before the
    shuffle, so a hot group sends at most n rows per task."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")
