"""Joins on keys that may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """Marked for a join by shuffle. Spark takes the size of rows exploded from a stored table to be that of its files,
    however many they are, and would send all of them to every task by way of the driver."""
    return df.hint("merge")


def null_safe_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys of which NULL equals NULL; the keys of `rows` stay."""
    renamed = table.select(*[F.col(c).alias(f"_of_{c}" if c in keys else c) for c in table.columns])
    same = [rows[c].eqNullSafe(renamed[f"_of_{c}"]) for c in keys]
    return rows.join(renamed, same, how).drop(*[f"_of_{c}" for c in keys])
