"""Registration of queries and their oracles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.sources.scratch import present

Query = Callable[[SparkSession, str], DataFrame]
_shared: dict = {}
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; doubles are rounded to 9 digits, as in its oracle."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame) -> DataFrame:
    out = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in ("double", "float"):
            # The offset takes exact ties the same way in both engines.
            c = F.round(c + F.lit(1e-12), 9) + F.lit(0.0)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")  # SQL side: plain timestamps
        elif kind.startswith("array<string"):
            c = F.array_join(c, ", ")
        out.append(c.alias(field.name))
    return df.select(*out)


def shared(name: str, spark: SparkSession, sf_dir: str, build: Callable):
    """A table or model that several queries of one session use."""
    key = (name, sf_dir, spark.sparkContext.applicationId)
    if key not in _shared or not all(map(present, _tables(_shared[key]))):
        _shared[key] = build()
    return _shared[key]


def _tables(value) -> list[DataFrame]:
    """The stored tables inside a shared value."""
    if isinstance(value, DataFrame):
        return [value]
    if is_dataclass(value):
        value = {f.name: getattr(value, f.name) for f in fields(value)}
    return [t for v in value.values() for t in _tables(v)] if isinstance(value, dict) else []
