"""Columns that are computed exactly once, whatever is built on top of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns behind a one-row `inline`.

    The optimizer copies a projected expression into each later filter and join condition that
    names it. For long expressions that name each other this grows until code generation gives
    up. It does not look through a generator, so here the values are computed once per row and
    later conditions test the finished values.
    """
    values = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(values)))
