"""Exact samples and holdouts that give the same rows on any partitioning.

Rows are ordered by the md5 of their key and a seed. The rows wanted are the first k of that
order in each stratum. No stratum is ever sorted as a whole: counts per hash cell find the one
cell where row k lies, only that cell is ranked, and the (hash, key) pair of row k is the cut
that a last map-only pass compares with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.urlshape import md5_word
from hostlens.operators.joins import null_safe_join
from hostlens.sources.scratch import broadcast_if_small, durable

CELL_BITS = 16


def with_hash_cut(
    df: DataFrame, strata: list[str], key: str, take: Column, seed: int = 42
) -> DataFrame:
    """Add `taken`: TRUE for the first `take` rows per stratum by (md5 word, key).

    `take` may use `n`, the rows of the stratum, and the strata columns; NULL is a stratum. `key` is unique. The input
    is read three times, so it should be a stored table; the two small tables in between, of one
    row per stratum, are stored and broadcast after a check of their size.
    """
    word = md5_word(F.col(key), F.lit(seed))
    rows = df.withColumn("_word", word)
    keyed = rows.select(
        *strata, "_word", F.col(key).alias("_key"),
        F.shiftright("_word", 32 - CELL_BITS).alias("_cell"),
    )
    cells = keyed.groupBy(*strata, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    by = Window.partitionBy(*strata)
    cells = (
        cells.withColumn("n", F.sum("_in_cell").over(by))
        .withColumn(
            "_before",
            F.sum("_in_cell").over(by.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("_in_cell"),
        )
        .withColumn("_left", F.least(take, F.col("n")) - F.col("_before"))
    )
    # The cell that holds row k, one per stratum.
    edge = cells.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_in_cell")))
    edge = broadcast_if_small(durable(edge.select(*strata, "_cell", "_left")))
    in_edge = null_safe_join(keyed, edge, [*strata, "_cell"])
    ranked = in_edge.withColumn(
        "_rn",
        F.row_number().over(Window.partitionBy(*strata, "_cell").orderBy("_word", "_key")),
    )
    cut = ranked.where(F.col("_rn") == F.col("_left")).select(
        *strata, F.struct("_word", "_key").alias("_cut")
    )
    marked = null_safe_join(rows, broadcast_if_small(durable(cut)), strata, "left")
    taken = F.struct(F.col("_word"), F.col(key).alias("_key")) <= F.col("_cut")
    return marked.select(*df.columns, F.coalesce(taken, F.lit(False)).alias("taken"))


def stratified_holdout(
    df: DataFrame, stratum: str, key: str, fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add `is_reference`: exactly round(fraction * n) rows of each stratum."""
    take = F.round(F.col("n") * fraction)
    return with_hash_cut(df, [stratum], key, take, seed).withColumnRenamed("taken", "is_reference")


def sample_exact(
    df: DataFrame, stratum: str, sizes: dict, key: str, seed: int = 42
) -> DataFrame:
    """Exactly sizes[s] rows of each stratum s without replacement (all, if it has fewer)."""
    take = F.lit(0)
    for value, n in sizes.items():
        take = F.when(F.col(stratum) == value, n).otherwise(take)
    return with_hash_cut(df, [stratum], key, take, seed).where("taken").drop("taken")
