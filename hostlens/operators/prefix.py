"""Cumulative sums over a global order without a one-task window.

Values are counted per distinct value first (map-side combine). Approximate quantiles of the
distinct values of each group cut its order into cells, so that neither ties nor a narrow group fill
one; a strictly monotone search finds a value's cell. Sums run inside each cell in parallel, and the
totals of the earlier cells are added. The number of cells and their bounds only steer the
partitioning: any give the same sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.operators.joins import null_safe_join
from hostlens.sources.scratch import broadcast_if_small, durable

CELLS = 256


def with_cell(df: DataFrame, value: str, bounds: Column, cells: int) -> DataFrame:
    """Add `_cell` = number of bounds <= value, by binary search in generated code; `cells` is a power
    of two, and there is one bound less."""
    df = df.withColumn("_bounds", bounds).withColumn("_cell", F.lit(0))
    step = cells // 2
    while step:
        probe = F.element_at("_bounds", F.col("_cell") + step)
        df = df.withColumn(
            "_cell", F.col("_cell") + F.when(probe <= F.col(value), step).otherwise(0)
        )
        step //= 2
    return df.drop("_bounds")


def prefix_sums(
    df: DataFrame, value: str, sums: dict[str, Column], by: tuple[str, ...] = (), cells: int | None = None
) -> DataFrame:
    """Per distinct (by, value): each sum, `cum_<name>` up to and with the value, `all_<name>`.

    `sums` maps a name to the row expression that is summed; a group has at least `cells` cells, by
    default CELLS or as many as there are shuffle partitions. NULL values have no sum; NULL keys are
    a group.
    """
    by = list(by)
    cells = max(cells or max(CELLS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 2)
    cells = 1 << (cells - 1).bit_length()
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(e).alias(name) for name, e in sums.items()]
    )
    fractions = [i / cells for i in range(1, cells)]
    cut = F.percentile_approx(value, fractions, max(10_000, 4 * cells)).alias("_cuts")
    if by:
        counts = durable(counts)
        bounds = broadcast_if_small(durable(counts.groupBy(*by).agg(cut)), 1000)
        counts = null_safe_join(counts, bounds, by)
        counts = with_cell(counts, value, F.col("_cuts"), cells).drop("_cuts")
    else:
        counts = with_cell(counts, value, counts.agg(cut).scalar(), cells)

    per_cell = counts.groupBy(*by, "_cell").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    per_cell = per_cell.select(
        *by,
        "_cell",
        *[(F.sum(f"_t_{n}").over(earlier) - F.col(f"_t_{n}")).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"all_{n}") for n in sums],
    )
    running = (
        Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = counts.select("*", *[F.sum(n).over(running).alias(f"_c_{n}") for n in sums])
    joined = null_safe_join(inside, per_cell, [*by, "_cell"])
    return joined.select(
        *by,
        value,
        *sums,
        *[(F.col(f"_b_{n}") + F.col(f"_c_{n}")).alias(f"cum_{n}") for n in sums],
        *[f"all_{n}" for n in sums],
    )


def group_sums(
    counts: DataFrame, by: tuple[str, ...], value: str, sums: tuple[str, ...], nexts: Column | None = None
) -> DataFrame:
    """Add `cum_<name>` and `all_<name>` of each sum to one row per (by, value), for any number of groups; with
    the condition `nexts`, also `next`: the next higher value whose row meets it.

    All groups lie in one order, cut by Spark's range partitioning into even cells: a long group spans
    several, a cell holds several short ones. Only totals per (group, cell) cross cells. NULL is a group
    and a lowest value. Where the cells begin never changes a result.
    """
    by, earlier_names = list(by), [f"_b_{n}" for n in sums]
    cells = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that a row's cell is decided once.
    rows = durable(counts.repartitionByRange(cells, *by, value).withColumn("_cell", F.spark_partition_id()))
    wanted = F.when(nexts if nexts is not None else F.lit(False), F.col(value))
    totals = rows.groupBy(*by, "_cell").agg(*[F.sum(n).alias(f"_t_{n}") for n in sums], F.min(wanted).alias("_first"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    after = group.orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select(
        *by, "_cell",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(group).alias(f"all_{n}") for n in sums],
        F.min("_first").over(after).alias("_later"),
    )
    cell = Window.partitionBy(*by, "_cell").orderBy(value)
    upto, rest = cell.rowsBetween(Window.unboundedPreceding, 0), cell.rowsBetween(1, Window.unboundedFollowing)
    inside = rows.select("*", *[F.sum(n).over(upto).alias(f"_c_{n}") for n in sums], F.min(wanted).over(rest).alias("_next"))
    joined = null_safe_join(inside, totals, [*by, "_cell"])
    out = [(F.col(b) + F.col(f"_c_{n}")).alias(f"cum_{n}") for b, n in zip(earlier_names, sums)]
    following = [] if nexts is None else [F.coalesce("_next", "_later").alias("next")]
    return joined.select(*counts.columns, *out, *[f"all_{n}" for n in sums], *following)


def group_quantiles(counts: DataFrame, by: tuple[str, ...], value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles per group of values with counts (by, value, n), between two values by linear
    interpolation. NULL values have no part."""
    sums = group_sums(counts.where(F.col(value).isNotNull()), by, value, (n,))
    total, upto = F.col(f"all_{n}"), F.col(f"cum_{n}")

    def at(index: Column) -> Column:
        return F.min(F.when(upto > index, F.col(value)))

    out = []
    for name, q in shares.items():
        place = (total - 1) * q
        part = F.max(place - F.floor(place))
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * part).alias(name))
    return sums.groupBy(*by).agg(*out)


def quantile_higher(df: DataFrame, value: str, q: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantile that is a data value: 0-based index ceil((n - 1) * q) of the order."""
    sums = prefix_sums(df, value, {"n": F.lit(1)}, by)
    wanted = F.ceil((F.col("all_n") - 1) * q) + 1
    return sums.groupBy(*by).agg(
        F.min(F.when(F.col("cum_n") >= wanted, F.col(value))).alias("quantile")
    )
