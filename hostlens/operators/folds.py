"""Group-disjoint, class-stratified folds.

Groups with at least 1/(GRAIN * k) of all rows (so at most GRAIN * k of them) are placed one by
one, largest first, on the least loaded fold. The many small ones are spread evenly by a
systematic draw inside every (positives, negatives) profile, cut at the share of rows each fold
still lacks. Profiles with many groups are split by a hash salt, so that no window has to order
more than about SALT_GROUPS groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.urlshape import md5_uniform, md5_word
from hostlens.operators.joins import null_safe_join
from hostlens.sources.scratch import durable

GRAIN = 20
SALT_GROUPS = 100_000


def _least_loaded(groups: Column, k: int) -> Column:
    """Fold over size-sorted groups: state = loads of the k folds and the choices made."""
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), k).alias("loads"),
        F.array().cast("array<int>").alias("folds"),
    )

    def place(state: Column, group: Column) -> Column:
        loads = state["loads"]
        fold = (F.array_position(loads, F.array_min(loads)) - 1).cast("int")
        grown = F.transform(
            loads, lambda load, i: F.when(i == fold, load + group["n"]).otherwise(load)
        )
        return F.struct(
            grown.alias("loads"), F.array_append(state["folds"], fold).alias("folds")
        )

    return F.aggregate(groups, start, place)


def group_folds(
    df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(big, small): fold of every group, each as (group, fold). `big` has at most GRAIN * k rows."""
    sizes = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("n_pos")
    )
    sizes = durable(sizes)  # one row per group, read by every step below
    all_rows = sizes.agg(F.sum("n")).scalar()
    all_groups = sizes.agg(F.count(F.lit(1))).scalar()
    is_big = F.col("n") * (GRAIN * k) >= all_rows

    placed = (
        sizes.where(is_big)
        .agg(
            F.array_sort(
                F.collect_list(F.struct((-F.col("n")).alias("minus_n"), F.col(group).alias("g"), "n"))
            ).alias("big")
        )
        .select("big", _least_loaded(F.col("big"), k).alias("state"))
    )
    big = placed.select(F.explode(F.arrays_zip("big.g", "state.folds")).alias("p")).select(
        F.col("p.g").alias(group), F.col("p.folds").alias("fold")
    )

    # All folds are to be filled up to one level; a fold already above it gets no small groups.
    # With loads in order, the level is the least (rows left + sum of the j lowest) / j.
    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

    lowest = F.array_sort("loads")
    levels = F.transform(
        F.sequence(F.lit(1), F.lit(k)),
        lambda j: (F.col("rows") - total(F.col("loads")) + total(F.slice(lowest, 1, j))) / j,
    )
    level = placed.select("state.loads", all_rows.alias("rows"))
    level = level.withColumn("level", F.array_min(levels))
    lacks = level.select(
        F.transform("loads", lambda load: F.greatest(F.col("level") - load, F.lit(0.0))).alias("lack")
    )
    lack = F.nullif(total(F.col("lack")), F.lit(0.0))
    upto = [total(F.slice("lack", 1, i + 1)) / lack for i in range(k - 1)]
    cuts = lacks.select(F.array(*upto).alias("cuts"))

    salt = md5_word(F.col(group), F.lit("salt")) % F.greatest(
        F.lit(1), F.ceil(all_groups / SALT_GROUPS)
    )
    small = sizes.where(~is_big).withColumn("salt", salt)
    cell = Window.partitionBy("n_pos", "n", "salt")
    small = small.withColumn(
        "rn", F.row_number().over(cell.orderBy(F.md5(F.concat_ws("|", group, F.lit(seed))), group))
    ).withColumn("cnt", F.count(F.lit(1)).over(cell))
    shift = md5_uniform(F.col("n_pos"), F.col("n"), F.col("salt"), F.lit(seed))
    u = (F.col("rn") - 0.5) / F.col("cnt") + shift
    small = small.withColumn("u", u - F.floor(u)).withColumn("cuts", cuts.scalar())
    fold = sum(
        [(F.col("u") >= F.col("cuts")[i]).cast("int") for i in range(k - 1)], F.lit(0)
    )
    return big, small.select(group, fold.cast("int").alias("fold"))


def grouped_folds(
    df: DataFrame, group: str, label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add `fold` in 0..k-1. Groups are never split over folds; rows of a NULL group are one group.

    Rows of the few big groups get their fold by a broadcast of at most GRAIN * k rows and are
    never shuffled; in the shuffle join of the others no key holds more than 1/(GRAIN * k). Which
    rows share a small group's draw changes when the groups pass a multiple of SALT_GROUPS.
    """
    big, small = group_folds(df, group, label, k, seed)
    cols = [*df.columns, "fold"]
    marked = null_safe_join(df, F.broadcast(big), [group], "left")
    rest = null_safe_join(marked.where(F.col("fold").isNull()).drop("fold"), small, [group])
    return marked.where(F.col("fold").isNotNull()).select(*cols).unionByName(rest.select(*cols))
