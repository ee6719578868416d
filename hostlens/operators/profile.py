"""Exploration reports: balances, crosstabs, distributions, top lists, feature audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.lists import FEATURES
from hostlens.functions.urlshape import safe_ratio
from hostlens.operators.prefix import group_quantiles
from hostlens.sources.scratch import durable


def _rows() -> Column:
    return F.count(F.lit(1))


def value_shares(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and their percentage of all rows."""
    counts = df.groupBy(key).agg(_rows().alias("n"))
    return counts.withColumn("percent", F.col("n") / counts.agg(F.sum("n")).scalar() * 100)


def duplicate_counts(df: DataFrame, key: str, by: str, order: str) -> DataFrame:
    """Per class: rows that repeat an earlier key. The first copy of a key belongs to the class
    of its lowest `order`; all other copies are duplicates of their own class."""
    copies = df.groupBy(key, by).agg(_rows().alias("n"), F.min(order).alias("first"))
    first = Window.partitionBy(key)  # at most one row per class and key
    repeats = F.col("n") - (F.col("first") == F.min("first").over(first)).cast("int")
    return copies.withColumn("repeats", repeats).groupBy(by).agg(
        F.sum("repeats").alias("n_duplicates")
    )


def conflict_count(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """How many keys carry more than one label."""
    spread = df.groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return spread.agg(
        F.coalesce(F.sum((F.col("lo") != F.col("hi")).cast("bigint")), F.lit(0)).alias(
            "n_conflicting"
        )
    )


def flag_shares(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Per class: rows, and the percentage of rows with each flag."""
    return df.groupBy(by).agg(
        _rows().alias("n"),
        *[(F.avg(flag.cast("double")) * 100).alias(name) for name, flag in flags.items()],
    )


def crosstab(df: DataFrame, row: str, column: str, missing: str) -> DataFrame:
    """Counts (row, column, n) of all pairs of values found; a NULL counts as `missing`. Pivot it for
    display, where the values are known to be few."""
    return df.groupBy(row, F.coalesce(column, F.lit(missing)).alias(column)).agg(_rows().alias("n"))


def crosstab_shares(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Percentages per column value: each column adds up to 100."""
    counts = df.groupBy(row).pivot(column, values).agg(_rows()).na.fill(0)
    total = Window.partitionBy()  # over the few distinct row values
    return counts.select(
        row, *[(F.col(v) / F.sum(v).over(total) * 100).alias(v) for v in values]
    )


def distinct_per_class(
    df: DataFrame, key: str, by: str, rsd: float | None = None
) -> DataFrame:
    """Distinct keys per class and overall (NULL class); approximate when `rsd` is given."""
    if rsd is not None:
        return df.rollup(by).agg(F.approx_count_distinct(key, rsd).alias("n_distinct"))
    pairs = df.groupBy(key, by).agg(F.lit(1).alias("one")).groupBy(key)
    per_key = pairs.agg(F.collect_set(by).alias("classes"))  # at most one entry per class
    exploded = per_key.select(F.explode(F.array_append("classes", F.lit(None))).alias(by))
    return exploded.groupBy(by).agg(_rows().alias("n_distinct"))


def keys_in_all_classes(df: DataFrame, key: str, by: str) -> DataFrame:
    """How many keys occur in more than one class."""
    spread = df.groupBy(key).agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    return spread.where(F.col("lo") != F.col("hi")).agg(_rows().alias("n_shared"))


def top_per_class(df: DataFrame, key: str, by: str, k: int = 20) -> DataFrame:
    """The k most frequent keys per class: share of the class and cumulative share."""
    counts = df.groupBy(by, key).agg(_rows().alias("n"))
    totals = counts.groupBy(by).agg(F.sum("n").alias("class_rows"))
    order = Window.partitionBy(by).orderBy(F.col("n").desc(), key)
    top = counts.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    percent = F.col("n") / F.col("class_rows") * 100
    upto = Window.partitionBy(by).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    return top.join(totals, by).select(
        by, "rn", key, "n", percent.alias("percent"), F.sum(percent).over(upto).alias("cum_percent")
    )


def describe(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max."""
    # Exact percentiles merge per distinct value, so they combine before the shuffle.
    quartiles = F.percentile(value, [0.25, 0.5, 0.75])
    return df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
        quartiles[0].alias("p25"), quartiles[1].alias("p50"), quartiles[2].alias("p75"),
        F.max(value).cast("double").alias("max"),
    )


def describe_features(feats: DataFrame) -> DataFrame:
    """`describe` for every feature, as one long table; quartiles from counts per value, so that no task
    holds all values of a feature."""
    long = feats.select(*[F.col(f).cast("double").alias(f) for f in FEATURES]).unpivot(
        [], list(FEATURES), "feature", "value"
    )
    counts = durable(long.groupBy("feature", "value").agg(_rows().alias("n")))
    spread = long.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = group_quantiles(counts, ("feature",), "value", "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return spread.join(F.broadcast(quartiles), "feature", "left").select(  # a row per feature
        "feature", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def histogram(
    df: DataFrame, value: str, by: str, width: int = 5, upper: int = 300
) -> DataFrame:
    """Rows per class and fixed-width bin over 0..upper; larger values are clipped into the
    last bin, which is closed."""
    clipped = F.least(F.col(value), F.lit(upper))
    bin_ = F.least(F.floor(clipped / width), F.lit(upper // width - 1)).cast("int")
    return df.groupBy(by, (bin_ * width).alias("bin_start")).agg(_rows().alias("n"))


def feature_means(feats: DataFrame, by: str, classes: tuple[str, str]) -> DataFrame:
    """Per feature: mean per class and the ratio of the first to the second (NULL for 0)."""
    long = feats.select(by, *[F.col(f).cast("double").alias(f) for f in FEATURES]).unpivot(
        [by], list(FEATURES), "feature", "value"
    )
    means = long.groupBy("feature").pivot(by, list(classes)).agg(F.avg("value"))
    a, b = classes
    return means.withColumn("ratio", safe_ratio(F.col(a), F.col(b)))
