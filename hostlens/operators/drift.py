"""Feature drift, its null distribution, limits and alerts, as long tables keyed by
(group, feature) instead of loops over days, slices or features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.decision import decision
from hostlens.functions.lists import BINARY_FEATURES, FEATURES, NUMERIC_FEATURES
from hostlens.operators.estimation import estimated, low_draws, realized
from hostlens.operators.prefix import group_sums
from hostlens.sources.scratch import broadcast_if_small, durable

# Drift and alert settings.
DRIFT_FLOOR = 0.05
NULL_MARGIN = 1.1
NULL_QUANTILE = 0.99
MAX_DRIFTING = 2
SIGMA = 3.0
DAY_SIZE = 2000
N_NULL = 200
RATIO_CAP = 4.0
CHECKS = (
    "share_safe", "share_phishing", "share_review", "mean_probability",
    "est_precision", "est_recall", "real_precision", "real_recall",
)


def value_counts(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per (by, feature, value) over all features; combines before the shuffle.

    Feature values of hostnames take few distinct values (lengths up to 253, ratios of such,
    entropies of short texts), so every later step works on this small table. Rounding makes
    one value of entropies that differ only by their order of summation; whole numbers need none.
    """
    whole = {name for name, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "boolean")}
    values = [(F.col(f).cast("double") if f in whole else F.round(F.col(f).cast("double"), 12)).alias(f) for f in FEATURES]
    long = df.select(*by, *values).unpivot(
        list(by), list(FEATURES), "feature", "value"
    )
    return long.groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def distribution(counts: DataFrame) -> DataFrame:
    """Per (feature, value): share of rows at or below it, and strictly below it."""
    sums = group_sums(counts, ("feature",), "value", ("n",))
    return sums.select(
        "feature", "value", (F.col("cum_n") / F.col("all_n")).alias("ref_at"),
        ((F.col("cum_n") - F.col("n")) / F.col("all_n")).alias("ref_below"),
    )


def _max_gap(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Largest |F - F_ref| per (by, feature), given ref_at and ref_below at each own value.

    Between two own values F is constant and F_ref only grows, so the extremes lie at the own
    values and just below them.
    """
    sums = group_sums(counts, (*by, "feature"), "value", ("n",))
    total, cum = F.col("all_n"), F.col("cum_n")
    gaps = sums.withColumn(
        "gap",
        F.greatest(
            F.abs(cum / total - F.col("ref_at")),
            F.abs((cum - F.col("n")) / total - F.col("ref_below")),
        ),
    )
    return gaps.groupBy(*by, "feature").agg(F.max("gap").alias("score"))


def _means(counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    return counts.groupBy(*by, "feature").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )


def binary_drift(counts: DataFrame, ref_counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Absolute difference of the proportions, for the 0/1 features."""
    binary = F.col("feature").isin(*BINARY_FEATURES)
    ref = _means(ref_counts.where(binary), ()).withColumnRenamed("mean", "ref_mean")
    cur = _means(counts.where(binary), by)
    return cur.join(ref, "feature").select(
        *by, "feature", F.abs(F.col("mean") - F.col("ref_mean")).alias("score")
    )


def ks_drift(counts: DataFrame, ref_counts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Kolmogorov-Smirnov statistic of each group against the reference, for the others."""
    numeric = F.col("feature").isin(*NUMERIC_FEATURES)
    counts, ref = counts.where(numeric), ref_counts.where(numeric)
    # The reference is read at the groups' values too, so that each value finds its share.
    universe = ref.select("feature", "value", "n").unionByName(
        counts.select("feature", "value", F.lit(0).cast("bigint").alias("n"))
    )
    shares = distribution(universe.groupBy("feature", "value").agg(F.sum("n").alias("n")))
    return _max_gap(counts.join(shares, ["feature", "value"]), by)


def drift_scores(
    df: DataFrame, reference: DataFrame, by: tuple[str, ...] = ("day",)
) -> DataFrame:
    """(by, feature, score) of every group against the reference rows."""
    # Small tables, each read several times; the rows are read once.
    counts, ref = durable(value_counts(df, by)), durable(value_counts(reference))
    return binary_drift(counts, ref, by).unionByName(ks_drift(counts, ref, by))


def slices(
    reference: DataFrame, key: str, rows: int = DAY_SIZE, n: int = N_NULL, seed: int = 42
) -> DataFrame:
    """Each of `n` random slices of exactly `rows` reference rows, without replacement.

    Only (row, slice) pairs whose uniform is below a bound that leaves about m + 12 sqrt(m) rows per
    slice leave the scan, as keys; they are ranked, and the rows are joined to those kept, which are sent
    to the reference if they are few, so that it is not shuffled. A slice that comes out short, as with a
    reference of fewer rows, fails the job.
    """
    total = reference.agg(F.count(F.lit(1)).cast("double")).scalar()
    bound = (F.lit(float(rows)) + 12 * F.sqrt(F.lit(float(rows))) + 100) / total
    near = low_draws(reference.select(key).withColumn("_bound", bound), key, "_bound", n, seed)
    near = near.withColumnRenamed("draw", "slice")
    per_slice = Window.partitionBy("slice")
    ranked = near.withColumn(
        "_rn", F.row_number().over(per_slice.orderBy("u", key))
    ).withColumn("_near", F.count(F.lit(1)).over(per_slice))
    short = F.raise_error(F.lit("slice came out short: too few reference rows, or use another seed"))
    enough = F.when(F.col("_near") >= rows, True).otherwise(short.cast("boolean"))
    kept = ranked.where(enough & (F.col("_rn") <= rows)).select(key, "slice")
    return broadcast_if_small(durable(kept)).join(reference, key).select(*reference.columns, "slice")


def slice_scores(sliced: DataFrame, reference: DataFrame) -> DataFrame:
    """(slice, feature, score) of each slice against the rest of the reference.

    The rest is never built: F_slice - F_rest = n / (n - m) * (F_slice - F_all), and every
    value of a slice is a value of the reference.
    """
    by, numeric = ("slice",), F.col("feature").isin(*NUMERIC_FEATURES)
    counts, ref = durable(value_counts(sliced, by)), durable(value_counts(reference))
    shares = distribution(ref.where(numeric))
    scores = binary_drift(counts, ref, by).unionByName(
        _max_gap(counts.where(numeric).join(shares, ["feature", "value"]), by)
    )
    # Every row counts once in each feature, so one feature gives the sizes.
    one = F.col("feature") == FEATURES[0]
    n = ref.where(one).agg(F.sum("n")).scalar()
    sizes = counts.where(one).groupBy("slice").agg(F.sum("n").alias("m"))
    widened = F.col("score") * n / (n - F.col("m"))
    return scores.join(sizes, "slice").select("slice", "feature", widened.alias("score"))


def thresholds(null_scores: DataFrame) -> DataFrame:
    """Per feature: the floor or a margin over the 99th percentile of pure sampling noise."""
    high = F.percentile("score", F.lit(NULL_QUANTILE)) * NULL_MARGIN
    return null_scores.groupBy("feature").agg(
        F.greatest(F.lit(DRIFT_FLOOR), high).alias("threshold")
    )


def performance(df: DataFrame, threshold, by: tuple[str, ...]) -> DataFrame:
    """The eight checks per group, rows and true share; one aggregate pass."""
    p, flagged = F.col("probability"), F.col("probability") >= threshold
    decided = decision(p, F.col("is_free_hosting"), threshold)

    def share(name: str) -> Column:
        return F.avg((decided == name).cast("double")).alias(f"share_{name}")

    return df.groupBy(*by).agg(
        share("safe"), share("phishing"), share("review"),
        F.avg(p).alias("mean_probability"),
        *estimated(p, flagged),
        *realized(flagged, F.col("label")),
        F.count(F.lit(1)).alias("n_requests"),
        F.avg("label").alias("true_phishing_share"),
    )


def check_values(metrics: DataFrame, by: str) -> DataFrame:
    """Long form of the eight checks."""
    return metrics.unpivot([by], list(CHECKS), "check", "value")


def limits(null_metrics: DataFrame) -> DataFrame:
    """Per check: mean of the null slices and mean -/+ 3 sample deviations."""
    long = check_values(null_metrics, "slice")
    spread = SIGMA * F.stddev_samp("value")
    return long.groupBy("check").agg(
        (F.avg("value") - spread).alias("low"),
        (F.avg("value") + spread).alias("high"),
        F.avg("value").alias("reference"),
    )


def drifting_features(scores: DataFrame, limits_: DataFrame, by: str = "day") -> DataFrame:
    """Per group: how many features drift, and their names in model order."""
    position = F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature"))
    drifts = F.col("score") > F.col("threshold")
    hit = F.when(drifts, F.struct(position.alias("pos"), F.col("feature").alias("name")))
    out = scores.join(limits_, "feature").groupBy(by).agg(
        F.sum(drifts.cast("int")).alias("n_drifting"),
        F.array_sort(F.collect_list(hit)).alias("_hits"),  # at most one per feature
    )
    return out.select(by, "n_drifting", F.col("_hits.name").alias("drifting_features"))


def drift_ratios(scores: DataFrame, limits_: DataFrame) -> DataFrame:
    """(day, feature, ratio): score over threshold, capped for display."""
    ratio = F.least(F.col("score") / F.col("threshold"), F.lit(RATIO_CAP))
    return scores.join(limits_, "feature").select("day", "feature", ratio.alias("ratio"))


def alerts(daily: DataFrame, limits_: DataFrame, by: str = "day") -> DataFrame:
    """Checks strictly outside their limits, and groups with too many drifting features."""
    value = F.col("value")
    broken = (
        check_values(daily, by)
        .join(limits_, "check")
        .where((value < F.col("low")) | (value > F.col("high")))
        .select(
            by, "check", "value",
            F.when(value < F.col("low"), F.col("low")).otherwise(F.col("high")).alias("limit"),
        )
    )
    drifting = daily.where(F.col("n_drifting") > MAX_DRIFTING).select(
        by,
        F.lit("drifting_features").alias("check"),
        F.col("n_drifting").cast("double").alias("value"),
        F.lit(float(MAX_DRIFTING)).alias("limit"),
    )
    direction = F.when(F.col("value") > F.col("limit"), "above").otherwise("below")
    return broken.unionByName(drifting).withColumn("direction", direction)
