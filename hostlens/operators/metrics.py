"""Classification metrics of scored rows, all as aggregates. Missing values are NULL."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.urlshape import equal_width_bin
from hostlens.operators.prefix import prefix_sums, quantile_higher


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("bigint"))


def _over(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0).cast("bigint"))


def threshold_metrics(
    df: DataFrame,
    threshold,
    score: str = "probability",
    label: str = "label",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """precision, recall, f1 and fpr of `score >= threshold`; 0 when nothing is flagged."""
    flagged, pos = F.col(score) >= threshold, F.col(label) == 1
    counts = df.groupBy(*by).agg(
        _count(flagged & pos).alias("tp"), _count(flagged & ~pos).alias("fp"),
        _count(~flagged & pos).alias("fn"), _count(~flagged & ~pos).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        F.coalesce(_over(tp, tp + fp), zero).alias("precision"),
        F.coalesce(_over(tp, tp + fn), zero).alias("recall"),
        F.coalesce(_over(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
        _over(fp, fp + tn).alias("fpr"),
    )


def ranking_metrics(
    df: DataFrame, score: str = "probability", label: str = "label", by: tuple[str, ...] = ()
) -> DataFrame:
    """Average precision (step-wise) and ROC-AUC (ties count half), in one ordered pass."""
    sums = prefix_sums(df, score, {"n": F.lit(1), "pos": F.col(label).cast("bigint")}, by)
    # Scores from high to low: rows at or above a score.
    n_above = F.col("all_n") - F.col("cum_n") + F.col("n")
    pos_above = F.col("all_pos") - F.col("cum_pos") + F.col("pos")
    neg = F.col("n") - F.col("pos")
    precision_gain = F.col("pos") * pos_above / n_above
    rank_gain = neg * (pos_above - F.col("pos") / 2)
    out = sums.groupBy(*by).agg(
        F.sum(precision_gain).alias("_pg"), F.sum(rank_gain).alias("_rg"),
        F.max("all_n").alias("n"), F.max("all_pos").alias("n_pos"),
    )
    pos, all_neg = F.col("n_pos"), F.col("n") - F.col("n_pos")
    return out.select(
        *by, "n", "n_pos",
        _over(F.col("_pg"), pos).alias("average_precision"),
        _over(F.col("_rg"), pos * all_neg).alias("roc_auc"),
    )


def fpr_quantile(
    df: DataFrame,
    target_fpr: float = 0.01,
    score: str = "probability",
    label: str = "label",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """`quantile`: the largest score a legitimate row may have without being flagged, so that
    flagging scores strictly above it keeps the false-positive rate within the target."""
    return quantile_higher(df.where(F.col(label) == 0), score, 1 - target_fpr, by)


def pick_threshold(
    df: DataFrame, target_fpr: float = 0.01, score: str = "probability", label: str = "label"
) -> float:
    """The next double above the quantile, for the rule `score >= threshold`; checked."""
    threshold = math.nextafter(fpr_quantile(df, target_fpr, score, label).first()[0], math.inf)
    legit = df.where(F.col(label) == 0)
    fpr = legit.agg(F.avg((F.col(score) >= threshold).cast("double"))).first()[0]
    if fpr > target_fpr:
        raise ValueError(f"false-positive rate {fpr} above the target {target_fpr}")
    return threshold


def source_check(df: DataFrame, threshold, score: str = "probability") -> DataFrame:
    """Legitimate rows by source: mean score and false-positive rate."""
    return df.where(F.col("label") == 0).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_probability"),
        F.avg((F.col(score) >= threshold).cast("double")).alias("fpr"),
    )


def flagged_rows(df: DataFrame, threshold, score: str = "probability") -> DataFrame:
    """Rows at or above the threshold, highest score first."""
    return df.where(F.col(score) >= threshold).orderBy(F.col(score).desc(), "hostname")


def stress_rates(df: DataFrame, thresholds: dict[str, float], score: str = "probability") -> DataFrame:
    """False-positive rate on the all-legitimate stress list at each named threshold."""
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.avg((F.col(score) >= t).cast("double")).alias(f"fp_rate_{name}")
            for name, t in thresholds.items()
        ],
    )


def brier(df: DataFrame, score: str = "probability", label: str = "label") -> DataFrame:
    """Brier score, and that of always answering the base rate."""
    return df.agg(
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"),
        F.var_pop(label).alias("base_rate_brier"),
    )


def reliability_table(
    df: DataFrame, bins: int = 10, score: str = "probability", label: str = "label"
) -> DataFrame:
    """Equal-width bins, empty ones included: rows, mean score, actual rate, absolute gap."""
    filled = df.groupBy(equal_width_bin(F.col(score), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(score).alias("mean_predicted"),
        F.avg(label).alias("actual_rate"),
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        F.concat(
            F.format_number(F.col("bin") / bins, 1), F.lit("-"),
            F.format_number((F.col("bin") + 1) / bins, 1),
        ).alias("bin_range"),
        F.coalesce("n", F.lit(0)).alias("n"),
        "mean_predicted",
        "actual_rate",
        F.abs(F.col("mean_predicted") - F.col("actual_rate")).alias("gap"),
    )


# Limits of the calibration verdict.
ECE_OK = 0.02
BIN_GAP_OK = 0.10
MIN_BIN_ROWS = 200


def calibration_verdict(table: DataFrame, min_bin_rows: int = MIN_BIN_ROWS) -> DataFrame:
    """ECE, the worst well-filled bin, and whether both are within their limits."""
    big = F.col("n") >= min_bin_rows
    out = table.agg(
        (F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"),
        F.max_by(F.when(big, F.col("bin_range")), F.when(big, F.col("gap"))).alias("worst_bin"),
        F.max(F.when(big, F.col("gap"))).alias("worst_gap"),
    )
    ok = (F.col("ece") <= ECE_OK) & (F.col("worst_gap") <= BIN_GAP_OK)
    return out.withColumn("calibrated", F.coalesce(ok, F.lit(False)))


def fold_summary(per_fold: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and population deviation over folds."""
    return per_fold.groupBy(*by).agg(
        F.avg("average_precision").alias("cv_pr_auc_mean"),
        F.stddev_pop("average_precision").alias("cv_pr_auc_std"),
        F.avg("roc_auc").alias("cv_roc_auc_mean"),
    )


def score_parity(a: DataFrame, b: DataFrame, key: str, score: str = "probability") -> DataFrame:
    """Largest difference of two score columns, and rows that only one side has."""
    joined = a.select(key, F.col(score).alias("_a")).join(
        b.select(key, F.col(score).alias("_b")), key, "full"
    )
    return joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
        _count(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"),
    )
