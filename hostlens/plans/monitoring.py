"""Daily monitoring of scored traffic against a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.features import with_features
from hostlens.functions.urlshape import day_index
from hostlens.operators import drift, metrics
from hostlens.operators.estimation import estimation_interval
from hostlens.sources.scratch import durable

# First and last day of each scenario.
SCENARIOS = (
    (1, 10, "normal"), (11, 20, "free-hosting campaign"), (21, 30, "clean-looking phishing"),
)


def join_labels(log: DataFrame, labels: DataFrame, start: str) -> DataFrame:
    """Log rows with their delayed label (NULL while it is missing) and day index."""
    late = labels.select("request_id", "label")
    return log.join(late, "request_id", "left").withColumn(
        "day", day_index(F.col("timestamp"), start)
    )


def label_coverage(log: DataFrame, labels: DataFrame) -> DataFrame:
    """Logged requests, and how many of them have no label (must be 0)."""
    missing = log.join(labels, "request_id", "left_anti")
    return log.agg(F.count(F.lit(1)).alias("n_requests")).withColumn(
        "n_unlabelled", missing.agg(F.count(F.lit(1))).scalar()
    )


def scenario_of(day: Column) -> Column:
    """Name of the inclusive day range a day lies in."""
    result = F.lit(None).cast("string")
    for lo, hi, name in SCENARIOS:
        result = F.when(day.between(lo, hi), name).otherwise(result)
    return result


@dataclass
class Monitoring:
    daily: DataFrame
    scores: DataFrame
    thresholds: DataFrame
    limits: DataFrame
    alerts: DataFrame
    null_scores: DataFrame


def monitor(
    traffic: DataFrame,
    reference: DataFrame,
    threshold: float,
    slice_rows: int = drift.DAY_SIZE,
    n_null: int = drift.N_NULL,
    n_draws: int = 200,
    seed: int = 42,
    persist: bool = True,
) -> Monitoring:
    """All monitoring tables.

    `traffic`: request_id, day, probability, label and the features; `reference`: the same but
    for `day`. What several results share is computed once (`persist`). A traffic row without its
    label stops the run: it would silently leave realized precision and recall.
    """
    if traffic.where(F.col("label").isNull()).limit(1).count():
        raise ValueError("traffic has rows without a label; see label_coverage")
    keep = durable if persist else (lambda df: df)
    sliced = keep(drift.slices(reference, "request_id", slice_rows, n_null, seed))
    null_scores = keep(drift.slice_scores(sliced, reference))
    null_metrics = drift.performance(sliced, threshold, ("slice",))
    limits_by_feature = drift.thresholds(null_scores)
    limits_by_check = drift.limits(null_metrics)

    scores = keep(drift.drift_scores(traffic, reference))
    daily = (
        drift.performance(traffic, threshold, ("day",))
        .join(drift.drifting_features(scores, limits_by_feature), "day")
        .join(estimation_interval(traffic, "day", "request_id", threshold, n_draws, seed), "day")
    )
    daily = keep(daily)
    return Monitoring(
        daily, scores, limits_by_feature, limits_by_check,
        drift.alerts(daily, limits_by_check), null_scores,
    )


def monitor_log(
    log: DataFrame, labels: DataFrame, reference_log: DataFrame, threshold: float, start: str, **settings
) -> Monitoring:
    """`monitor` from what scoring leaves behind: the prediction log of the traffic, that of the reference,
    and the delayed labels of both (request_id, label). The features are computed again from the hosts.

    A logged request without a label stops the run, whichever log it is in.
    """
    late = labels.select("request_id", "label")

    def ready(rows: DataFrame, *more: str) -> DataFrame:
        return durable(with_features(rows.select("request_id", "hostname", "probability", "label", *more)))

    reference = ready(reference_log.join(late, "request_id", "left"))
    if reference.where(F.col("label").isNull()).limit(1).count():
        raise ValueError("the reference has rows without a label; see label_coverage")
    return monitor(ready(join_labels(log, late, start), "day"), reference, threshold, **settings)


def calibration(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reliability table of scored, labelled rows, and one row with the Brier score, that of the base
    rate, and the verdict. One pass over the rows for each of the two aggregates."""
    table = durable(metrics.reliability_table(scored))
    verdict = F.broadcast(metrics.calibration_verdict(table))  # one row
    return table, metrics.brier(scored).join(verdict, F.lit(True))


def null_drifting_counts(null_scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per null slice: how many features pass their own threshold."""
    return drift.drifting_features(null_scores, thresholds, "slice").select("slice", "n_drifting")


SUMMARY = (
    "true_phishing_share", "n_drifting", "share_safe", "share_phishing", "share_review",
    "mean_probability", "est_precision", "real_precision", "est_recall", "real_recall",
)


def scenario_summary(daily: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per scenario: means of the daily values and alerts fired (0 when none)."""
    means = daily.groupBy(scenario_of(F.col("day")).alias("scenario")).agg(
        *[F.avg(c).alias(c) for c in SUMMARY]
    )
    fired = alerts.groupBy(scenario_of(F.col("day")).alias("scenario")).agg(
        F.count(F.lit(1)).alias("alerts")
    )
    return means.join(fired, "scenario", "left").na.fill(0, ["alerts"])


def scenario_checks(alerts: DataFrame) -> DataFrame:
    """Alerts per check, one column per scenario."""
    names = [name for _, _, name in SCENARIOS]
    return (
        alerts.withColumn("scenario", scenario_of(F.col("day")))
        .groupBy("check").pivot("scenario", names).count().na.fill(0)
    )


def estimate_gap(daily: DataFrame) -> DataFrame:
    """Per scenario: mean absolute gap between estimated and realized performance."""
    return daily.groupBy(scenario_of(F.col("day")).alias("scenario")).agg(
        *[
            F.avg(F.abs(F.col(f"est_{m}") - F.col(f"real_{m}"))).alias(f"{m}_gap")
            for m in ("precision", "recall")
        ]
    )
