"""Drift, estimated and realized performance, limits and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, shared
from checks.sqlparts import CHECKS, oracle, r9
from hostlens.functions.lists import FEATURES
from hostlens.operators import drift, estimation
from hostlens.plans import monitoring as mon
from hostlens.sources import fixtures as fx

SLICE_ROWS = drift.DAY_SIZE  # 2,000 rows, at every size of the tables


def _traffic(spark, sf):
    return fx.scored_features(spark, sf).where("NOT is_reference")


def _reference(spark, sf):
    return fx.scored_features(spark, sf).where("is_reference")


def _monitor(spark, sf):
    def build():
        rows = fx.scored_features(spark, sf)  # stored already
        return mon.monitor(rows.where("NOT is_reference"), rows.where("is_reference"), fx.THRESHOLD, SLICE_ROWS)

    return shared("monitor", spark, sf, build)


def _cols(*names):
    return ", ".join(r9(f'"{n}"', f'"{n}"') for n in names)


@query("n1_n2_daily_drift_scores", oracle(f"SELECT day, feature, {_cols('score')} FROM day_scores", "day_scores"))
def n1(spark, sf):
    return drift.drift_scores(_traffic(spark, sf), _reference(spark, sf))


@query("n3_j9_null_scores", oracle(f"SELECT slice, feature, {_cols('score')} FROM null_scores", "null_scores"))
def n3(spark, sf):
    reference = _reference(spark, sf)  # stored already, with the traffic
    return drift.slice_scores(drift.slices(reference, "request_id", SLICE_ROWS), reference)


@query("n3_null_metrics", oracle(f"""
SELECT slice, {_cols(*CHECKS)}, n_requests, {_cols('true_phishing_share')} FROM slice_perf""", "slice_perf"))
def n3b(spark, sf):
    sliced = drift.slices(_reference(spark, sf), "request_id", SLICE_ROWS)
    return drift.performance(sliced, fx.THRESHOLD, ("slice",))


@query("n4_a14_drift_thresholds", oracle(f"SELECT feature, {_cols('threshold')} FROM thresholds", "thresholds"))
def n4(spark, sf):
    return _monitor(spark, sf).thresholds


@query("n5_drifting_features", oracle("SELECT day, n_drifting, drifting_features FROM day_drift", "day_drift"))
def n5(spark, sf):
    m = _monitor(spark, sf)
    return drift.drifting_features(m.scores, m.thresholds)


@query("n6_prediction_drift", oracle(f"""
SELECT day, {_cols('share_safe', 'share_phishing', 'share_review', 'mean_probability')} FROM day_perf""", "day_perf"))
def n6(spark, sf):
    return drift.performance(_traffic(spark, sf), fx.THRESHOLD, ("day",)).select(
        "day", "share_safe", "share_phishing", "share_review", "mean_probability"
    )


@query("m11_m13_estimated_and_realized", oracle(f"""
SELECT day, {_cols('est_precision', 'est_recall', 'real_precision', 'real_recall')} FROM day_perf""", "day_perf"))
def m11(spark, sf):
    p = F.col("probability")
    flagged = p >= fx.THRESHOLD
    return _traffic(spark, sf).groupBy("day").agg(
        *estimation.estimated(p, flagged), *estimation.realized(flagged, F.col("label"))
    )


INTERVAL = ("est_precision_low", "est_precision_high", "est_recall_low", "est_recall_high")


@query("m12_estimation_interval", oracle(f"SELECT day, {_cols(*INTERVAL)} FROM interval", "interval"))
def m12(spark, sf):
    return estimation.estimation_interval(_traffic(spark, sf), "day", "request_id", fx.THRESHOLD)


@query("n7_daily_report", oracle(f"""
SELECT day, {_cols(*CHECKS)}, n_requests, {_cols('true_phishing_share')}, n_drifting, drifting_features, {_cols(*INTERVAL)}
FROM daily""", "daily"))
def n7(spark, sf):
    return _monitor(spark, sf).daily


@query("a13_limits", oracle(f'SELECT "check", {_cols("low", "high", "reference")} FROM limits', "limits"))
def a13(spark, sf):
    sliced = drift.slices(_reference(spark, sf), "request_id", SLICE_ROWS)
    return drift.limits(drift.performance(sliced, fx.THRESHOLD, ("slice",)))


@query("n8_j11_alerts", oracle(f'SELECT day, "check", {_cols("value", "limit")}, direction FROM alerts', "alerts"))
def n8(spark, sf):
    return _monitor(spark, sf).alerts


@query("n9_drift_ratio_matrix", oracle("""
SELECT day, """ + ", ".join(r9(f"max(CASE WHEN feature = '{f}' THEN least(score / threshold, 4) END)", f) for f in FEATURES) + """
FROM day_scores JOIN thresholds USING (feature) GROUP BY day""", "day_scores", "thresholds"))
def n9(spark, sf):
    m = _monitor(spark, sf)
    return drift.drift_ratios(m.scores, m.thresholds).groupBy("day").pivot("feature", list(FEATURES)).agg(F.max("ratio"))


@query("n10_null_drifting_max", oracle("""
SELECT max(n)::BIGINT AS null_max FROM (SELECT slice, count(*) FILTER (score > threshold) AS n
  FROM null_scores JOIN thresholds USING (feature) GROUP BY slice)""", "null_scores", "thresholds"))
def n10(spark, sf):
    m = _monitor(spark, sf)
    return mon.null_drifting_counts(m.null_scores, m.thresholds).agg(F.max("n_drifting").alias("null_max"))


@query("a17_scenario_summary", oracle("""
SELECT scenario, """ + ", ".join(r9(f"avg({c})", c) for c in mon.SUMMARY) + """,
  (SELECT count(*) FROM alerts a WHERE a.day BETWEEN any_value(lo) AND any_value(hi)) AS alerts
FROM daily JOIN scenarios ON day BETWEEN lo AND hi GROUP BY scenario""", "daily", "alerts", "scenarios"))
def a17(spark, sf):
    m = _monitor(spark, sf)
    return mon.scenario_summary(m.daily, m.alerts)


@query("a17_scenario_checks", oracle("""
SELECT "check", """ + ", ".join(f"count(*) FILTER (day BETWEEN {lo} AND {hi}) AS \"{n}\"" for lo, hi, n in mon.SCENARIOS) + """
FROM alerts GROUP BY 1""", "alerts"))
def a17b(spark, sf):
    return mon.scenario_checks(_monitor(spark, sf).alerts)


@query("m14_estimate_gap", oracle(f"""
SELECT scenario, {r9('avg(abs(est_precision - real_precision))', 'precision_gap')}, {r9('avg(abs(est_recall - real_recall))', 'recall_gap')}
FROM day_perf JOIN scenarios ON day BETWEEN lo AND hi GROUP BY 1""", "day_perf", "scenarios"))
def m14(spark, sf):
    daily = drift.performance(_traffic(spark, sf), fx.THRESHOLD, ("day",))
    return mon.estimate_gap(daily)
