"""Evaluation metrics on the scored requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlparts import oracle, r9
from hostlens.operators import metrics
from hostlens.sources import fixtures as fx

T = "0.626::DOUBLE"
FLAG = f"probability >= {T}"

RANKING = """
  SELECT {by} sum(pos * pa / na) / nullif(max(ap), 0) AS ap, sum((n - pos) * (pa - pos / 2)) / nullif(max(ap) * (max(an) - max(ap)), 0) AS auc,
    max(an)::BIGINT AS n, max(ap)::BIGINT AS n_pos
  FROM (SELECT *, sum(n) OVER ({part} ORDER BY probability DESC) AS na, sum(pos) OVER ({part} ORDER BY probability DESC) AS pa,
          sum(n) OVER ({part}) AS an, sum(pos) OVER ({part}) AS ap
        FROM (SELECT {by} probability, count(*) AS n, sum(label) AS pos FROM scored GROUP BY ALL)) {group}"""
BY_SOURCE = RANKING.format(by="source,", part="PARTITION BY source", group="GROUP BY source")


@query("m1_threshold_metrics", oracle(f"""
SELECT tp, fp, fn, tn, {r9('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {r9('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')},
  {r9('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, {r9('fp / nullif(fp + tn, 0)', 'fpr')}
FROM (SELECT count(*) FILTER ({FLAG} AND label = 1) AS tp, count(*) FILTER ({FLAG} AND label = 0) AS fp,
  count(*) FILTER (NOT {FLAG} AND label = 1) AS fn, count(*) FILTER (NOT {FLAG} AND label = 0) AS tn FROM scored)""", "scored"))
def m1(spark, sf):
    return metrics.threshold_metrics(fx.scored(spark, sf), fx.THRESHOLD)


@query("m2_m3_ranking_metrics", oracle(f"""
SELECT n, n_pos, {r9('ap', 'average_precision')}, {r9('auc', 'roc_auc')} FROM ({RANKING.format(by='', part='', group='')})""", "scored"))
def m2(spark, sf):
    return metrics.ranking_metrics(fx.scored(spark, sf))


@query("m2_m3_ranking_by_source", oracle(f"""
SELECT source, n, n_pos, {r9('ap', 'average_precision')}, {r9('auc', 'roc_auc')} FROM ({BY_SOURCE})""", "scored"))
def m2b(spark, sf):
    return metrics.ranking_metrics(fx.scored(spark, sf), by=("source",))


@query("a16_fold_summary", oracle(f"""
SELECT {r9('avg(ap)', 'cv_pr_auc_mean')}, {r9('stddev_pop(ap)', 'cv_pr_auc_std')}, {r9('avg(auc)', 'cv_roc_auc_mean')} FROM ({BY_SOURCE})""", "scored"))
def a16(spark, sf):
    return metrics.fold_summary(metrics.ranking_metrics(fx.scored(spark, sf), by=("source",)))


@query("m4_threshold_at_fpr", oracle(f"""
SELECT {r9('q', 'quantile')}, {r9('(SELECT avg((probability > q)::INT) FROM scored WHERE label = 0)', 'fpr_above')}
FROM (SELECT list_sort(list(probability))[ceil((count(*) - 1) * (1 - 0.01::DOUBLE))::BIGINT + 1] AS q FROM scored WHERE label = 0)""", "scored"))
def m4(spark, sf):
    rows = fx.scored(spark, sf)
    q = metrics.fpr_quantile(rows, 0.01)
    legit = rows.where("label = 0").withColumn("q", q.scalar())
    return legit.groupBy(F.col("q").alias("quantile")).agg(
        F.avg((F.col("probability") > F.col("q")).cast("double")).alias("fpr_above")
    )


@query("m5_stress_rates", oracle(f"""
SELECT count(*) AS n, {r9(f'avg((probability >= {T})::INT)', 'fp_rate_fpr1')}, {r9('avg((probability >= 0.5)::INT)', 'fp_rate_t05')}
FROM scored WHERE label = 0""", "scored"))
def m5(spark, sf):
    legit = fx.scored(spark, sf).where("label = 0")
    return metrics.stress_rates(legit, {"fpr1": fx.THRESHOLD, "t05": 0.5})


@query("m5_w4_flagged_rows", oracle(f"""
SELECT request_id, hostname, {r9('probability', 'probability')} FROM scored WHERE label = 0 AND {FLAG}""", "scored"))
def m5b(spark, sf):
    legit = fx.scored(spark, sf).where("label = 0").select("request_id", "hostname", "probability")
    return metrics.flagged_rows(legit, fx.THRESHOLD)


@query("m6_source_check", oracle(f"""
SELECT source, count(*) AS n, {r9('avg(probability)', 'mean_probability')}, {r9(f'avg(({FLAG})::INT)', 'fpr')}
FROM scored WHERE label = 0 GROUP BY 1""", "scored"))
def m6(spark, sf):
    return metrics.source_check(fx.scored(spark, sf), fx.THRESHOLD)


@query("m7_brier", oracle(f"""
SELECT {r9('avg((probability - label) ** 2)', 'brier')}, {r9('var_pop(label)', 'base_rate_brier')} FROM scored""", "scored"))
def m7(spark, sf):
    return metrics.brier(fx.scored(spark, sf))


BINS = """
  SELECT b::INT AS bin, printf('%.1f-%.1f', b / 10, (b + 1) / 10) AS bin_range, count(probability) AS n,
    avg(probability) AS mean_predicted, avg(label) AS actual_rate, abs(avg(probability) - avg(label)) AS gap
  FROM range(10) t(b) LEFT JOIN scored ON least(floor(probability * 10), 9)::INT = b GROUP BY b"""


@query("m8_reliability_table", oracle(f"""
SELECT bin, bin_range, n, {r9('mean_predicted', 'mean_predicted')}, {r9('actual_rate', 'actual_rate')}, {r9('gap', 'gap')} FROM ({BINS})""", "scored"))
def m8(spark, sf):
    return metrics.reliability_table(fx.scored(spark, sf))


@query("m9_m10_a18_calibration_verdict", oracle(f"""
SELECT {r9('ece', 'ece')}, worst_bin, {r9('worst_gap', 'worst_gap')}, coalesce(ece <= 0.02 AND worst_gap <= 0.1, false) AS calibrated FROM (
  SELECT sum(n * gap) / sum(n) AS ece, arg_max(bin_range, gap) FILTER (n >= 200) AS worst_bin, max(gap) FILTER (n >= 200) AS worst_gap FROM ({BINS}))""", "scored"))
def m9(spark, sf):
    return metrics.calibration_verdict(metrics.reliability_table(fx.scored(spark, sf)))


@query("a19_score_parity", oracle("""
SELECT count(*) AS n, """ + r9("max(abs(probability - round(probability, 1)))", "max_abs_diff") + """, 0::BIGINT AS unmatched FROM scored""", "scored"))
def a19(spark, sf):
    rows = fx.scored(spark, sf).select("request_id", "probability")
    return metrics.score_parity(rows, rows.withColumn("probability", F.round("probability", 1)), "request_id")
