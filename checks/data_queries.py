"""Deduplication, joins, sampling, splits and the dataset build."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlparts import oracle, r9, word
from hostlens.functions.features import with_features
from hostlens.functions.hostname import with_hostname, with_registered_domain
from hostlens.operators import dedup, sampling
from hostlens.operators.folds import grouped_folds
from hostlens.plans import dataset as ds
from hostlens.plans import monitoring as mon
from hostlens.sources import fixtures as fx
from hostlens.sources import io
from hostlens.sources.scratch import scratch_path

TOP_N = 1000  # ranks of the derived popularity list go up to the number of orders


def _clean(spark, sf):
    hosts = ds.clean_hosts(ds.host_summary(fx.urls(spark, sf)))
    return with_registered_domain(hosts)


def _benign(spark, sf, clean):
    phish = clean.where("label = 1")
    by = ds.BenignFilter.of(fx.list_b(spark, sf), fx.stress(spark), phish, TOP_N)
    return ds.benign_hosts(ds.tagged_hosts(fx.list_a(spark, sf), by), by)


def _merged(spark, sf):
    clean = _clean(spark, sf)
    return ds.merge_sources(clean, _benign(spark, sf, clean))


def dataset(spark, sf):
    return ds.build_dataset(
        fx.urls(spark, sf), fx.list_a(spark, sf), fx.list_b(spark, sf), fx.stress(spark), top_n=TOP_N
    )


# ------------------------------------------------------------------------ joins
@query("j1_labels_left_join", oracle("""
SELECT request_id, day, label FROM scored""", "scored"))
def j1(spark, sf):
    log, labels = fx.prediction_log(spark, sf), fx.delayed_labels(spark, sf)
    return mon.join_labels(log, labels, fx.START).select("request_id", "day", "label")


@query("j2_label_coverage", oracle("""
SELECT count(*) AS n_requests, count(*) FILTER (day > 20) AS n_unlabelled FROM scored""", "scored"))
def j2(spark, sf):
    return mon.label_coverage(fx.scored(spark, sf), fx.delayed_labels(spark, sf).where("day <= 20"))


@query("j3_semi_join_top_domains", oracle("""
SELECT hostname, registered_domain FROM ranked JOIN parts USING (hostname)
WHERE registered_domain IN (FROM top)""", "ranked", "parts", "top"))
def j3(spark, sf):
    hosts = with_registered_domain(ds.ranked_hosts(fx.list_a(spark, sf)).select("hostname"))
    return hosts.join(ds.top_domains(fx.list_b(spark, sf), TOP_N), "registered_domain", "left_semi").select("hostname", "registered_domain")


@query("j4_anti_join_phishing_hosts", oracle("""
SELECT hostname FROM ranked WHERE hostname NOT IN (FROM phish)""", "ranked", "phish"))
def j4(spark, sf):
    phish = ds.clean_hosts(ds.host_summary(fx.urls(spark, sf))).where("label = 1")
    return ds.ranked_hosts(fx.list_a(spark, sf)).select("hostname").join(phish, "hostname", "left_anti")


@query("j5_anti_join_stress_domains", oracle("""
SELECT hostname FROM ranked JOIN parts USING (hostname) WHERE registered_domain NOT IN (FROM stress_domains)""",
    "ranked", "parts", "stress_domains"))
def j5(spark, sf):
    hosts = with_registered_domain(ds.ranked_hosts(fx.list_a(spark, sf)).select("hostname"))
    return hosts.join(ds.stress_domains(fx.stress(spark)), "registered_domain", "left_anti").select("hostname")


@query("j6_anti_join_conflicting_hosts", oracle("""
SELECT url_id, hostname, label FROM unamed WHERE hostname NOT IN (
  SELECT hostname FROM unamed GROUP BY 1 HAVING count(DISTINCT label) > 1)""", "unamed"))
def j6(spark, sf):
    named = with_hostname(fx.urls(spark, sf)).select("url_id", "hostname", "label")
    return dedup.drop_conflicts(named, "hostname").select("url_id", "hostname", "label")


@query("j7_split_overlap", oracle("""
SELECT count(*) AS n_shared FROM (SELECT registered_domain FROM dataset GROUP BY 1 HAVING count(DISTINCT split) > 1)""", "dataset"))
def j7(spark, sf):
    return ds.shared_domains(dataset(spark, sf).rows).agg(F.count("*").alias("n_shared"))


@query("j8_attach_features_by_key", oracle("""
SELECT request_id, hostname, num_labels, is_free_hosting FROM held JOIN feats USING (hostname)""", "held", "feats"))
def j8(spark, sf):
    rows = fx.scored(spark, sf).select("request_id", "hostname")
    feats = with_features(rows.select("hostname").distinct())
    return rows.join(feats, "hostname").select("request_id", "hostname", "num_labels", "is_free_hosting")


# ---------------------------------------------------------------- dedupe and split
@query("d1_keep_first_url", oracle("""
SELECT url_id, url, label FROM urls QUALIFY row_number() OVER (PARTITION BY url ORDER BY url_id) = 1""", "urls"))
def d1(spark, sf):
    return dedup.keep_first(fx.urls(spark, sf), ["url"], "url_id")


@query("d1_dedupe_host_label", oracle("SELECT DISTINCT hostname, label FROM unamed WHERE hostname <> ''", "unamed"))
def d1b(spark, sf):
    named = with_hostname(fx.urls(spark, sf)).where("hostname != ''")
    return named.select("hostname", "label").dropDuplicates()


@query("d2_w1_best_rank_per_host", oracle("SELECT hostname, rank FROM ranked", "ranked"))
def d2(spark, sf):
    return ds.ranked_hosts(fx.list_a(spark, sf))


@query("d3_a12_conflicting_hosts", oracle("""
SELECT hostname FROM unamed GROUP BY 1 HAVING count(DISTINCT label) > 1""", "unamed"))
def d3(spark, sf):
    return dedup.conflicting_keys(with_hostname(fx.urls(spark, sf)), "hostname")


@query("d4_union_with_priority", oracle("SELECT hostname, registered_domain, label, source FROM merged", "merged"))
def d4(spark, sf):
    return _merged(spark, sf).rows


@query("d5_w2_cap_per_domain", oracle("""
SELECT hostname, registered_domain, rank FROM ranked JOIN parts USING (hostname)
QUALIFY row_number() OVER (PARTITION BY registered_domain ORDER BY rank, hostname) <= 20""", "ranked", "parts"))
def d5(spark, sf):
    hosts = with_registered_domain(ds.ranked_hosts(fx.list_a(spark, sf)))
    return dedup.cap_per_group(hosts, "registered_domain", ["rank", "hostname"], 20).select(
        "hostname", "registered_domain", "rank"
    )


LEDGER = """
, steps AS (
  SELECT 'clean' AS part, 0 AS step_no, 'raw rows' AS step, (SELECT count(*) FROM unamed) AS remaining
  UNION ALL SELECT 'clean', 1, 'drop exact duplicate URLs', (SELECT count(DISTINCT url) FROM unamed)
  UNION ALL SELECT 'clean', 2, 'drop empty hostnames', (SELECT count(*) FROM by_url WHERE hostname <> '')
  UNION ALL SELECT 'clean', 3, 'dedupe on (hostname, label)', (SELECT count(*) FROM (SELECT DISTINCT hostname, label FROM by_url WHERE hostname <> ''))
  UNION ALL SELECT 'clean', 4, 'drop hostnames with both labels', (SELECT count(*) FROM clean)
  {more})
SELECT part, step_no, step,
  coalesce(lag(remaining) OVER (PARTITION BY part ORDER BY step_no) - remaining, 0) AS removed, remaining FROM steps"""
MORE = """
  UNION ALL SELECT 'benign', 0, 'rows after normalization and dedupe', (SELECT count(*) FROM benign_tag)
  UNION ALL SELECT 'benign', 1, 'drop no valid suffix or no subdomain', (SELECT count(*) FROM benign_tag WHERE gone > 1)
  UNION ALL SELECT 'benign', 2, 'drop registered domain not in top list', (SELECT count(*) FROM benign_tag WHERE gone > 2)
  UNION ALL SELECT 'benign', 3, 'drop hostnames in phishing data', (SELECT count(*) FROM benign_tag WHERE gone > 3)
  UNION ALL SELECT 'benign', 4, 'drop registered domains in stress list', (SELECT count(*) FROM benign_tag WHERE gone > 4)
  UNION ALL SELECT 'benign', 5, 'cap per registered domain', (SELECT count(*) FROM benign)
  UNION ALL SELECT 'merge', 0, 'add benign rows', (SELECT count(*) FROM unioned)
  UNION ALL SELECT 'merge', 1, 'dedupe on (hostname, label) after merge', (SELECT count(*) FROM (SELECT DISTINCT hostname, label FROM unioned))
  UNION ALL SELECT 'merge', 2, 'drop hostnames with both labels after merge', (SELECT count(*) FROM merged)"""


@query("d6_w3_clean_ledger", oracle(LEDGER.format(more=""), "clean"))
def d6(spark, sf):
    return ds.clean_ledger(ds.host_summary(fx.urls(spark, sf)))


@query("d6_full_ledger", oracle(LEDGER.format(more=MORE), "merged", "clean"))
def d6b(spark, sf):
    return dataset(spark, sf).ledger


@query("d7_grouped_folds", oracle("SELECT hostname, fold FROM dataset", "dataset"))
def d7(spark, sf):
    rows = _merged(spark, sf).rows
    return grouped_folds(rows, "registered_domain", "label").select("hostname", "fold")


@query("d8_stratified_holdout", oracle("SELECT request_id, label, is_reference FROM held", "held"))
def d8(spark, sf):
    rows = fx.scored(spark, sf).select("request_id", "label")
    return sampling.stratified_holdout(rows, "label", "request_id")


@query("d9_exact_sample_per_stratum", oracle(f"""
SELECT url_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {word("url_id || '|42'")}, url_id) AS rn
  FROM urls) WHERE rn <= CASE label WHEN 1 THEN 700 ELSE 1300 END""", "urls"))
def d9(spark, sf):
    return sampling.sample_exact(fx.urls(spark, sf).select("url_id", "label"), "label", {1: 700, 0: 1300}, "url_id")


@query("d10_split_report", oracle(f"""
SELECT split, count(*) AS n_rows, sum(label)::BIGINT AS phishing, sum(1 - label)::BIGINT AS legit,
  {r9('avg(label) * 100', 'pct_phishing')}, count(DISTINCT registered_domain) AS domains FROM dataset GROUP BY 1""", "dataset"))
def d10(spark, sf):
    return ds.split_report(dataset(spark, sf).rows)


@query("d10_class_report", oracle(f"""
SELECT label, count(*) AS n_rows, {r9('avg((registered_domain <> hostname)::INT) * 100', 'pct_subdomain')},
  {r9("avg(is_free_hosting) * 100", 'pct_free_hosting')} FROM merged JOIN feats USING (hostname) GROUP BY 1""", "merged", "feats"))
def d10b(spark, sf):
    return ds.class_report(_merged(spark, sf).rows)


@query("d10_source_rollup", oracle("""
SELECT source, label, count(*) AS n_rows FROM merged GROUP BY ROLLUP (source, label)""", "merged"))
def d10c(spark, sf):
    return ds.source_report(_merged(spark, sf).rows)


@query("d11_benign_list", oracle("SELECT hostname, registered_domain FROM benign", "benign"))
def d11(spark, sf):
    return _benign(spark, sf, _clean(spark, sf))


@query("d12_dataset_build", oracle("SELECT hostname, registered_domain, label, source, fold, split FROM dataset", "dataset"))
def d12(spark, sf):
    path = scratch_path(spark, "dataset")
    rows = dataset(spark, sf).rows
    io.write_split(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("w6_first_rows_by_id", oracle("SELECT url_id, url FROM urls ORDER BY url_id LIMIT 1000", "urls"))
def w6(spark, sf):
    return fx.urls(spark, sf).select("url_id", "url").orderBy("url_id").limit(1000)
