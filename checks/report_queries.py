"""Exploration reports and feature audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlparts import LONG, oracle, r9
from hostlens.functions import urlshape as shape
from hostlens.functions.features import with_features
from hostlens.functions.hostname import with_hostname, with_registered_domain
from hostlens.operators import prefix, profile
from hostlens.sources import fixtures as fx

from checks.host_queries import HOMEPAGE, SCHEME, WWW

CLS = "CASE label WHEN 1 THEN 'phishing' WHEN 0 THEN 'legitimate' END AS cls"
CLASSES = ("phishing", "legitimate")


def _urls(spark, sf):
    return fx.urls(spark, sf).withColumn("cls", shape.class_name(F.col("label")))


def _domains(spark, sf):
    named = with_hostname(_urls(spark, sf)).select("url_id", "hostname", "label", "cls")
    return with_registered_domain(named)


def _feats(spark, sf):
    """Features of the labelled URLs, with the class."""
    named = with_hostname(_urls(spark, sf)).select("url_id", "hostname", "label", "cls")
    return with_features(named)


DOMAINS = f"(SELECT *, {CLS} FROM unamed JOIN parts USING (hostname))"
FEATS = f"(SELECT *, {CLS} FROM unamed JOIN feats USING (hostname))"


@query("a1_class_balance", oracle(f"""
SELECT cls, count(*) AS n, {r9('count(*) * 100.0 / sum(count(*)) OVER ()', 'percent')}
FROM (SELECT {CLS} FROM urls) GROUP BY 1""", "urls"))
def a1(spark, sf):
    return profile.value_shares(_urls(spark, sf), "cls")


@query("a2_duplicates_per_class", oracle(f"""
SELECT cls, sum((rn > 1)::INT)::BIGINT AS n_duplicates FROM (
  SELECT {CLS}, row_number() OVER (PARTITION BY url ORDER BY url_id) AS rn FROM urls) GROUP BY 1""", "urls"))
def a2(spark, sf):
    return profile.duplicate_counts(_urls(spark, sf), "url", "cls", "url_id")


@query("a2_duplicates_overall", oracle("SELECT count(*) - count(DISTINCT url) AS n_duplicates FROM urls", "urls"))
def a2b(spark, sf):
    per_url = fx.urls(spark, sf).groupBy("url").agg(F.count("*").alias("n"))
    return per_url.agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


@query("a3_conflict_count", oracle("""
SELECT count(*) AS n_conflicting FROM (SELECT url FROM urls GROUP BY 1 HAVING count(DISTINCT label) > 1)""", "urls"))
def a3(spark, sf):
    return profile.conflict_count(fx.urls(spark, sf), "url")


@query("a4_flag_shares", oracle(f"""
SELECT cls, count(*) AS n, {r9(f'avg(({HOMEPAGE})::INT) * 100', 'pct_homepage')},
  {r9("avg(starts_with(lower(url), 'https://')::INT) * 100", 'pct_https')}, {r9(f'avg(({WWW})::INT) * 100', 'pct_www')},
  {r9("avg(ends_with(url, '/')::INT) * 100", 'pct_slash')}, {r9("avg(regexp_matches(url, '[0-9]')::INT) * 100", 'pct_digits')},
  {r9("avg(contains(url, '-')::INT) * 100", 'pct_hyphens')}
FROM (SELECT *, {CLS} FROM urls) GROUP BY 1""", "urls"))
def a4(spark, sf):
    url = F.col("url")
    flags = {
        "pct_homepage": shape.is_homepage(url), "pct_https": shape.is_https(url),
        "pct_www": shape.starts_with_www(url), "pct_slash": url.endswith("/"),
        "pct_digits": url.rlike("[0-9]"), "pct_hyphens": url.contains("-"),
    }
    return profile.flag_shares(_urls(spark, sf), "cls", flags)


@query("a4_structure_shares", oracle(f"""
SELECT cls, count(*) AS n, {r9('avg((num_subdomain_levels >= 1)::INT) * 100', 'pct_subdomain')},
  {r9('avg(is_free_hosting) * 100', 'pct_free_hosting')} FROM {FEATS} GROUP BY 1""", "unamed", "feats"))
def a4b(spark, sf):
    flags = {
        "pct_subdomain": F.col("num_subdomain_levels") >= 1,
        "pct_free_hosting": F.col("is_free_hosting") == 1,
    }
    return profile.flag_shares(_feats(spark, sf), "cls", flags)


@query("a5_crosstab_scheme", oracle(f"""
SELECT cls, scheme, count(*) AS n FROM (SELECT {CLS}, coalesce({SCHEME}, 'none') AS scheme FROM urls) GROUP BY ALL""", "urls"))
def a5(spark, sf):
    df = _urls(spark, sf).withColumn("scheme", shape.scheme(F.col("url")))
    return profile.crosstab(df, "cls", "scheme", "none")


@query("a6_crosstab_levels_by_column", oracle(f"""
SELECT levels, {r9("count(*) FILTER (cls = 'phishing') * 100.0 / sum(count(*) FILTER (cls = 'phishing')) OVER ()", 'phishing')},
  {r9("count(*) FILTER (cls = 'legitimate') * 100.0 / sum(count(*) FILTER (cls = 'legitimate')) OVER ()", 'legitimate')}
FROM (SELECT least(num_subdomain_levels, 4)::INT AS levels, cls FROM {FEATS}) GROUP BY 1""", "unamed", "feats"))
def a6(spark, sf):
    df = _feats(spark, sf).withColumn("levels", F.least("num_subdomain_levels", F.lit(4)))
    return profile.crosstab_shares(df, "levels", "cls", list(CLASSES))


@query("a7_distinct_domains", oracle(f"""
SELECT coalesce(cls, 'all') AS cls, count(DISTINCT registered_domain) AS n_distinct
FROM {DOMAINS} GROUP BY ROLLUP (cls)""", "unamed", "parts"))
def a7(spark, sf):
    df = profile.distinct_per_class(_domains(spark, sf), "registered_domain", "cls")
    return df.withColumn("cls", F.coalesce("cls", F.lit("all")))


@query("a7_domains_in_both_classes", oracle(f"""
SELECT count(*) AS n_shared FROM (SELECT registered_domain FROM {DOMAINS} GROUP BY 1 HAVING count(DISTINCT cls) > 1)""", "unamed", "parts"))
def a7b(spark, sf):
    return profile.keys_in_all_classes(_domains(spark, sf), "registered_domain", "cls")


@query("a8_top_domains_per_class", oracle(f"""
SELECT cls, rn, registered_domain, n, {r9('percent', 'percent')},
  {r9('sum(percent) OVER (PARTITION BY cls ORDER BY rn)', 'cum_percent')} FROM (
    SELECT cls, registered_domain, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY cls) AS percent,
      row_number() OVER (PARTITION BY cls ORDER BY count(*) DESC, registered_domain)::INT AS rn
    FROM {DOMAINS} GROUP BY 1, 2) WHERE rn <= 20""", "unamed", "parts"))
def a8(spark, sf):
    return profile.top_per_class(_domains(spark, sf), "registered_domain", "cls")


def _describe_sql(value: str) -> str:
    return ", ".join([
        f'count({value}) AS "count"', r9(f"avg({value})", "mean"), r9(f"stddev_samp({value})", "std"),
        r9(f"min({value})", '"min"'), r9(f"quantile_cont({value}, 0.25)", "p25"),
        r9(f"quantile_cont({value}, 0.5)", "p50"), r9(f"quantile_cont({value}, 0.75)", "p75"),
        r9(f"max({value})", '"max"'),
    ])


@query("a9_describe_url_length", oracle(f"""
SELECT cls, {_describe_sql('v')} FROM (SELECT {CLS}, length(url)::DOUBLE AS v FROM urls) GROUP BY 1""", "urls"))
def a9(spark, sf):
    return profile.describe(_urls(spark, sf).withColumn("v", F.length("url")), "v", ("cls",))


@query("a9_describe_features", oracle(f"""
SELECT feature, {_describe_sql('value')} FROM ({LONG.format(by='url_id', src=FEATS)}) GROUP BY 1""", "unamed", "feats"))
def a9b(spark, sf):
    return profile.describe_features(_feats(spark, sf))


@query("a10_length_histogram", oracle(f"""
SELECT cls, (least(floor(least(length(url), 300) / 5), 59) * 5)::INT AS bin_start, count(*) AS n
FROM (SELECT *, {CLS} FROM urls) GROUP BY 1, 2""", "urls"))
def a10(spark, sf):
    return profile.histogram(_urls(spark, sf).withColumn("v", F.length("url")), "v", "cls")


@query("a11_feature_means", oracle(f"""
SELECT feature, {r9("avg(value) FILTER (cls = 'phishing')", 'phishing')}, {r9("avg(value) FILTER (cls = 'legitimate')", 'legitimate')},
  {r9("avg(value) FILTER (cls = 'phishing') / nullif(avg(value) FILTER (cls = 'legitimate'), 0)", 'ratio')}
FROM ({LONG.format(by='url_id, cls', src=FEATS)}) GROUP BY 1""", "unamed", "feats"))
def a11(spark, sf):
    return profile.feature_means(_feats(spark, sf), "cls", CLASSES)


@query("a15_quantile_higher", oracle(f"""
SELECT label, {r9("list_sort(list(probability))[ceil((count(*) - 1) * 0.99)::BIGINT + 1]", 'quantile')}
FROM scored GROUP BY label""", "scored"))
def a15(spark, sf):
    return prefix.quantile_higher(fx.scored(spark, sf), "probability", 0.99, ("label",))


@query("a20_prefix_sums", oracle(f"""
SELECT {r9('probability', 'probability')}, n, pos, (sum(n) OVER w)::BIGINT AS cum_n, (sum(pos) OVER w)::BIGINT AS cum_pos,
  (sum(n) OVER ())::BIGINT AS all_n, (sum(pos) OVER ())::BIGINT AS all_pos
FROM (SELECT probability, count(*) AS n, sum(label)::BIGINT AS pos FROM scored GROUP BY 1)
WINDOW w AS (ORDER BY probability)""", "scored"))
def a20(spark, sf):
    sums = {"n": F.lit(1), "pos": F.col("label").cast("bigint")}
    return prefix.prefix_sums(fx.scored(spark, sf), "probability", sums)
