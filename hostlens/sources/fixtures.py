"""Inputs of the registered queries, derived from the given tables over all of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.functions.features import with_features
from hostlens.functions.hostname import with_hostname, with_registered_domain
from hostlens.functions.urlshape import day_index, md5_uniform
from hostlens.operators.sampling import stratified_holdout
from hostlens.sources.io import spread
from hostlens.sources.scratch import durable, present

THRESHOLD = 0.626
START = "2024-01-01"
PARTS = 20  # requests of a held event

# Curated legitimate hosts with a subdomain, for measuring only.
STRESS_HOSTS = """
mail.google.com drive.google.com docs.google.com maps.google.com accounts.google.com
translate.google.com calendar.google.com docs.github.com gist.github.com api.github.com
raw.githubusercontent.com fr.wikipedia.org en.wikipedia.org de.wikipedia.org es.wikipedia.org
commons.wikimedia.org support.microsoft.com learn.microsoft.com docs.microsoft.com
azure.microsoft.com login.microsoftonline.com outlook.office.com news.bbc.co.uk
developer.mozilla.org support.mozilla.org addons.mozilla.org support.apple.com
developer.apple.com appleid.apple.com aws.amazon.com docs.aws.amazon.com
console.aws.amazon.com help.netflix.com developers.facebook.com business.facebook.com
help.instagram.com developer.android.com source.android.com cloud.google.com
developers.google.com firebase.google.com meta.stackoverflow.com math.stackexchange.com
blog.cloudflare.com developers.cloudflare.com docs.python.org packaging.python.org
docs.docker.com hub.docker.com docs.oracle.com help.ubuntu.com wiki.archlinux.org
bugs.archlinux.org docs.djangoproject.com blog.python.org support.dropbox.com
help.twitter.com support.spotify.com open.spotify.com store.steampowered.com
help.steampowered.com support.zoom.us developer.paypal.com developer.nvidia.com
docs.gitlab.com about.gitlab.com cs.stanford.edu web.mit.edu cs.cmu.edu ocw.mit.edu
news.ycombinator.com old.reddit.com pytorch.github.io microsoft.github.io google.github.io
mozilla.github.io airbnb.github.io netflix.github.io square.github.io facebook.github.io
nodejs.github.io spotify.github.io twitter.github.io
"""

_URL = """
  split_part('https://,http://,HTTPS://www.,,ftp://', ',', CAST(url_id % 5 AS INT) + 1)
  || CASE WHEN url_id % 41 = 0 THEN 'user:pw@' ELSE '' END
  || CASE WHEN url_id % 97 = 0 THEN '192.168.0.' || CAST(cust % 256 AS STRING)
     ELSE split_part(',mail.,login.mail.,,docs.,', ',', CAST(url_id % 6 AS INT) + 1)
     || split_part('paypa1-verify,arnazon-support,chase-login,paypalsecure-verify,paypai-login,purchase-guide,pineapple-recipes,example,xn--bcher-kva,wiki,store,news', ',', CAST(url_id % 12 AS INT) + 1)
     || CASE WHEN url_id % 3 = 0 THEN CAST(cust AS STRING) ELSE '' END || '.'
     || split_part('com,github.io,co.uk,xyz,web.app,net,org,online', ',', CAST(cust % 8 AS INT) + 1) END
  || CASE WHEN url_id % 11 = 0 THEN ':8080' ELSE '' END
  || split_part('/,,/login?x=1#top,?q=1,/a/b/c', ',', CAST(cust % 5 AS INT) + 1) AS url
"""


_stages: dict = {}


def _stage(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """A derived table that is written once per session and read from then on."""
    key = (name, sf_dir, spark.sparkContext.applicationId)
    if key not in _stages or not present(_stages[key]):
        _stages[key] = durable(build())
    return _stages[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url_id, url, label): one URL text per order."""
    orders = spread(table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("url_id"), F.col("o_custkey").alias("cust")
    ))
    label = F.when((F.col("url_id") % 12 < 5) | (F.col("cust") % 17 == 0), 1).otherwise(0)
    return orders.selectExpr("url_id", _URL, "cust").withColumn("label", label).drop("cust")


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, id, url): the order URLs and the page URLs."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url"))
    return (
        urls(spark, sf_dir).select(F.lit("orders").alias("src"), F.col("url_id").alias("id"), "url")
        .unionByName(pages.select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), "url"))
    )


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hostname): distinct hosts of all URLs, the empty one included."""
    return (
        with_hostname(all_urls(spark, sf_dir).select("url")).select("hostname").distinct()
    )


def list_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, raw): popularity list of the URLs labelled legitimate."""
    return urls(spark, sf_dir).where("label = 0").select(
        F.col("url_id").cast("int").alias("rank"), F.col("url").alias("raw")
    )


def list_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rank, domain): registered domains of the URLs with a fixed pseudo-random rank."""
    named = with_hostname(urls(spark, sf_dir).select("url_id", "url"))
    first = named.groupBy("hostname").agg(F.min("url_id").alias("url_id"))
    domains = with_registered_domain(first.where("hostname != ''"))
    return domains.groupBy(F.col("registered_domain").alias("domain")).agg(
        (F.min("url_id") + 1).cast("int").alias("rank")
    ).select("rank", "domain")


def stress(spark: SparkSession) -> DataFrame:
    """(hostname): the curated stress hosts."""
    return spark.createDataFrame([(h,) for h in STRESS_HOSTS.split()], "hostname STRING")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stage("scored", spark, sf_dir, lambda: _scored(spark, sf_dir))


def _honest() -> Column:
    return F.when(F.dayofmonth("timestamp") > 20, 0.5).otherwise(1.0)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored requests with their label and host: one per event.

    The scores are calibrated up to day 20 and over-confident by a factor of 2 after it.
    """
    u = "conv(substr(md5(CAST(event_id AS STRING)), 1, 8), 16, 10) / 4294967296D"
    events = spread(table(spark, sf_dir, "events").drop("props")).selectExpr(
        "CAST(event_id AS STRING) AS request_id", "event_id", "CAST(ts AS TIMESTAMP) AS timestamp", "event_type AS source",
        "value / (value + 50) AS probability", f"{u} AS u",
    )
    events = events.withColumn(
        "label", F.when(F.col("u") < F.col("probability") * _honest(), 1).otherwise(0)
    ).withColumn("day", day_index(F.col("timestamp"), START))
    named = with_hostname(urls(spark, sf_dir).select("url_id", "url"))
    return events.drop("u").join(named, F.col("event_id") == F.col("url_id")).select(
        "request_id", "timestamp", "day", "hostname", "source", "probability", "label"
    )


def scored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`scored` with the 22 features, and `is_reference` for a 20% holdout per label.

    Each held event stands for PARTS requests with labels of their own, so that the reference has
    several days' worth of rows on the smallest tables too. They share the host and so its features.
    """

    def build():
        rows = with_features(stratified_holdout(scored(spark, sf_dir), "label", "request_id"))
        parts = rows.where("is_reference").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        parts = parts.withColumn("request_id", F.concat_ws("-", "request_id", "part")).drop("part")
        hit = md5_uniform(F.col("request_id")) < F.col("probability") * _honest()
        parts = parts.withColumn("label", F.when(hit, 1).otherwise(0))
        return rows.where("NOT is_reference").unionByName(parts)

    return _stage("scored_features", spark, sf_dir, build)


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows with the decision taken at THRESHOLD."""
    from hostlens.functions.decision import decision

    feats = with_features(scored(spark, sf_dir))
    return feats.select(
        "request_id", "timestamp", "hostname", "probability",
        decision(F.col("probability"), F.col("is_free_hosting"), THRESHOLD).alias("decision"),
        F.lit("1").alias("model_version"),
    )


def delayed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("request_id", "day", "label")
