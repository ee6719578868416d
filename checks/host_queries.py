"""Sources, sinks, and the functions on URLs and hostnames."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.sqlparts import FEATURE_SQL, feature_list, oracle, r9
from hostlens.functions import decision as dec
from hostlens.functions import urlshape as shape
from hostlens.functions.features import with_features
from hostlens.functions.hostname import (
    has_subdomain, is_ip, is_valid_request, reject_reason, with_host_parts, with_hostname,
)
from hostlens.functions.lists import FEATURES
from hostlens.sources import fixtures as fx
from hostlens.sources import io
from hostlens.sources.scratch import scratch_path

T = "0.626::DOUBLE"


# --------------------------------------------------------------------------- IO
@query("io1_csv_with_header", oracle("SELECT url, label, count(*) AS n FROM urls GROUP BY ALL", "urls"))
def io1(spark, sf):
    path = scratch_path(spark, "csv")
    io.write_csv(fx.urls(spark, sf).select("url", "label"), path)
    return io.read_csv(spark, path, io.RAW_URLS).groupBy("url", "label").agg(F.count("*").alias("n"))


@query("io2_headerless_ranks", oracle("SELECT url_id::INT AS rank, url AS raw FROM urls WHERE label = 0", "urls"))
def io2(spark, sf):
    path = scratch_path(spark, "ranks")
    fx.list_a(spark, sf).write.csv(path, header=False, escape='"')
    return io.read_ranked(spark, path)


@query("io3_top_n_by_rank", oracle("SELECT rank, domain FROM list_b WHERE rank <= 1000", "list_b"))
def io3(spark, sf):
    path = scratch_path(spark, "domains")
    fx.list_b(spark, sf).write.csv(path, header=False, escape='"')
    return io.read_ranked(spark, path, io.RANKED_DOMAIN, top_n=1000)


LOG_SQL = f"""
SELECT request_id, timestamp, hostname, {r9('probability', 'probability')},
  CASE WHEN probability < {T} THEN 'safe' WHEN is_free_hosting = 1 THEN 'review' ELSE 'phishing' END AS decision,
  '1' AS model_version FROM hf"""


@query("io4_io6_prediction_log", oracle(LOG_SQL, "hf"))
def io4(spark, sf):
    path = scratch_path(spark, "log")
    # A URL column is dropped by the sink.
    io.append_prediction_log(fx.prediction_log(spark, sf).withColumn("url", F.lit("secret")), path)
    return io.read_prediction_log(spark, path)


@query("io5_csv_sink_labels", oracle("SELECT request_id, day, label FROM scored", "scored"))
def io5(spark, sf):
    path = scratch_path(spark, "labels")
    io.write_csv(fx.delayed_labels(spark, sf), path)
    return io.read_csv(spark, path, io.DELAYED_LABELS)


@query("io7_ingest_label_flip", oracle("SELECT url, (1 - label)::INT AS label, count(*) AS n FROM urls GROUP BY ALL", "urls"))
def io7(spark, sf):
    raw = fx.urls(spark, sf).select(F.col("url").alias("URL"), "label")
    return io.ingest_raw(raw).groupBy("url", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------- hosts
@query("p1_url_to_hostname", oracle("SELECT src, id, hostname FROM named", "named"))
def p1(spark, sf):
    return with_hostname(fx.all_urls(spark, sf)).select("src", "id", "hostname")


@query("p2_valid_request", oracle("""
SELECT src, id, coalesce(reject_reason, 'ok') AS reject_reason, reject_reason IS NULL AS is_valid FROM (
  SELECT src, id, CASE WHEN length(url) < 1 THEN 'empty url' WHEN length(url) > 2048 THEN 'url too long'
    WHEN hostname = '' THEN 'no hostname' WHEN length(hostname) > 253 THEN 'hostname too long'
    WHEN regexp_matches(hostname, '[\\s\\x00-\\x1f]') THEN 'space or control character' END AS reject_reason
  FROM named)""", "named"))
def p2(spark, sf):
    df, url, host = with_hostname(fx.all_urls(spark, sf)), F.col("url"), F.col("hostname")
    return df.select(
        "src", "id", F.coalesce(reject_reason(url, host), F.lit("ok")).alias("reject_reason"),
        is_valid_request(url, host).alias("is_valid"),
    )


@query("p3_is_ip", oracle("SELECT hostname, is_ip FROM parts JOIN url_hosts USING (hostname)", "parts", "url_hosts"))
def p3(spark, sf):
    return fx.hosts(spark, sf).select("hostname", is_ip(F.col("hostname")).alias("is_ip"))


@query("p4_split_suffix", oracle("""SELECT hostname, subdomain, domain_label, suffix
FROM parts JOIN url_hosts USING (hostname)""", "parts", "url_hosts"))
def p4(spark, sf):
    return with_host_parts(fx.hosts(spark, sf)).select("hostname", "subdomain", "domain_label", "suffix")


@query("p5_p6_p7_registered_domain_and_name", oracle("""
SELECT hostname, registered_domain, registered_domain <> hostname AS has_subdomain, effective_name
FROM parts JOIN url_hosts USING (hostname)""", "parts", "url_hosts"))
def p5(spark, sf):
    sub = has_subdomain(F.col("hostname"), F.col("registered_domain"))
    return with_host_parts(fx.hosts(spark, sf)).select(
        "hostname", "registered_domain", sub.alias("has_subdomain"), "effective_name"
    )


def _feature_query(name: str, features: tuple[str, ...]) -> None:
    cols = ", ".join(r9(f, f) if "ratio" in f or "entropy" in f else f for f in features)
    sql = oracle(f"SELECT hostname, {cols} FROM feats JOIN url_hosts USING (hostname)", "feats", "url_hosts")

    @query(name, sql)
    def run(spark, sf):
        return with_features(fx.hosts(spark, sf)).select("hostname", *features)


_feature_query("p8_p10_lengths_and_labels", ("hostname_length", "num_labels", "num_subdomain_levels"))
_feature_query("p11_p13_digits_hyphens_labels", ("num_digits", "digit_ratio", "num_hyphens", "longest_label_length"))
_feature_query("p14_p15_entropy_vowels", ("domain_entropy", "vowel_ratio", "name_entropy"))
_feature_query("p16_p17_punycode_brand", ("is_punycode", "brand_impersonation"))
_feature_query("p18_p20_keywords_hosting_tld", ("suspicious_keyword_count", "is_free_hosting", "tld_risky"))
_feature_query("p21_name_features", ("name_length", "name_entropy", "name_digit_ratio", "name_num_hyphens", "name_keyword_count"))
_feature_query("p22_p24_lookalike_homoglyph", ("name_brand_lookalike", "name_homoglyph_brand"))
_feature_query("p25_all_features", FEATURES)


@query("p23_homoglyph_unfold", oracle("""
SELECT effective_name, translate(replace(replace(effective_name, 'rn', 'm'), 'vv', 'w'), '0135', 'oles') AS unfolded
FROM (SELECT DISTINCT effective_name FROM parts JOIN url_hosts USING (hostname))""", "parts", "url_hosts"))
def p23(spark, sf):
    from hostlens.functions.features import unfold_homoglyphs

    names = with_host_parts(fx.hosts(spark, sf)).select("effective_name").distinct()
    return names.select("effective_name", F.expr(unfold_homoglyphs("effective_name")).alias("unfolded"))


@query("p26_decision", oracle(f"""
SELECT request_id, CASE WHEN probability < {T} THEN 'safe' WHEN is_free_hosting = 1 THEN 'review' ELSE 'phishing' END AS decision
FROM hf""", "hf"))
def p26(spark, sf):
    feats = with_features(fx.scored(spark, sf))
    return feats.select(
        "request_id", dec.decision(F.col("probability"), F.col("is_free_hosting"), fx.THRESHOLD).alias("decision")
    )


@query("p27_signals", oracle("""
SELECT hostname, concat_ws(', ', CASE WHEN is_free_hosting > 0 THEN 'free hosting' END,
  CASE WHEN tld_risky > 0 THEN 'risky TLD' END, CASE WHEN brand_impersonation > 0 THEN 'brand impersonation' END,
  CASE WHEN name_brand_lookalike > 0 THEN 'brand lookalike' END, CASE WHEN name_homoglyph_brand > 0 THEN 'brand homoglyph' END,
  CASE WHEN suspicious_keyword_count > 0 THEN 'suspicious keywords' END, CASE WHEN is_ip > 0 THEN 'IP address' END,
  CASE WHEN is_punycode > 0 THEN 'punycode' END) AS signals
FROM feats JOIN url_hosts USING (hostname)""", "feats", "url_hosts"))
def p27(spark, sf):
    return with_features(fx.hosts(spark, sf)).select("hostname", dec.signals().alias("signals"))


@query("p28_rounded_probability", oracle("SELECT request_id, round(probability, 4) AS p4 FROM scored", "scored"))
def p28(spark, sf):
    return fx.scored(spark, sf).select("request_id", dec.rounded(F.col("probability")).alias("p4"))


CLEAN_LOOKING = (
    "num_subdomain_levels = 0 AND num_digits = 0 AND num_hyphens = 0 AND tld_risky = 0 "
    "AND is_free_hosting = 0 AND is_ip = 0"
)


@query("p29_p30_clean_looking_filter", oracle(f"""
SELECT hostname FROM feats JOIN url_hosts USING (hostname) WHERE hostname <> '' AND {CLEAN_LOOKING}""", "feats", "url_hosts"))
def p29(spark, sf):
    from hostlens.functions.features import clean_looking

    return with_features(fx.hosts(spark, sf).where("hostname != ''")).where(clean_looking()).select("hostname")


HOMEPAGE = "regexp_full_match(url, '([a-zA-Z][a-zA-Z0-9+.\\-]*:)?(//[^/?#]*)?/?[?]?#?')"
SCHEME = "lower(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1), ''))"
WWW = "starts_with(lower(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://', '')), 'www.')"


@query("p31_url_shape", oracle(f"""
SELECT src, id, {HOMEPAGE} AS homepage, starts_with(lower(url), 'https://') AS https, {SCHEME} AS scheme,
  {WWW} AS www, ends_with(url, '/') AS slash, regexp_matches(url, '[0-9]') AS digits, contains(url, '-') AS hyphens,
  length(url)::INT AS length FROM all_urls""", "all_urls"))
def p31(spark, sf):
    url = F.col("url")
    return fx.all_urls(spark, sf).select(
        "src", "id", shape.is_homepage(url).alias("homepage"), shape.is_https(url).alias("https"),
        shape.scheme(url).alias("scheme"), shape.starts_with_www(url).alias("www"),
        url.endswith("/").alias("slash"), url.rlike("[0-9]").alias("digits"),
        url.contains("-").alias("hyphens"), F.length(url).alias("length"),
    )


@query("p32_class_name", oracle("""
SELECT CASE label WHEN 1 THEN 'phishing' WHEN 0 THEN 'legitimate' END AS cls, count(*) AS n FROM urls GROUP BY 1""", "urls"))
def p32(spark, sf):
    return fx.urls(spark, sf).groupBy(shape.class_name(F.col("label")).alias("cls")).agg(F.count("*").alias("n"))


@query("p33_j10_day_scenario", oracle("""
SELECT request_id, day, scenario FROM scored LEFT JOIN scenarios ON day BETWEEN lo AND hi""", "scored", "scenarios"))
def p33(spark, sf):
    from hostlens.plans.monitoring import scenario_of

    return fx.scored(spark, sf).select("request_id", "day", scenario_of(F.col("day")).alias("scenario"))


@query("p34_p35_bin_and_clip", oracle("""
SELECT request_id, least(floor(probability * 10), 9)::INT AS bin, least(length(hostname), 12)::INT AS clipped,
  """ + r9("greatest(probability, 0.05::DOUBLE)", "floored") + " FROM scored", "scored"))
def p34(spark, sf):
    p = F.col("probability")
    return fx.scored(spark, sf).select(
        "request_id", shape.equal_width_bin(p).alias("bin"),
        F.least(F.length("hostname"), F.lit(12)).alias("clipped"),
        F.greatest(p, F.lit(0.05)).alias("floored"),
    )


@query("p36_day_index", oracle("SELECT request_id, timestamp, day FROM scored", "scored"))
def p36(spark, sf):
    return fx.scored(spark, sf).select("request_id", "timestamp", shape.day_index(F.col("timestamp"), fx.START).alias("day"))


@query("p37_request_id", oracle("SELECT url_id, md5(url_id || '|' || url) AS request_id FROM urls", "urls"))
def p37(spark, sf):
    return fx.urls(spark, sf).select("url_id", dec.request_id("url_id", "url").alias("request_id"))


@query("p38_ratio_missing_for_zero", oracle("""
SELECT hostname, """ + r9("num_digits / nullif(num_hyphens, 0)", "ratio") + """
FROM feats JOIN url_hosts USING (hostname)""", "feats", "url_hosts"))
def p38(spark, sf):
    return with_features(fx.hosts(spark, sf)).select(
        "hostname", shape.safe_ratio(F.col("num_digits"), F.col("num_hyphens").cast("double")).alias("ratio")
    )
