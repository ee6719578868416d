"""URL text to hostname, and the parts of a hostname. URLs are only ever handled as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.functions.lists import FREE_HOSTING_DOMAINS
from hostlens.functions.stage import computed_once
from hostlens.functions.suffix import SuffixRules, SuffixTable, default_rules, with_suffix_labels

MAX_URL_LENGTH = 2048
MAX_HOST_LENGTH = 253

_SPACE = r"[\s\x1c-\x1f]"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(\.{_OCTET}){{3}}"
_HEX = r"[0-9a-fA-F]{1,4}"

PARTS = ("is_ip", "suffix", "domain_label", "subdomain", "registered_domain", "effective_name")


def url_to_hostname(url: Column) -> Column:
    """Lowercased host of a URL text; '' when there is none (also for NULL).

    One pattern walks scheme, credentials and host (a bracketed host ends at `]`, any other
    at `:`); a leading `www.` and all trailing dots go last.
    """
    text = F.regexp_replace(F.coalesce(url, F.lit("")), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")
    host = F.lower(
        F.regexp_replace(
            text,
            r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.\-]*://)?(?:[^/?#]*@)?"
            r"(?:\[+([^\]/?#]*)|([^:/?#]*)).*$",
            "$1$2",
        )
    )
    bare = F.when(host.startswith("www."), F.substring(host, 5, 2**31 - 1)).otherwise(host)
    return F.rtrim(bare, F.lit("."))


def reject_reason(url: Column, host: Column) -> Column:
    """Why a scoring request is refused; NULL when it is fine."""
    return (
        F.when(url.isNull() | (F.length(url) < 1), "empty url")
        .when(F.length(url) > MAX_URL_LENGTH, "url too long")
        .when(host == "", "no hostname")
        .when(F.length(host) > MAX_HOST_LENGTH, "hostname too long")
        .when(host.rlike(r"(?U)[\s\x00-\x1f]"), "space or control character")
    )


def is_valid_request(url: Column, host: Column) -> Column:
    return reject_reason(url, host).isNull()


def is_ip(host: Column) -> Column:
    """IPv4 (four octets, no leading zeros) or IPv6 text, also with a v4 tail or a zone."""
    # Without its zone and with a v4 tail written as two groups, v6 text is hex groups only.
    plain = F.regexp_replace(
        F.regexp_replace(host, r"^([^%]*)%[^%]+$", "$1"), rf"(?<=:){_IPV4}$", "0:0"
    )
    groups = F.regexp_count(plain, F.lit(_HEX))
    full = plain.rlike(rf"^({_HEX}:){{7}}{_HEX}$")
    short = plain.rlike(rf"^({_HEX}(:{_HEX})*)?::({_HEX}(:{_HEX})*)?$") & (groups <= 7)
    return F.when(host.contains(":"), full | short).otherwise(host.rlike(rf"^{_IPV4}$"))


def with_hostname(df: DataFrame, url: str = "url", host: str = "hostname") -> DataFrame:
    """Add the hostname of a URL column."""
    return computed_once(df, {host: url_to_hostname(F.col(url))})


def with_host_parts(
    df: DataFrame, host: str = "hostname", rules: SuffixRules | SuffixTable | None = None,
    free_hosting: tuple[str, ...] = FREE_HOSTING_DOMAINS,
) -> DataFrame:
    """Add PARTS, computed once per row."""
    rules = rules or default_rules()
    h, keep = F.col(host), [c for c in df.columns if c not in PARTS]
    df = df.select(*keep).withColumn("is_ip", is_ip(h))
    df = with_suffix_labels(df, host, rules, "_k").withColumn("_k", F.when(F.col("is_ip"), 0).otherwise(F.col("_k")))
    df = df.withColumn("suffix", F.call_function("substring_index", h, F.lit("."), -F.col("_k")))
    # All left of the suffix; the whole host when there is none.
    left = F.substring(h, F.lit(1), F.length(h) - F.length("suffix") - 1)
    df = df.withColumn("_left", F.when(F.col("_k") == 0, h).otherwise(left))
    df = df.withColumn(
        "domain_label", F.when(F.col("is_ip"), h).otherwise(F.substring_index("_left", ".", -1))
    )
    sub = F.substring("_left", F.lit(1), F.length("_left") - F.length("domain_label") - 1)
    df = df.withColumn("subdomain", F.when(F.col("is_ip"), "").otherwise(sub))
    registered = F.when(
        (F.col("suffix") != "") & (F.col("domain_label") != ""),
        F.concat_ws(".", "domain_label", "suffix"),
    ).otherwise(h)
    df = df.withColumn("registered_domain", registered)
    df = df.withColumn("effective_name", effective_name(free_hosting))
    return computed_once(df.drop("_k", "_left"), {part: F.col(part) for part in PARTS})


def effective_name(free_hosting: tuple[str, ...] = FREE_HOSTING_DOMAINS) -> Column:
    """The label a site owner chose: left of a free-hosting domain, else the domain label."""
    hosted = F.col("registered_domain").isin(*free_hosting) & (F.col("subdomain") != "")
    return (
        F.when(F.col("is_ip"), "")
        .when(hosted, F.substring_index("subdomain", ".", -1))
        .otherwise(F.col("domain_label"))
    )


def with_registered_domain(
    df: DataFrame, host: str = "hostname", rules: SuffixRules | SuffixTable | None = None
) -> DataFrame:
    """Add only `registered_domain`: the host itself for an IP or an unknown suffix."""
    keep = [c for c in df.columns if c != "registered_domain"]
    return with_host_parts(df.select(*keep), host, rules).select(*keep, "registered_domain")


def has_subdomain(host: Column, registered: Column) -> Column:
    return registered != host
