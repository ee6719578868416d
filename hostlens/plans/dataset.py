"""Labelled, source-merged, domain-grouped host dataset from raw URLs and rank lists."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.hostname import (
    has_subdomain, with_host_parts, with_hostname, with_registered_domain,
)
from hostlens.functions.lists import FREE_HOSTING_DOMAINS
from hostlens.functions.suffix import SuffixRules, SuffixTable
from hostlens.operators.dedup import cap_per_group
from hostlens.operators.folds import grouped_folds
from hostlens.sources.scratch import broadcast_if_small, durable

# Names of the two sources, list and cap sizes, folds and seed.
PRIMARY_SOURCE = "phiusiil"
BENIGN_SOURCE = "umbrella"
TOP_N = 100_000
MAX_PER_DOMAIN = 20
FOLDS = 5
SEED = 42

CLEAN_STEPS = (
    "raw rows", "drop exact duplicate URLs", "drop empty hostnames",
    "dedupe on (hostname, label)", "drop hostnames with both labels",
)
BENIGN_STEPS = (
    "rows after normalization and dedupe", "drop no valid suffix or no subdomain",
    "drop registered domain not in top list", "drop hostnames in phishing data",
    "drop registered domains in stress list", "cap per registered domain",
)
MERGE_STEPS = (
    "add benign rows", "dedupe on (hostname, label) after merge",
    "drop hostnames with both labels after merge",
)


def host_summary(raw: DataFrame, order: str = "url_id") -> DataFrame:
    """Per hostname: raw rows, distinct URLs, lowest and highest label.

    Two aggregates in a row: by URL (the first copy's label counts), then by host. Both combine
    on the map side, so a URL or a host with a third of all rows is no hot task, and all that
    the cleaning steps and their ledger need is kept in the counts.
    """
    by_url = raw.groupBy("url").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("label", order).alias("label")
    )
    return (
        with_hostname(by_url)
        .groupBy("hostname")
        .agg(
            F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("urls"),
            F.min("label").alias("min_label"), F.max("label").alias("max_label"),
        )
    )


def clean_hosts(summary: DataFrame) -> DataFrame:
    """(hostname, label): non-empty hosts that carry one label only."""
    one_label = F.col("min_label") == F.col("max_label")
    return summary.where((F.col("hostname") != "") & one_label).select(
        "hostname", F.col("min_label").alias("label")
    )


def _ledger(counts: DataFrame, source: str, steps: tuple[str, ...]) -> DataFrame:
    """(step_no, step, removed, remaining) from one row holding the counts after each step."""
    stacked = ", ".join(f"{i}, '{step}', after_{i}" for i, step in enumerate(steps))
    rows = counts.selectExpr(f"stack({len(steps)}, {stacked}) AS (step_no, step, remaining)")
    before = F.lag("remaining").over(Window.orderBy("step_no"))  # a handful of rows
    removed = F.coalesce(before - F.col("remaining"), F.lit(0).cast("bigint"))
    return rows.select(
        F.lit(source).alias("part"), "step_no", "step", removed.alias("removed"), "remaining"
    )


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0).cast("bigint"))


def clean_ledger(summary: DataFrame) -> DataFrame:
    """Rows removed and remaining per cleaning step, from one aggregate."""
    named = F.col("hostname") != ""
    two = F.col("min_label") != F.col("max_label")
    counts = summary.agg(
        F.sum("rows").alias("after_0"),
        F.sum("urls").alias("after_1"),
        F.sum(F.when(named, F.col("urls")).otherwise(0)).alias("after_2"),
        (_count(named) + _count(named & two)).alias("after_3"),
        _count(named & ~two).alias("after_4"),
    )
    return _ledger(counts, "clean", CLEAN_STEPS)


def ranked_hosts(list_a: DataFrame) -> DataFrame:
    """(hostname, rank): best rank per non-empty host of a popularity list."""
    hosts = with_hostname(list_a.select("rank", "raw"), "raw")
    return hosts.where(F.col("hostname") != "").groupBy("hostname").agg(F.min("rank").alias("rank"))


def top_domains(list_b: DataFrame, top_n: int = TOP_N) -> DataFrame:
    top = list_b.where(F.col("rank") <= top_n)
    return top.select(F.lower("domain").alias("registered_domain")).distinct()


def stress_domains(stress: DataFrame, rules: SuffixRules | SuffixTable | None = None) -> DataFrame:
    hosts = with_registered_domain(stress.select("hostname"), rules=rules)
    return hosts.select("registered_domain").distinct()


def _with_validity(hosts: DataFrame, rules: SuffixRules | SuffixTable | None) -> DataFrame:
    parts = with_host_parts(hosts, rules=rules)
    ok = (F.col("suffix") != "") & has_subdomain(F.col("hostname"), F.col("registered_domain"))
    return parts.select(*hosts.columns, "registered_domain", ok.alias("valid"))


@dataclass
class BenignFilter:
    """What the popular hosts are filtered by. Small lists are marked for broadcast once, after
    a check of their size."""

    top: DataFrame
    tested: DataFrame
    phishing: DataFrame
    max_per_domain: int = MAX_PER_DOMAIN
    rules: SuffixRules | SuffixTable | None = None

    @staticmethod
    def of(
        list_b: DataFrame, stress: DataFrame, phishing: DataFrame, top_n: int = TOP_N,
        max_per_domain: int = MAX_PER_DOMAIN, rules: SuffixRules | SuffixTable | None = None,
    ) -> "BenignFilter":
        return BenignFilter(
            broadcast_if_small(durable(top_domains(list_b, top_n))),
            broadcast_if_small(durable(stress_domains(stress, rules))),
            phishing.select("hostname"), max_per_domain, rules,
        )


def tagged_hosts(list_a: DataFrame, by: BenignFilter) -> DataFrame:
    """(hostname, registered_domain, rank, dropped_by): every popular host with the first step that
    drops it, 99 for none. Hosts and ledger both come from this one pass over the list."""
    mark = F.lit(True)
    hosts = (
        _with_validity(ranked_hosts(list_a), by.rules)
        .join(by.top.withColumn("in_top", mark), "registered_domain", "left")
        .join(by.tested.withColumn("in_stress", mark), "registered_domain", "left")
        .join(by.phishing.withColumn("in_phishing", mark), "hostname", "left")
    )
    dropped_by = (
        F.when(~F.col("valid"), 1).when(F.col("in_top").isNull(), 2)
        .when(F.col("in_phishing").isNotNull(), 3).when(F.col("in_stress").isNotNull(), 4)
        .otherwise(99)
    )
    return hosts.select("hostname", "registered_domain", "rank", dropped_by.alias("dropped_by"))


def benign_hosts(tagged: DataFrame, by: BenignFilter) -> DataFrame:
    """(hostname, registered_domain): popular hosts with a subdomain that no step drops, capped."""
    kept = tagged.where(F.col("dropped_by") == 99)
    capped = cap_per_group(kept, "registered_domain", ["rank", "hostname"], by.max_per_domain)
    return capped.select("hostname", "registered_domain")


def benign_ledger(tagged: DataFrame, by: BenignFilter) -> DataFrame:
    """Rows removed and remaining per step, in one aggregate. Hosts over the cap are counted, not
    ranked."""
    per_domain = tagged.groupBy("registered_domain", "dropped_by").agg(F.count(F.lit(1)).alias("n"))
    kept = F.when(F.col("dropped_by") == 99, F.least("n", F.lit(by.max_per_domain))).otherwise(0)
    after = [
        F.sum(F.when(F.col("dropped_by") > i, F.col("n")).otherwise(0)).alias(f"after_{i}")
        for i in range(5)
    ]
    return _ledger(per_domain.agg(*after, F.sum(kept).alias("after_5")), "benign", BENIGN_STEPS)


@dataclass
class MergedHosts:
    rows: DataFrame
    ledger: DataFrame


def merge_sources(primary: DataFrame, benign: DataFrame) -> MergedHosts:
    """Union by priority: the primary copy of a (hostname, label) wins, conflicts are dropped.

    Dedupe and conflict check share one aggregate by hostname.
    """
    both = primary.select(
        "hostname", "registered_domain", "label", F.lit(0).alias("priority")
    ).unionByName(
        benign.select(
            "hostname", "registered_domain", F.lit(0).alias("label"), F.lit(1).alias("priority")
        )
    )
    per_host = both.groupBy("hostname", "registered_domain").agg(
        F.min("label").alias("label"), F.max("label").alias("max_label"),
        F.min("priority").alias("priority"), F.count(F.lit(1)).alias("rows"),
    )
    per_host = durable(per_host)  # read by the ledger, the folds and the split
    clean = F.col("label") == F.col("max_label")
    source = F.when(F.col("priority") == 0, PRIMARY_SOURCE).otherwise(BENIGN_SOURCE)
    counts = per_host.agg(
        F.sum("rows").alias("after_0"),
        (F.count(F.lit(1)) + _count(~clean)).alias("after_1"),
        _count(clean).alias("after_2"),
    )
    rows = per_host.where(clean).select(
        "hostname", "registered_domain", "label", source.alias("source")
    )
    return MergedHosts(rows, _ledger(counts, "merge", MERGE_STEPS))


@dataclass
class Dataset:
    """The merged hosts; the split and the ledger are worked out when first asked for."""

    summary: DataFrame
    tagged: DataFrame
    by: BenignFilter
    merged: MergedHosts
    folds: int
    seed: int

    @cached_property
    def rows(self) -> DataFrame:
        """hostname, registered_domain, label, source, fold, split; fold 0 is the test set."""
        rows = grouped_folds(
            self.merged.rows, "registered_domain", "label", self.folds, self.seed
        )
        split = F.when(F.col("fold") == 0, "test").otherwise("train")
        return rows.withColumn("split", split)

    @cached_property
    def ledger(self) -> DataFrame:
        """part, step_no, step, removed, remaining of all steps."""
        return (
            clean_ledger(self.summary)
            .unionByName(benign_ledger(self.tagged, self.by))
            .unionByName(self.merged.ledger)
        )


def build_dataset(
    raw: DataFrame,
    list_a: DataFrame,
    list_b: DataFrame,
    stress: DataFrame,
    order: str = "url_id",
    top_n: int = TOP_N,
    max_per_domain: int = MAX_PER_DOMAIN,
    folds: int = FOLDS,
    seed: int = SEED,
    rules: SuffixRules | SuffixTable | None = None,
) -> Dataset:
    """Clean, add the benign list, merge and split."""
    summary = durable(host_summary(raw, order))  # the raw URLs are read once
    primary = with_registered_domain(clean_hosts(summary), rules=rules)
    phishing = primary.where(F.col("label") == 1)
    by = BenignFilter.of(list_b, stress, phishing, top_n, max_per_domain, rules)
    tagged = durable(tagged_hosts(list_a, by))  # the popularity list is read once
    merged = merge_sources(primary, benign_hosts(tagged, by))
    return Dataset(summary, tagged, by, merged, folds, seed)


def shared_domains(rows: DataFrame) -> DataFrame:
    """Registered domains found in both splits: must be empty."""
    spread = rows.groupBy("registered_domain").agg(
        F.min("split").alias("lo"), F.max("split").alias("hi")
    )
    return spread.where(F.col("lo") != F.col("hi")).select("registered_domain")


def split_report(rows: DataFrame) -> DataFrame:
    """Per split: rows, classes, phishing share, distinct domains."""
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.col("label").cast("bigint")).alias("phishing"),
        F.sum((1 - F.col("label")).cast("bigint")).alias("legit"),
        (F.avg("label") * 100).alias("pct_phishing"),
        F.count_distinct("registered_domain").alias("domains"),
    )


def class_report(rows: DataFrame) -> DataFrame:
    """Per class: share of hosts with a subdomain, and on free hosting."""
    sub = has_subdomain(F.col("hostname"), F.col("registered_domain"))
    free = F.col("registered_domain").isin(*FREE_HOSTING_DOMAINS)
    return rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.avg(sub.cast("double")) * 100).alias("pct_subdomain"),
        (F.avg(free.cast("double")) * 100).alias("pct_free_hosting"),
    )


def source_report(rows: DataFrame) -> DataFrame:
    """Rows by source and class, with subtotals and the total (NULL = all)."""
    return rows.rollup("source", "label").agg(F.count(F.lit(1)).alias("n_rows"))
