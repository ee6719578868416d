"""Host parts by the complete public suffix list, on hosts below each of its rules in both spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, shared
from checks.rules import public_list, rule_lines
from hostlens.functions.hostname import with_host_parts
from hostlens.functions.suffix import read_rules
from hostlens.sources import fixtures as fx
from hostlens.sources.scratch import scratch_path

# A rule's own name, with a label in place of its star, below 0 to 3 more labels.
FRONTS = ("", "x.", "mail.shop.", "p.q.r.")


def _plain(rule: str) -> str:
    return rule.replace("*", "any").replace("!", "")


def _spelled(name: str) -> str:
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in name.split("."))


def rules(spark, sf):
    def build():
        path = scratch_path(spark, "rules")
        spark.createDataFrame([(public_list(),)], "value string").coalesce(1).write.text(path)
        return read_rules(spark, path)

    return shared("public_list", spark, sf, build)


def hosts(spark, sf):
    """(hostname): for each order a host below one rule, in the rule's spelling or in ASCII."""
    lines = [(i, _plain(r), _spelled(_plain(r))) for i, r in enumerate(rule_lines())]
    names = spark.createDataFrame(lines, "i long, written string, plain string")
    orders = fx.table(spark, sf, "orders").select((F.col("o_orderkey") % len(lines)).cast("long").alias("i"), "o_custkey")
    front = F.element_at(F.array(*map(F.lit, FRONTS)), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.when((F.col("o_custkey") % 8).cast("int") < 4, F.col("written")).otherwise(F.col("plain"))
    return orders.join(F.broadcast(names), "i").select(F.concat(front, name).alias("hostname")).distinct()  # a row per rule


def _oracle() -> str:
    """The list's lines as text, each with its name in ASCII by Python's codec; all else is SQL."""
    lines = "\n".join(f"{r} {_plain(r)} {_spelled(_plain(r))} {_spelled(r.lstrip('!*').lstrip('.'))}" for r in rule_lines())
    fronts = "[" + ", ".join(f"'{x}'" for x in FRONTS) + "]"
    return f"""
WITH lines AS (SELECT string_split('{lines}', chr(10)) AS l),
list AS (SELECT i, f[1] AS rule, f[2] AS written, f[3] AS plain, f[4] AS name
  FROM (SELECT i, string_split(l[i + 1], ' ') AS f FROM lines, range({len(rule_lines())}) t(i))),
hosts AS (SELECT DISTINCT front || CASE WHEN written_so THEN written ELSE plain END AS hostname, front || plain AS a
  FROM (SELECT o_orderkey % {len(rule_lines())} AS i, {fronts}[(o_custkey % 4 + 1)::INT] AS front, o_custkey % 8 < 4 AS written_so
        FROM orders) JOIN list USING (i)),
ends AS (SELECT hostname, a, k, len(string_split(a, '.')) AS n,
    array_to_string(string_split(a, '.')[len(string_split(a, '.')) - k + 1:], '.') AS t,
    CASE WHEN k > 1 THEN array_to_string(string_split(a, '.')[len(string_split(a, '.')) - k + 2:], '.') END AS b
  FROM (SELECT *, unnest(range(1, len(string_split(a, '.')) + 1)) AS k FROM hosts)),
counted AS (SELECT hostname, any_value(n) AS n, coalesce(
    max(CASE WHEN t IN (SELECT name FROM list WHERE rule LIKE '!%') THEN k - 1 END),
    max(CASE WHEN t IN (SELECT name FROM list WHERE NOT rule LIKE '!%' AND NOT rule LIKE '*.%')
               OR b IN (SELECT name FROM list WHERE rule LIKE '*.%') THEN k END), 0) AS k
  FROM ends GROUP BY hostname),
cut AS (SELECT hostname, n, k, string_split(hostname, '.') AS l FROM counted)
SELECT hostname, array_to_string(l[n - k + 1:n], '.') AS suffix, CASE WHEN k = n THEN '' ELSE l[n - k] END AS domain_label,
  CASE WHEN n - k < 2 THEN '' ELSE array_to_string(l[1:n - k - 1], '.') END AS subdomain,
  CASE WHEN k = 0 OR k = n THEN hostname ELSE array_to_string(l[n - k:n], '.') END AS registered_domain
FROM cut"""


@query("p4_p5_public_list", _oracle())
def p4_list(spark, sf):
    return with_host_parts(hosts(spark, sf), rules=rules(spark, sf)).select(
        "hostname", "suffix", "domain_label", "subdomain", "registered_domain"
    )

