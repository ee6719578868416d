"""Suffix rules as a table: both spellings of names, golden hosts by the list that Spark ships, brute force."""

import random

import pytest
from pyspark.sql import functions as F

from checks.rules import public_list, rule_lines
from hostlens.functions import hostname as H
from hostlens.functions.punycode import to_ascii, to_unicode
from hostlens.functions.suffix import SuffixRules, SuffixTable, read_rules, suffix_table

ALPHABETS = ["abcxyz0189-", "äöüßéñ", "абвя", "公司香港網絡", "ไทยคม", "😀𐍈"]


def column(spark, values, name="v"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def spelled(label):
    """The ASCII form by Python's own codec."""
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


def names(n, seed):
    r = random.Random(seed)
    for _ in range(n):
        letters = "".join(r.sample(ALPHABETS, r.randrange(1, 4)))
        yield ".".join("".join(r.choices(letters, k=r.randrange(1, 30))) for _ in range(r.randrange(1, 4)))


def test_both_spellings(spark):
    texts = [*names(300, 5), "", "a..b", "münchen.de", "ü", "-ü-", None]
    df = column(spark, texts).select("i", "v", to_ascii("v").alias("a")).orderBy("i")
    got = [r.a for r in df.collect()]
    assert got == [None if t is None else ".".join(map(spelled, t.split("."))) for t in texts]
    back = df.select("i", to_unicode("a").alias("u")).orderBy("i").collect()
    assert [r.u for r in back] == texts


ODD = ["xn--", "xn--a", "xn--99999999", "xn--zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "xn--a_b!", "xn--ü", "a.xn--", "xn--" + "9" * 59]


def test_odd_spellings_stay(spark):
    def plain(label):
        body = label[4:]
        if not label.startswith("xn--") or not label.isascii() or not body.rpartition("-")[2]:
            return label
        try:
            return body.encode().decode("punycode")
        except UnicodeError:
            return label

    got = column(spark, ODD).select(to_unicode("v").alias("u"), "v").collect()
    for r in got:
        assert r.u in {".".join(map(plain, r.v.split("."))), r.v}, r.v


def parts(spark, hosts, rules):
    df = H.with_host_parts(column(spark, hosts, "hostname"), rules=rules)
    return {r.hostname: (r.registered_domain, r.suffix) for r in df.collect()}


def test_public_list(spark, tmp_path):
    (tmp_path / "list.dat").write_text(public_list(), encoding="utf-8")
    rules = read_rules(spark, str(tmp_path / "list.dat"))
    assert isinstance(rules, SuffixTable) and rules.rules.count() > 6000
    golden = {
        "a.b.lol": ("b.lol", "lol"), "mail.shop.cfd": ("shop.cfd", "cfd"), "a.b.xn--p1ai": ("b.xn--p1ai", "xn--p1ai"),
        "a.b.рф": ("b.рф", "рф"), "a.b.tokyo.jp": ("b.tokyo.jp", "tokyo.jp"), "x.y.k12.ca.us": ("y.k12.ca.us", "k12.ca.us"),
        "x.公司.cn": ("x.公司.cn", "公司.cn"), "y.x.xn--55qx5d.cn": ("x.xn--55qx5d.cn", "xn--55qx5d.cn"),
        "a.b.ck": ("a.b.ck", "b.ck"), "a.www.ck": ("www.ck", "ck"), "pytorch.github.io": ("github.io", "io"),
        "co.uk": ("co.uk", "co.uk"), "a.b.nosuchending": ("a.b.nosuchending", ""), "10.0.0.1": ("10.0.0.1", ""), "": ("", ""),
    }
    assert parts(spark, list(golden), rules) == golden


def test_against_brute_force(spark):
    r = random.Random(11)
    labels = ["a", "b", "c", "ü", "я"]

    def name(most):
        return ".".join(r.choices(labels, k=r.randrange(1, most)))

    exact, below, exception = ({name(4) for _ in range(n)} for n in (12, 8, 6))
    rules = [*exact, *("*." + x for x in below), *("!x." + x for x in exception), *exact]
    hosts = sorted({name(6) for _ in range(300)} | {"x." + name(5) for _ in range(200)} | {"a.x." + x for x in exception})

    def count(host):
        parts = host.split(".")
        ends = {k: ".".join(parts[-k:]) for k in range(1, len(parts) + 1)}
        out = [k for k in ends if ends[k] in exact or (k > 1 and ends[k - 1] in below)]
        exceptions = [k - 1 for k in ends if ends[k].startswith("x.") and ends[k][2:] in exception]
        return max(exceptions or out or [0])

    table = suffix_table(column(spark, rules, "rule"))
    df = column(spark, hosts, "hostname").unionByName(
        column(spark, [".".join(map(spelled, h.split("."))) for h in hosts], "hostname"))
    got = table.suffix_labels(df, "hostname", "k").select("i", "hostname", "k").collect()
    assert len(got) == 2 * len(hosts)
    assert [(x.hostname, x.k) for x in got] == [(x.hostname, count(hosts[x.i])) for x in got]


def test_same_as_literal_rules(spark):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck"]
    hosts = ["a.co.uk", "b.a.co.uk", "uk", "ck", "x.ck", "y.x.ck", "www.ck", "a.www.ck", "com", "a.com", "a.org", "", ".com"]
    table = suffix_table(column(spark, rules, "rule"))
    assert parts(spark, hosts, table) == parts(spark, hosts, SuffixRules.parse(rules))


def test_odd_rules_and_no_rules(spark):
    with pytest.raises(ValueError, match="not a suffix rule"):
        suffix_table(column(spark, ["com", "a.*.b"], "rule"))
    none = suffix_table(column(spark, ["com"], "rule").where("false"))
    assert parts(spark, ["a.com"], none) == {"a.com": ("a.com", "")}
    df = column(spark, [None, "a.com"], "hostname")
    one = suffix_table(column(spark, ["com"], "rule"))
    assert sorted(one.suffix_labels(df, "hostname", "k").select(F.col("k")).collect()) == [(0,), (1,)]


def test_no_shuffle_and_no_python(spark):
    table = suffix_table(column(spark, rule_lines(), "rule"))
    plan = H.with_registered_domain(column(spark, ["a.b.lol"], "hostname"), rules=table)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text
