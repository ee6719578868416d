"""Counts of n-grams inside a row."""

from collections import Counter

from hostlens.plans.training import ngram_counts


def test_counts_without_a_shuffle(spark):
    hosts = ["aaaaaa.aaa", "abcabcabc", "", "x", "ab cd", "bücher.de", None]
    found = ngram_counts(spark.createDataFrame([(h,) for h in hosts], "hostname string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = Counter()
    for h in hosts:
        for word in (h or "").split():
            w = f" {word} "
            grams = [w[i : i + n] for n in (3, 4, 5) for i in range(len(w) - n + 1)] or [w]
            want.update((h, g) for g in grams)
    got = [(r.hostname, r.gram, r.n) for r in found.collect()]
    assert len(got) == len(want) and {(h, g): n for h, g, n in got} == want
