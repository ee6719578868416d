"""Ordered sums of many groups at once, against plain Python, with a group that holds most values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.operators.prefix import group_quantiles, group_sums


def table(seed):
    r = np.random.default_rng(seed)
    rows = [("hot", float(v), int(n), int(p)) for v, n, p in zip(r.permutation(3000), r.integers(0, 9, 3000), r.integers(0, 4, 3000))]
    for g in [None, *map(str, range(400))]:
        values = r.choice(50, size=r.integers(1, 6), replace=False)
        rows += [(g, float(v), int(r.integers(0, 3)), 1) for v in values]
    return rows


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_group_sums(spark, parts):
    rows = table(5)
    df = spark.createDataFrame(rows, "g string, v double, n long, pos long").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = group_sums(df, ("g",), "v", ("n", "pos"), nexts=F.col("n") > 0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    groups = {}
    for g, v, n, pos in rows:
        groups.setdefault(g, []).append((v, n, pos))
    want = set()
    for g, members in groups.items():
        members.sort()
        for i, (v, n, pos) in enumerate(members):
            following = next((w for w, m, _ in members[i + 1 :] if m > 0), None)
            cum = [sum(m[k] for m in members[: i + 1]) for k in (1, 2)]
            want.add((g, v, n, pos, *cum, *(sum(m[k] for m in members) for k in (1, 2)), following))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_group_quantiles(spark):
    rows = [r[:3] for r in table(9) if r[0] is not None and r[2] > 0] + [("0", None, 4)]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = group_quantiles(df, ("g",), "v", "n", {"a": 0.25, "b": 0.5, "c": 0.99, "lo": 0.0, "hi": 1.0}).collect()
    values = {}
    for g, v, n in rows:
        if v is not None:
            values.setdefault(g, []).extend([v] * n)
    assert len(got) == len(values)
    for r in got:
        assert tuple(r[1:]) == pytest.approx(tuple(np.quantile(values[r.g], [0.25, 0.5, 0.99, 0, 1])))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double, n long")
    assert group_sums(empty, ("g",), "v", ("n",)).count() == 0
    assert group_quantiles(empty, ("g",), "v", "n", {"a": 0.5}).count() == 0
