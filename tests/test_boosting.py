"""Boosted trees against a plain second-order booster over exact splits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.operators import boosting as bo

COLUMNS = ("a", "b", "c")


def table(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.randrange(12), r.random() < 0.3, round(r.random(), 2)
        rows.append((i, float(a), int(b), c, int(r.random() < 1 / (1 + math.exp(3 - 0.5 * a - 2 * b + c))), i % 3))
    return rows


def plain(rows, columns, trees, depth, rate):
    """Probabilities after a greedy fit that tries every value of every column as a threshold."""
    xs = [[r[1 + COLUMNS.index(c)] for c in columns] for r in rows]
    ys, margin = [r[4] for r in rows], [0.0] * len(rows)
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [round((q - y) * bo.UNIT) / bo.UNIT for q, y in zip(p, ys)]
        h = [round(q * (1 - q) * bo.UNIT) / bo.UNIT for q in p]

        def leaf(of):
            return sum(g[i] for i in of), sum(h[i] for i in of)

        def descend(of, level):
            gs, hs = leaf(of)
            best = (bo.LEAST_GAIN, None, None)
            for f in range(len(columns) if level < depth else 0):
                for t in sorted({xs[i][f] for i in of})[1:]:
                    lg, lh = leaf([i for i in of if xs[i][f] < t])
                    rg, rh = gs - lg, hs - lh
                    if min(lh, rh) >= 1:
                        gain = round(lg**2 / (lh + 1) + rg**2 / (rh + 1) - gs**2 / (hs + 1), 9)
                        best = max(best, (gain, f, t), key=lambda x: x[0])
            if best[1] is None:
                for i in of:
                    margin[i] += rate * -gs / (hs + 1)
            else:
                descend([i for i in of if xs[i][best[1]] < best[2]], level + 1)
                descend([i for i in of if xs[i][best[1]] >= best[2]], level + 1)

        descend(range(len(rows)), 0)
    return [1 / (1 + math.exp(-m)) for m in margin]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, a double, b int, c double, label int, fold int")


def scores(model, df):
    return {r.id: r.probability for r in model.score(df).collect()}


def test_against_a_plain_booster(spark):
    rows = table(240, 1)
    df = frame(spark, rows)
    fits = [bo.Fit("all", COLUMNS), bo.Fit("two", ("c", "a")), bo.Fit("part", COLUMNS, 1)]
    models = bo.fit_all(df, fits, trees=6, depth=3, rate=0.3)
    for name, columns, used in (("all", COLUMNS, rows), ("two", ("c", "a"), rows), ("part", COLUMNS, [r for r in rows if r[5] != 1])):
        got, want = scores(models[name], df), plain(used, columns, 6, 3, 0.3)
        assert max(abs(got[r[0]] - w) for r, w in zip(used, want)) < 1e-6
    assert (np.diff(models["all"].loss) < 0).all()
    assert sum(share for _, share in models["all"].importance()) == pytest.approx(1)


def test_shards_and_partitions_change_nothing(spark):
    df = frame(spark, table(300, 2))
    fits = [bo.Fit("all", COLUMNS), bo.Fit("part", COLUMNS, 2)]
    one = bo.fit_all(df, fits, trees=4, depth=3, rate=0.1)
    for other in (bo.fit_all(df.repartition(7), fits, 4, 3, 0.1), bo.fit_all(df, fits, 4, 3, 0.1, shard_rows=50)):
        for name in one:
            for part in ("feature", "threshold", "value", "loss"):
                assert (getattr(one[name], part) == getattr(other[name], part)).all()


def test_saved_trees_and_a_walk_in_sql(spark, tmp_path):
    df = frame(spark, table(200, 3))
    model = bo.fit_all(df, [bo.Fit("all", COLUMNS)], trees=5, depth=4, rate=0.2)["all"]
    model.save(spark, f"{tmp_path}/m")
    assert scores(bo.Boosted.load(spark, f"{tmp_path}/m"), df) == scores(model, df)


def test_rich_columns_and_one_class(spark):
    df = spark.range(3000).select(
        F.col("id"), F.sqrt("id").alias("a"), F.lit(1).alias("b"), (F.col("id") % 400).cast("double").alias("c"),
        (F.col("id") > 2990).cast("int").alias("label"), F.lit(0).alias("fold"))
    marks = bo.cuts(df, COLUMNS)
    assert len(marks[0]) <= bo.BINS and marks[0][-1] == math.sqrt(2999) and marks[1] == []
    models = bo.fit_all(df.where("label = 0"), [bo.Fit("one", COLUMNS), bo.Fit("none", COLUMNS, 0)], 2, 2, 0.1)
    assert len(set(scores(models["one"], df).values())) == 1
    assert set(scores(models["none"], df).values()) == {0.5}


def test_rows_are_packed_by_the_columns_of_a_fit(spark, monkeypatch):
    """A fit over one column has a row per bin, label and fold, whatever columns the other fits have."""
    packed = []

    def stored(df):
        out = durable(df)
        if "bins" in out.columns:
            packed.append(out)
        return out

    durable = bo.durable
    monkeypatch.setattr(bo, "durable", stored)
    df = spark.range(2000).select(
        F.sqrt("id").alias("a"), (F.col("id") % 3).alias("b"), (F.col("id") % 2).alias("label"), (F.col("id") % 5).alias("fold"))
    models = bo.fit_all(df, [bo.Fit("both", ("a", "b")), bo.Fit("b", ("b",)), bo.Fit("b 1", ("b",), 1)], 2, 2, 0.1)
    assert set(models) == {"both", "b", "b 1"} and models["b"].columns == ("b",)
    assert min(p.count() for p in packed) <= 3 * 2 * 5
    assert all(p.agg(F.sum("weight")).first()[0] == 2000 for p in packed)
