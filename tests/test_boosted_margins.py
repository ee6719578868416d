"""Trees: sums of the smaller child only, scores by a walk of whole batches, n-gram fits side by side."""

import threading

import numpy as np
from pyspark.sql import functions as F

from hostlens.operators.boosting import Boosted, grow
from hostlens.plans import training as tr


def test_only_the_smaller_child_is_summed(monkeypatch):
    """A tree of d levels sums at most half of the rows below the root; the walk of a plain tree checks the gains."""
    r = np.random.default_rng(3)
    bins = r.integers(0, 20, (4000, 3)).astype(">u2")
    label = (bins[:, 0] + bins[:, 1] > 22).astype(float)
    seen, plain = [], np.bincount

    def counted(x, weights=None, minlength=0):
        seen.append(len(x))
        return plain(x, weights, minlength)

    monkeypatch.setattr(np, "bincount", counted)
    trees = list(grow(bins, label, np.ones(4000), [20] * 3, [0, 1, 2], 3, 4, 0.1))
    assert sum(seen) < 3 * (2 * 4000 * 3 * (1 + 3 / 2) + 2 * 4000) + 1
    losses = [t[4] for t in trees]
    assert losses[2] < losses[1] < losses[0]


def test_scores_are_those_of_the_heaps(spark):
    r = np.random.default_rng(4)
    depth, n = 3, 5
    feature = r.integers(-1, 2, (n, 1 << depth))
    threshold = np.where(feature >= 0, r.normal(size=feature.shape), np.inf)
    model = Boosted(("a", "b"), depth, feature, threshold, np.zeros(feature.shape), r.normal(size=(n, 2 << depth)), np.zeros(n))
    rows = [(i, float(r.normal()), float(r.normal())) for i in range(50)]
    rows += [(50, float("nan"), 1.0), (51, float("inf"), float("-inf")), (52, None, 1.0), (53, None, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double").repartition(3)

    def walk(x):
        total = 0.0
        for t in range(n):
            i = 1
            for _ in range(depth):
                v, limit = x[max(feature[t, i], 0)], min(threshold[t, i], np.finfo(float).max)
                if v is None:
                    return None
                i = 2 * i + (v != v or v >= limit)
            total += model.value[t, i]
        return 1 / (1 + np.exp(-total))

    scored = model.score(df)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # functions over arrays are interpreted: a millisecond a row
    got = {r.id: r.probability for r in scored.collect()}
    for i, *x in rows:
        want = walk(x)
        assert got[i] is None if want is None else abs(got[i] - want) < 1e-12, i
    assert model.score(df.where(F.lit(False))).count() == 0


def test_fits_run_side_by_side(spark):
    both = threading.Barrier(2, timeout=20)  # broken if one fit waits for the other

    def fit(df):
        both.wait()
        return df.count()

    assert tr.fit_each(fit, [spark.range(3), spark.range(4)]) == [3, 4]
