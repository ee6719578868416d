"""What models keep on the driver: few vectors, packed trees, short texts of plans."""

import threading
import time

import numpy as np

from hostlens.functions.features import with_features
from hostlens.operators import boosting as bo
from hostlens.plans import training as tr
from tests.test_ngram_fits import frame


def test_large_vocabularies_are_fitted_one_at_a_time(spark, monkeypatch):
    """All fits were submitted together, each with some 25 vectors of the length of its vocabulary."""
    now, most, lock = set(), [], threading.Lock()
    plain = tr._regression

    def watched(*args):
        with lock:
            now.add(threading.get_ident())
            most.append(len(now))
        time.sleep(0.3)
        try:
            return plain(*args)
        finally:
            with lock:
                now.discard(threading.get_ident())

    monkeypatch.setattr(tr, "_regression", watched)
    found = []
    for terms in (tr.TERMS_AT_ONCE, 1):
        monkeypatch.setattr(tr, "TERMS_AT_ONCE", terms)
        most.clear()
        found.append((max(most, default=0), tr.fit_ngrams(frame(spark), tr.folds_out(3), 2, 120, 20), max(most)))
    assert found[0][2] > 1 and found[1][2] == 1
    for a, b in zip(found[0][1], found[1][1]):
        assert a.grams == b.grams and np.allclose(a.coefficient, b.coefficient, atol=1e-9)


def test_a_plan_has_the_constants_of_one_model(spark, monkeypatch):
    """The scores of all folds were one plan, with the n-grams of each of its models."""
    asked = []
    plain = tr.durable
    monkeypatch.setattr(tr, "durable", lambda df: asked.append(df._jdf.queryExecution().analyzed().toString().count("crc32")) or plain(df))
    train = with_features(frame(spark).where("fold IS NOT NULL AND hostname != ''")).withColumn("source", tr.F.lit("s"))
    model = tr.fit_ngram(train, 2, 60, 3)
    one = tr.evaluate([model], model, train.where("fold = 0"), train, train.select("hostname"))
    asked.clear()
    out = tr.evaluate([model] * 3, model, train, train, train.select("hostname"))
    assert asked and max(asked) == 1
    assert out.oof.count() == train.count() and one.oof.count() == train.where("fold = 0").count()
    assert {r.fold for r in out.oof.select("fold").distinct().collect()} == {0, 1, 2}


def test_texts_of_plans_are_short(spark):
    model = tr.NgramModel([f"a{i}" for i in range(5000)], np.ones(5000), np.ones(5000), 0.0)
    df = spark.createDataFrame([("a1.b",)], "hostname string")
    session = spark.newSession()
    scored = model.score(session.createDataFrame([("a1.b",)], "hostname string"))
    assert len(scored._jdf.queryExecution().toString()) < 4 * tr.PLAN_TEXT
    other = spark.newSession()
    other.conf.set("spark.sql.maxPlanStringLength", "1000000")
    model.score(other.createDataFrame([("a1.b",)], "hostname string"))
    assert other.conf.get("spark.sql.maxPlanStringLength") == "1000000" and model.score(df).count() == 1


def test_trees_come_back_packed(spark, monkeypatch):
    """They were collected as rows: an object per node of each tree of each fit."""
    rows = spark.createDataFrame([(float(i % 7), i % 2, i % 3) for i in range(60)], "x double, label int, fold int")
    fits = [bo.Fit("a", ("x",), 0), bo.Fit("b", ("x",)), bo.Fit("none", ("x",))]
    kinds = []
    plain = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: kinds.append(self.columns) or plain(self))
    together = bo.fit_all(rows, fits, 3, 2, 0.1)
    apart = bo.fit_all(rows, fits, 3, 2, 0.1, shard_rows=20)
    assert len([c for c in kinds if "split" in c]) == 1 + 3
    for f in fits:
        for part in ("feature", "threshold", "gain", "value", "loss"):
            assert (getattr(together[f.name], part) == getattr(apart[f.name], part)).all()
    assert together["a"].feature.shape == (3, 4) and together["a"].value.shape == (3, 8)
