"""Vocabulary, vectors and scores of the n-gram model against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from hostlens.operators.selection import largest
from hostlens.plans import training as tr
from tests.test_plans import char_wb


def hosts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choices("abc-.éя😀", k=r.randrange(0, 14))) for _ in range(n)] + ["aaaaaaaaaaaa.com"] * 5


def frame(spark, values):
    return spark.createDataFrame([(h,) for h in values], "hostname string").repartition(3)


@pytest.mark.parametrize("size", [0, 1, 2, 5, 17, 40, 99, 100, 500])
def test_largest(spark, size):
    r = random.Random(size)
    counts = [0, 1, 1, 1, 3, 4096, 4097, 1 << 30, (1 << 30) + 1, 1 << 61]
    texts = {"".join(r.choices("aAbé￿😀", k=r.randrange(0, 5))) for _ in range(400)}
    rows = [(t, r.choice(counts)) for t in sorted(texts)[:100]]
    got = largest(spark.createDataFrame(rows, "text string, n long").repartition(4), size).collect()
    want = sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:size]
    assert sorted(map(tuple, got)) == sorted(want)


def test_largest_of_nothing(spark):
    rows = spark.createDataFrame([], "text string, n long")
    assert largest(rows, 3).count() == 0


@pytest.mark.parametrize("size", [3, 50, 10_000])
def test_vocabulary(spark, size):
    all_hosts = hosts(200, 1)
    n, df = Counter(), Counter()
    for h in all_hosts:
        n.update(char_wb(h))
        df.update(set(char_wb(h)))
    want = sorted((g for g in n if df[g] >= 2), key=lambda g: (-n[g], g.encode()))[:size]
    got = {r.gram: r for r in tr.ngram_vocabulary(frame(spark, all_hosts), 2, size).collect()}
    assert set(got) == set(want)
    for g in want:
        weight = math.log((1 + len(all_hosts)) / (1 + df[g])) + 1
        assert (got[g].n, got[g].df) == (n[g], df[g]) and got[g].weight == pytest.approx(weight, abs=1e-12)


def trained(spark):
    model = tr.NgramModel.of(tr.ngram_vocabulary(frame(spark, hosts(200, 1)), 2))
    r = np.random.default_rng(4)
    model.coefficient, model.intercept = r.normal(size=len(model.grams)), 0.25
    return model


def entries(model, host):
    place = {g: i for i, g in enumerate(model.grams)}
    grams = Counter(char_wb(host or ""))
    x = {place[g]: (1 + math.log(c)) * model.weight[place[g]] for g, c in grams.items() if g in place}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {i: v / norm for i, v in x.items()}


def test_scores_and_vectors(spark):
    model = trained(spark)
    some = [*hosts(100, 2), "", None, "zzzz", "a" * 300]
    df = frame(spark, some)
    scored = model.score(df.withColumnRenamed("hostname", "h"), "p", "h").collect()
    assert len(scored) == len(some)
    for r in scored:
        margin = sum(v * model.coefficient[i] for i, v in entries(model, r.h).items()) + model.intercept
        assert r.p == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9), r.h
    for r in model.vectors(df).collect():
        assert r._unit.size == len(model.grams)
        got = dict(zip(r._unit.indices.tolist(), r._unit.values.tolist()))
        assert got == pytest.approx(entries(model, r.hostname), abs=1e-12)


def test_saved(spark, tmp_path):
    model = trained(spark)
    model.save(spark, str(tmp_path / "m"))
    loaded = tr.NgramModel.load(spark, str(tmp_path / "m"))
    assert loaded.grams == model.grams and loaded.intercept == model.intercept
    assert (loaded.weight == model.weight).all() and (loaded.coefficient == model.coefficient).all()


def test_no_known_ngram(spark):
    model = tr.NgramModel([], np.zeros(0), np.zeros(0), -1.0)
    assert {r.probability for r in model.score(frame(spark, ["a", "", "b"])).collect()} == {1 / (1 + math.e)}


def test_no_python_and_no_shuffle(spark):
    model = trained(spark)
    df = spark.createDataFrame([("a.b",)], "hostname string")
    for plan in (model.score(df), model.vectors(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not any(x in text for x in ("Python", "Arrow", "Exchange", "Join"))
    stream = spark.readStream.format("rate").load().selectExpr("CAST(value AS STRING) AS hostname")
    assert "Python" not in model.score(stream)._jdf.queryExecution().analyzed().toString()


def test_no_work_over_the_whole_vocabulary_per_ngram(spark):
    """A slice of one constant array of all n-grams goes over its length, for each n-gram of each row."""
    model = trained(spark)
    df = spark.createDataFrame([("a.b",)], "hostname string")
    for plan in (model.score(df), model.units(df)):
        assert "slice(" not in plan._jdf.queryExecution().analyzed().toString()


def test_stored_units_are_the_vectors(spark, tmp_path):
    model = trained(spark)
    df = frame(spark, [*hosts(50, 3), ""])
    model.units(df).write.parquet(str(tmp_path / "u"))
    vectors = model.vectors(df)
    stored = spark.read.schema(vectors.schema).parquet(str(tmp_path / "u"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, vectors.collect()))


def test_lookups_leave_no_array_by_an_exception(spark):
    """`array_position` and `array_contains` end a search that finds something by an exception, for each n-gram."""
    model = trained(spark)
    df = spark.createDataFrame([("a.b",)], "hostname string")
    for plan in (model.score(df), model.units(df), tr.ngram_vocabulary(df, 1)):
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "array_position" not in text and "array_contains" not in text


def test_few_rows_are_one_task_of_a_regression_step(spark, monkeypatch):
    """A step of a fit is a job of its own, so few rows must not be dealt to many tasks."""
    seen = []
    plain = tr.LogisticRegression.fit
    monkeypatch.setattr(tr.LogisticRegression, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()) or plain(self, df))
    rows = [(h, i % 2) for i, h in enumerate(hosts(120, 5))]
    tr.fit_ngram(spark.createDataFrame(rows, "hostname string, label int").repartition(7), iterations=3)
    assert seen == [1]
