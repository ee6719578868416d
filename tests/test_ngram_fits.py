"""Fits of several sets of rows make and look up the n-grams once, and give what each fit alone gives."""

import pytest

from hostlens.functions.features import with_features
from hostlens.plans import training as tr
from tests.test_ngram_model import hosts


def frame(spark):
    rows = [(h, (i * 7 + len(h or "")) % 2, None if i % 19 == 0 else i % 3) for i, h in enumerate([*hosts(300, 8), None, "", "a.b", "a.b"])]
    return spark.createDataFrame(rows, "hostname string, label int, fold int").repartition(3)


def test_sets_together_and_alone(spark):
    train = frame(spark)
    sets = tr.folds_out(3)
    together = tr.fit_ngrams(train, sets, min_df=2, max_ngrams=120, iterations=50)
    for one, rows in zip(together, sets):
        alone = tr.fit_ngram(train.where(rows), min_df=2, max_ngrams=120, iterations=50)
        assert one.grams == alone.grams and len(one.grams) == 120
        assert (one.weight == alone.weight).all()
        assert one.coefficient == pytest.approx(alone.coefficient, abs=1e-6)
        assert one.intercept == pytest.approx(alone.intercept, abs=1e-6)
    assert len({tuple(m.grams) for m in together}) > 1


def test_recoded_entries_are_the_units(spark):
    train = frame(spark)
    models = [tr.NgramModel.of(v) for v in tr.vocabularies(train, tr.folds_out(3), 2, 90)]
    every = tr.NgramModel.over(models)
    for model in models:
        got = model.recoded(every._entries(train, "hostname"), every).select("hostname", "_unit")
        want = model.units(train).select("hostname", "_unit")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_champion_looks_n_grams_up_once_for_all_fits(spark, monkeypatch):
    """The fits of the folds and of the whole share one pass; the others are the scores of the folds."""
    passes = []
    plain = tr.NgramModel._entries
    monkeypatch.setattr(tr.NgramModel, "_entries", lambda self, *a: passes.append(1) or plain(self, *a))
    tr.train_champion(with_features(frame(spark).where("fold IS NOT NULL AND hostname != ''")), k=3, trees=1, depth=1, iterations=3)
    assert len(passes) == 1 + 3
