"""The registered model queries train with the library's settings."""

from inspect import signature

import pytest

from checks import model_queries as mq
from hostlens.plans import training as tr


class Stop(Exception):
    pass


@pytest.fixture
def fits(monkeypatch):
    """The settings of the first fit of boosted trees or comparison; nothing is trained."""
    seen = {}

    def stop(name):
        whole = signature(getattr(tr, name))

        def run(*args, **kwargs):
            seen.update(bound := whole.bind(*args, **kwargs).arguments)
            seen.update({k: p.default for k, p in whole.parameters.items() if k not in bound})
            raise Stop

        return run

    for name in ("fit_boosted", "compare_models"):
        monkeypatch.setattr(tr, name, stop(name))
    for name in ("rows", "folded"):
        monkeypatch.setattr(mq, name, lambda spark, sf: None)
    return seen


@pytest.mark.parametrize("build", [mq.t4, mq.comparison, mq.champion])
def test_all_trees_are_grown(spark, fits, build):
    with pytest.raises(Stop):
        build(spark, f"no tables for {build.__name__}")
    assert (fits["trees"], fits["depth"]) == (300, 6) == (tr.TREES, tr.TREE_DEPTH)
    assert fits.get("iterations", tr.LR_ITERATIONS) == 2000
