"""The pattern-instance graph against plain Python, and contexts that few seeds confirm."""

import random

import pytest

from hostlens.llm import pii
from tests.llm.conftest import documents


def brute(edges, rounds):
    seeds = {i for _, i, seed in edges if seed}
    held = {p: {i for q, i, _ in edges if q == p} for p, _, _ in edges}
    scores: dict = {}
    for _ in range(rounds):
        sure = {}
        for p, of in held.items():
            known = sum(1.0 if i in seeds else scores.get(i, 0.0) for i in of)
            confidence = known / len(of) * known / (known + 1)
            if known >= pii.SUPPORT and confidence >= pii.CONFIDENT:
                sure[p] = confidence
        scores = {}
        for p, c in sure.items():
            for i in held[p] - seeds:
                scores[i] = scores.get(i, 1.0) * (1 - c)
        scores = {i: 1 - doubt for i, doubt in scores.items()}
    return scores


def test_scores_of_the_graph(spark):
    r = random.Random(4)
    edges = []
    for i in range(300):
        seed = i < 210
        for p in r.sample(range(14), r.randrange(1, 4)):
            edges += [(f"p{p}", f"i{i}", seed)] * r.choice((1, 1, 3))  # repeats are no more evidence
    # A second group of patterns, which only instances found in the first round can confirm.
    edges += [(f"p{p}", f"j{i}", False) for i in range(8) for p in (20, 21, 22)]
    edges += [(f"q{p}", f"k{i}", True) for i in range(12) for p in range(3)] + [(f"q{p}", f"j{i}", False) for i in range(6) for p in range(3)]
    df = spark.createDataFrame(edges, "pattern string, instance string, seed boolean").repartition(3)
    for rounds in (1, 3):
        want = brute(edges, rounds)
        got = {x.instance: x.score for x in pii.discover(df, rounds).collect()}
        assert got == pytest.approx(want) and len(want) > 10


@pytest.mark.parametrize("seeds, unseen, found", [(10, 3, True), (5, 1, True), (4, 1, False), (5, 9, False)])
def test_few_seeds_confirm_a_context(spark, seeds, unseen, found):
    rows = [(i, f"please send mail to user{i}@mail.example.com any time today", "en", "a") for i in range(seeds)]
    rows += [(100 + i, f"please send mail to user-{12345 + i} any time today", "en", "a") for i in range(unseen)]
    rows += [(200, "room user-77777 is free", "en", "a"), (201, "please send 12345 boxes", "en", "a")]
    got = {x["doc_id"]: x["n_found"] for x in pii.digest(pii.extract(documents(spark, rows))).collect()}
    assert [got[100 + i] for i in range(unseen)] == [int(found)] * unseen
    assert got[200] == got[201] == got[0] == 0
