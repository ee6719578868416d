"""The near-duplicate stage against the distances of all pairs of fingerprints."""

import random

import pytest

from hostlens.llm import simhash
from tests.llm.conftest import CLASHING, documents


def family(n, words, changed, seed):
    """Texts that differ from a template in some words each: many pairs are near, as many are not quite."""
    r = random.Random(seed)
    template = [f"w{r.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(template)
        for j in r.sample(range(words), r.choice(changed)):
            copy[j] = f"n{r.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def smallest_reachable(rows, bits):
    points = {i: simhash.fingerprint(text or "") for i, text, *_ in rows}
    left, out = sorted(points), {}
    while left:
        group, todo = {left[0]}, [left[0]]
        while todo:
            x = todo.pop()
            near = [y for y in left if y not in group and (points[x] ^ points[y]).bit_count() <= bits]
            group.update(near)
            todo += near
        out |= dict.fromkeys(group, left[0])
        left = [x for x in left if x not in group]
    return out


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 4])
def test_one_of_each_component_stays(spark, bucket):
    texts = family(150, 120, (2, 3, 4), 1) + family(60, 400, (1, 2, 20), 2) + ["", None, "one", "one two", "one"]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, texts[0], "en", "b") for i in range(30)]
    docs = documents(spark, rows)
    want = smallest_reachable(rows, simhash.MAX_BITS)
    assert 10 < len(set(want.values())) < 200
    got = simhash.drop_near_duplicates(docs, bucket=bucket)
    assert got.columns == docs.columns
    kept = {x["doc_id"]: x for x in got.collect()}
    assert set(kept) == set(want.values())
    assert {x[c] for x in kept.values() for c in CLASHING} == {"x"}
