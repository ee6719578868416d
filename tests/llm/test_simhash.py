"""Near-duplicate groups against all pairs."""

import random

import pytest
import xxhash

from hostlens.llm import simhash
from hostlens.llm.graph import components
from tests.llm.conftest import EDGES, documents


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(points, bits=4):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in points:
        for b in points:
            if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in points}


def test_fingerprint():
    for text in ("", "one", "a b c d", "A b  c\td e\nf g H", "é É x y z é", "w " * 500, " ".join(map(str, range(300)))):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_lose_nothing(spark, bucket):
    r = random.Random(3)
    points = set()
    for _ in range(12):  # balls, chains and lone points
        c = r.getrandbits(64)
        points.add(c)
        for _ in range(25):
            points.add(c ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
        for _ in range(6):
            c ^= sum(1 << b for b in r.sample(range(64), 4))
            points.add(c)
    points = {simhash._signed(p) for p in points}
    df = spark.createDataFrame([(p,) for p in points], "fp long").repartition(4)
    got = dict(components(simhash.links(df, bucket=bucket)).collect())
    want = plain_groups(points)
    lone = {p for p in points if list(want.values()).count(want[p]) == 1}
    assert set(got) == points - lone
    groups = lambda m: sorted(sorted(p for p in m if m[p] == g) for g in set(m.values()))
    assert groups(got) == groups({p: g for p, g in want.items() if p not in lone})


def test_documents_and_stage(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = EDGES + [(50, base, "en", "a"), (40, base + " end", "en", "b"), (60, base.upper(), "en", "a"), (70, "quite another text of some words", "en", "a")]
    rows += [(1000 + i, "hot text that a third of all rows have", "en", "a") for i in range(30)]
    docs = documents(spark, rows)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[50] == of[60] == of[40] == 40 and of[70] == 70
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[1029] == 1000
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=str) == sorted({1, 4, 5, None, 7, 40, 70, 1000}, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 == simhash.drop_near_duplicates(docs.limit(0)).count()


def test_hub_and_chain_components(spark):
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect())
    assert {got[i] for i in range(200)} == {0} and {got[i] for i in range(1000, 1041)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
