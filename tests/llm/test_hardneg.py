"""Hard negatives against brute force over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from hostlens.llm import hardneg
from hostlens.llm.hardneg import Pack, field_bytes, mine

FIELDS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every, positives=5, negatives=5):
    """`rows`: (id, label, vector); the place in the list is the row's number."""
    whole = []
    for place, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        whole.append((i, place, label, [int((256 * x) // 1) for x in v]))

    def score(a, b):
        return sum(x * y for x, y in zip(a[3], b[3]))

    out = []
    for a in (r for r in whole if r[0] % every == 0):
        ranked = sorted(((-score(a, b), b) for b in whole if b is not a), key=lambda x: (x[0], x[1][0], x[1][1]))
        for minus, b in [x for x in ranked if x[1][2] == a[2]][:positives]:
            fits = [(-m, n) for m, n in ranked if n[2] != a[2] and 80 * -minus <= 100 * -m <= 100 * -minus][:negatives]
            out += [(a[0], b[0], k + 1, n[0], -minus, s) for k, (s, n) in enumerate(fits)]
    return sorted(out)


def run(spark, rows, every, **settings):
    shape = "vec_id long, label int, embedding array<float>, row string, id string, score string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], shape).coalesce(1)
    return sorted(tuple(r[f] for f in FIELDS) for r in mine(df, F.col("vec_id") % every == 0, **settings).collect())


def vectors(n, width, seed, labels=4):
    r = random.Random(seed)
    return [(i, r.randrange(labels), [r.randrange(-128, 129) / 256 for _ in range(width)]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "SMALL_TASK_ROWS", 40)
    rows = vectors(150, 6, 1)
    assert run(spark, rows, 10, anchors=6, pack=7) == brute(rows, 10) != []


def test_ties_hot_vector_and_missing_values(spark):
    rows = vectors(40, 4, 2, 2)
    rows += [(i, i % 2, [0.5, 0.25, 0.0, 0.5]) for i in range(40, 80)]  # one vector in half of the rows
    rows += [(81, None, [0.1] * 4), (82, 1, None), (90, 1, [0.1, None, 0.2, 0.3]), (100, 0, [float("nan")] * 4),
             (None, 0, [0.5] * 4), (110, 1, [float("inf"), 0.0, 0.0, 0.0])]
    assert run(spark, rows, 10) == brute(rows, 10) != []


def test_rows_that_repeat_and_share_an_id(spark):
    rows = [(0, 0, [0.5, 0.5]), (0, 0, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (1, 1, [0.5, 0.4]), (2, 0, [0.4, 0.5])]
    assert run(spark, rows, 100) == brute(rows, 100) != []


def test_lengths_empty_vectors_and_empty_tables(spark):
    assert run(spark, [(0, 0, [0.5]), (1, 0, [0.5, 0.5]), (2, 1, [0.45]), (3, 1, [])], 100) == [(0, 1, 1, 2, 128 * 128, 128 * 115)]
    assert run(spark, [], 100) == run(spark, [(1, 1, [0.5])], 100) == run(spark, [(0, 1, [])], 100) == []


def test_wide_values_and_overflow(spark):
    rows = [(0, 0, [2.0**18, -1.0]), (1, 0, [2.0**18, 3.0]), (2, 1, [2.0**18 * 0.9375, 2.0])]
    assert run(spark, rows, 100) == brute(rows, 100) != []
    with pytest.raises(Exception, match="beyond a long"):
        run(spark, [(0, 0, [2.0**40]), (1, 0, [2.0**40])], 100)


@pytest.mark.parametrize("field", [4, 8, 11])
def test_a_pack_unpacks_to_exact_scores(field):
    rows = vectors(9, 5, 3)
    ints = [[int(256 * x) for x in v] for _, _, v in rows]
    least, bias = min(map(min, ints)), -128
    anchor = ints[4]
    assert Pack(ints, least, field).scores([x - bias for x in anchor], bias).tolist() == [
        sum(x * y for x, y in zip(anchor, r)) for r in ints
    ]
    assert field_bytes(5, 256, 256, 1 << 20) == 4
