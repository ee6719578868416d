"""Draws per row: both words of a key count, and pairs and triples of draws are independent."""

import itertools
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from hostlens.functions.urlshape import md5_word
from hostlens.operators.estimation import (
    PRIME, binomial_draws, draw_constants, estimation_interval, with_draws, with_tails,
)

ROWS = 1_000_000


def test_draws_are_independent(spark):
    df = spark.range(ROWS).select(F.col("id").cast("string").alias("k"))
    u = with_draws(df, "k", 4, 42).groupBy("k").pivot("draw", [0, 1, 2, 3]).agg(F.first("u")).drop("k")
    centred = [(F.col(str(d)) - 0.5) for d in range(4)]
    moments = [centred[d] for d in range(4)]
    moments += [centred[i] * centred[j] for i, j in itertools.combinations(range(4), 2)]
    moments += [centred[i] * centred[j] * centred[k] for i, j, k in itertools.combinations(range(4), 3)]
    # Which of 4 cells each of two draws falls in.
    cells = [F.floor(F.col(str(d)) * 4) for d in range(4)]
    both = [((cells[0] == a) & (cells[1] == b)).cast("double") - 1 / 16 for a in range(4) for b in range(4)]
    found = u.agg(*[F.avg(m) for m in moments + both]).first()
    spread = [12**-0.5] * 4 + [1 / 12] * 6 + [12**-1.5] * 4 + [(15 / 256) ** 0.5] * 16
    for value, sigma in zip(found, spread):
        assert abs(value) < 4.5 * sigma / ROWS**0.5


def test_rows_with_one_equal_word_have_other_draws(spark):
    df = spark.range(300_000).select(F.col("id").cast("string").alias("k"))
    words = df.withColumn("x", md5_word(F.col("k"), F.lit(42)) % PRIME)
    pairs = words.groupBy("x").agg(F.collect_list("k").alias("ks")).where("size(ks) = 2").limit(5).collect()
    assert pairs
    for r in pairs:
        drawn = with_draws(spark.createDataFrame([(k,) for k in r.ks], "k string"), "k", 50, 42).collect()
        a, b = (np.array([d.u for d in drawn if d.k == k]) for k in r.ks)
        assert len(a) == 50 and (a != b).all() and abs(np.corrcoef(a, b)[0, 1]) < 0.6


def test_constants_stay():
    assert draw_constants(3, 42) == draw_constants(5, 42)[:3] and len(set(draw_constants(200, 42))) == 200


def test_binomial_draws_equal_exact_inversion(spark):
    cases = [(n, p) for n in (1, 2, 7, 40, 300) for p in (0.0, 1e-9, 0.03, 0.5, 0.97, 1.0)]
    df = spark.createDataFrame([(f"{n}/{p}", n, p) for n, p in cases], "k string, n long, p double")
    drawn = binomial_draws(with_tails(df, ["k"], "n", "p"), "k", 30, 42).collect()
    u = {(r.k, r.draw): r.u for r in with_draws(df, "k", 30, 42).collect()}
    assert len(drawn) == 30 * len(cases)
    for r in drawn:
        p = Fraction(r.p)
        pmf = [math.comb(r.n, k) * p**k * (1 - p) ** (r.n - k) for k in range(r.n + 1)]
        tail, hits = Fraction(1), 0
        for k in range(r.n):
            tail -= pmf[k]
            hits += tail > u[r.k, r.draw]
        assert r.hits == hits, r


def test_binomial_draws_of_many_rows(spark):
    df = spark.createDataFrame([("a", 10**9, 0.3), ("b", 10**9, 1e-8)], "k string, n long, p double")
    tails = with_tails(df, ["k"], "n", "p").select("k", F.size("tails")).collect()
    assert max(size for _, size in tails) < 20 * 10**4.5
    hits = binomial_draws(with_tails(df, ["k"], "n", "p"), "k", 400, 42).groupBy("k").agg(F.avg("hits"), F.stddev("hits"))
    found = {r[0]: r[1:] for r in hits.collect()}
    for k, mean, sigma in (("a", 3e8, (1e9 * 0.21) ** 0.5), ("b", 10.0, 10**0.5)):
        assert abs(found[k][0] - mean) < 4 * sigma / 20 and abs(found[k][1] / sigma - 1) < 0.15


def test_interval_costs_draws_per_score(spark):
    rows = spark.range(100_000).selectExpr("id % 2 AS day", "CAST(id AS STRING) AS k", "(id % 50) / 50D AS probability")
    per_score = rows.groupBy("day", "probability").agg(F.count("*").alias("n"), F.min("k").alias("k"))
    drawn = binomial_draws(with_tails(per_score, ["day", "probability"], "n", "probability"), "k", 200, 42)
    assert drawn.count() == 200 * per_score.count() == 10_000
    nulls = rows.select("day", "k", F.lit(None).cast("double").alias("probability"))
    both = [
        sorted(map(tuple, estimation_interval(df.repartition(parts), "day", "k", 0.6).collect()))
        for df, parts in ((rows, 3), (rows.unionByName(nulls), 17))
    ]
    assert both[0] == both[1] and len(both[0]) == 2
