"""Label-free (confidence-based) and realized performance per group of rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.functions.urlshape import md5_word

PRIME = 2**31 - 1


def estimated(p: Column, flagged: Column) -> list[Column]:
    """Expected precision and recall from the scores alone, as aggregate expressions."""
    tp = F.sum(F.when(flagged, p).otherwise(0.0))
    fp = F.sum(F.when(flagged, 1 - p).otherwise(0.0))
    fn = F.sum(F.when(flagged, 0.0).otherwise(p))
    zero = F.lit(0.0)
    return [
        (tp / F.nullif(tp + fp, zero)).alias("est_precision"),
        (tp / F.nullif(tp + fn, zero)).alias("est_recall"),
    ]


def realized(flagged: Column, label: Column) -> list[Column]:
    """Precision and recall from the labels, as aggregate expressions."""
    tp = F.sum((flagged & (label == 1)).cast("bigint"))
    n_flagged = F.sum(flagged.cast("bigint"))
    n_pos = F.sum((label == 1).cast("bigint"))
    none = F.lit(0).cast("bigint")
    return [
        (tp / F.nullif(n_flagged, none)).alias("real_precision"),
        (tp / F.nullif(n_pos, none)).alias("real_recall"),
    ]


def draw_constants(draws: int, seed: int) -> list[tuple[int, int, int]]:
    """(slope, shift, mix) of each draw's map modulo PRIME."""

    def word(name: str, draw: int) -> int:
        return int(hashlib.md5(f"{name}|{draw}|{seed}".encode()).hexdigest()[:8], 16)

    return [
        (word("slope", d) % (PRIME - 1) + 1, word("shift", d) % PRIME, word("mix", d) % PRIME) for d in range(draws)
    ]


def _draws(key: str, draws: int, seed: int) -> Column:
    """Array of (draw, u): u uniform in [0, 1) per draw. The row's key is hashed once, to two words x and y
    below a prime; draw (a, b, c) is ((a x + b) y + c x) modulo the prime. Rows share their draws only if
    they share both words (61 bits), and the product keeps draws off common lines and planes."""
    constants = draw_constants(draws, seed)
    maps = F.arrays_zip(*[F.lit([m[i] for m in constants]).alias(name) for i, name in enumerate("abc")])
    maps = maps.cast("array<struct<a:bigint,b:bigint,c:bigint>>")
    x, y = (md5_word(F.col(key), F.lit(seed), at=i) % PRIME for i in (0, 1))

    def uniform(w: Column, m: Column) -> Column:
        return ((w["x"] * m["a"] + m["b"]) % PRIME * w["y"] + w["x"] * m["c"]) % PRIME / F.lit(float(PRIME))

    words = F.array(F.struct(x.alias("x"), y.alias("y")))
    return F.flatten(F.transform(words, lambda w: F.transform(
        maps, lambda m, i: F.struct(i.alias("draw"), uniform(w, m).alias("u"))
    )))


def with_draws(df: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Each row once per draw, with `draw` and `u` uniform in [0, 1)."""
    rows = df.select("*", F.explode(_draws(key, draws, seed)).alias("_d"))
    return rows.select(*df.columns, "_d.draw", "_d.u")


def low_draws(df: DataFrame, key: str, bound: str, draws: int, seed: int) -> DataFrame:
    """(key, draw, u) of the draws whose u is below the row's `bound`; the others are never written or kept.

    The draws are those of `_draws`, one at a time behind an `explode` of the maps: there they are generated
    code, while functions over arrays are interpreted and build an object for each draw.
    """
    constants = F.array(*[
        F.struct(*[F.lit(v).cast(kind).alias(n) for n, kind, v in zip(("draw", "a", "b", "c"), ("int", *["bigint"] * 3), (i, *m))])
        for i, m in enumerate(draw_constants(draws, seed))
    ])
    x, y = (md5_word(F.col(key), F.lit(seed), at=i) % PRIME for i in (0, 1))
    rows = df.select(key, F.col(bound).alias("_bound"), x.alias("_x"), y.alias("_y"))
    rows = rows.select("*", F.explode(constants).alias("_m"))
    u = ((F.col("_x") * F.col("_m.a") + F.col("_m.b")) % PRIME * F.col("_y") + F.col("_x") * F.col("_m.c")) % PRIME
    return rows.select(key, F.col("_m.draw").alias("draw"), (u / F.lit(float(PRIME))).alias("u"), "_bound").where(
        "u < _bound").select(key, "draw", "u")


def with_tails(groups: DataFrame, by: list[str], n: str, p: str) -> DataFrame:
    """Add `lo` and `tails` to one row per `by`: of a binomial (n, p), `tails[i]` is the probability of more
    than lo + i hits. What lies beyond nine deviations and 20 hits weighs under 1e-17 and is left out, so
    that a row holds about 18 sqrt(n) entries at most.

    The weights follow from the ratios of neighbours, relative to the largest; `by` is the partitioning of
    the groups already, so nothing more is shuffled.
    """
    count, share = F.col(n), F.col(p)
    mean, reach = count * share, F.sqrt(count * share * (1 - share)) * 9 + 20
    sure = (share <= 0) | (share >= 1)
    lo = F.when(sure, F.when(share > 0, count).otherwise(0)).otherwise(F.greatest(F.floor(mean - reach), F.lit(0)))
    hi = F.when(sure, F.col("lo")).otherwise(F.least(F.ceil(mean + reach), count))
    k = F.col("_k")
    rows = groups.withColumn("lo", lo.cast("bigint")).withColumn("_k", F.explode(F.sequence("lo", hi.cast("bigint"))))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    ratio = F.when(k > F.col("lo"), F.log((count - k + 1) / k) + F.log(share) - F.log(1 - share)).otherwise(0.0)
    rows = rows.withColumn("_log", F.sum(ratio).over(upto))
    rows = rows.withColumn("_w", F.exp(F.col("_log") - F.max("_log").over(group)))
    total, below = F.sum("_w").over(group), F.sum("_w").over(upto) - F.col("_w")
    rows = rows.withColumn("_tail", F.when(k > F.col("lo"), F.struct("_k", ((total - below) / total).alias("t"))))
    kept = [F.first(c).alias(c) for c in (*groups.columns, "lo") if c not in by]
    tails = F.array_sort(F.collect_list("_tail")).alias("_tails")
    return rows.groupBy(*by).agg(*kept, tails).withColumn("tails", F.col("_tails.t")).drop("_tails")


def binomial_draws(groups: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Each row of `with_tails` once per draw, with `draw` and `hits`: lo and the tails above the draw's
    uniform, found by binary search. The uniforms are those of the row's `key`."""
    powers = F.lit([1 << i for i in reversed(range(31))])
    steps = F.filter(powers, lambda step: step <= F.size("tails"))

    def hits(u: Column) -> Column:
        def further(found: Column, step: Column) -> Column:
            # Past the end there is no tail.
            above = F.coalesce(F.get("tails", found + step - 1) > u, F.lit(False))
            return F.when(above, found + step).otherwise(found)

        return F.col("lo") + F.aggregate("_steps", F.lit(0), further)

    drawn = F.transform(_draws(key, draws, seed), lambda d: F.struct(d["draw"].alias("draw"), hits(d["u"]).alias("hits")))
    rows = groups.withColumn("_steps", steps).select(*groups.columns, F.explode(drawn).alias("_d"))
    return rows.select(*[c for c in groups.columns if c not in ("lo", "tails")], "_d.draw", "_d.hits")


def estimation_interval(
    df: DataFrame, by: str, key: str, threshold, draws: int = 200, seed: int = 42,
    score: str = "probability",
) -> DataFrame:
    """95% interval of the estimates: labels drawn `draws` times from the scores.

    Rows of equal score are drawn together: their positives are a binomial number, by inversion of one
    uniform per (group, score, draw), keyed by the smallest `key` among them. The work is draws x distinct
    scores; it is summed per (group, draw) before the shuffle. Rows without a score take no part.
    """
    p = F.col("_p")
    rows = df.select(F.col(by).alias("_by"), F.col(key).alias("_key"), F.col(score).cast("double").alias("_p"))
    scores = rows.where(p.isNotNull()).groupBy("_by", "_p").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("_key"))
    drawn = binomial_draws(with_tails(scores, ["_by", "_p"], "n", "_p"), "_key", draws, seed)
    flagged = p >= threshold
    per_draw = drawn.groupBy("_by", "draw").agg(
        F.sum(F.when(flagged, F.col("hits")).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("flagged"),
        F.sum("hits").alias("positive"),
    )
    one = F.lit(1).cast("bigint")
    ratios = per_draw.select(
        F.col("_by").alias(by),
        (F.col("tp") / F.greatest("flagged", one)).alias("precision"),
        (F.col("tp") / F.greatest("positive", one)).alias("recall"),
    )
    return ratios.groupBy(by).agg(
        F.percentile("precision", F.lit(0.025)).alias("est_precision_low"),
        F.percentile("precision", F.lit(0.975)).alias("est_precision_high"),
        F.percentile("recall", F.lit(0.025)).alias("est_recall_low"),
        F.percentile("recall", F.lit(0.975)).alias("est_recall_high"),
    )
