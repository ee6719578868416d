"""Gradient-boosted trees with logistic loss, grown on histograms of binned features, many fits at a time."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.sources.scratch import durable

BINS = 256
SHARD_ROWS = 2_000_000  # distinct rows that one task of a fit holds, at about 100 bytes each
PENALTY = 1.0  # on squared leaf values
LEAST_HESSIAN = 1.0  # of a node's rows
UNIT = 1 << 26  # gradients are whole multiples of 1 / UNIT: sums do not depend on the partitions
LEAST_GAIN = 1e-6

Exchange = Callable[[np.ndarray], np.ndarray]


# ------------------------------------------------------------------------------ bins
def cuts(df: DataFrame, columns: tuple[str, ...], bins: int = BINS) -> list[list[float]]:
    """Ascending cuts of each column; a value belongs to the bin of the number of cuts at or below it.

    A column of at most `bins` values is cut at every value, a richer one at approximate quantiles and
    its largest value, so that a rare extreme keeps a bin.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")
    counts = durable(long.groupBy("feature", "value").agg(F.count("*").alias("n")))
    stats = counts.groupBy("feature").agg(
        F.count("*").alias("values"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.percentile_approx("value", [i / bins for i in range(1, bins)], 100 * bins, ).alias("marks"),
    )
    few = counts.join(F.broadcast(stats.where(F.col("values") <= bins).select("feature")), "feature")
    found: dict[str, set] = {}
    for feature, value in few.select("feature", "value").collect():  # at most `bins` rows a column
        found.setdefault(feature, set()).add(value)
    for r in stats.where(F.col("values") > bins).collect():
        found[r.feature] = {*r.marks, r.high, r.low}
    return [sorted(found.get(c, set()))[1:] for c in columns]


def codes(columns: tuple[str, ...], marks: list[list[float]]) -> Column:
    """The bins of a row's values as one binary: two bytes a column, in order."""
    parts = []
    for c, m in zip(columns, marks):
        bounds = F.from_json(F.lit(json.dumps(m)), "array<double>")
        x = F.col(c).cast("double")
        parts.append(F.lpad(F.hex(F.size(F.filter(bounds, lambda b: b <= x))), 4, "0"))
    return F.unhex(F.concat(*parts))


# ---------------------------------------------------------------------------- growth
def grow(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, widths: list[int], allowed: list[int],
    trees: int, depth: int, rate: float, exchange: Exchange = lambda x: x,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """(feature, bin, gain, value, loss) of each tree, as heaps from place 1; a feature of -1 is no split.

    Every node takes the split of the largest second-order gain over all columns and bins, from sums of
    gradients and hessians that `exchange` adds up over all shards of the fit; ties go to the first
    column and bin. `loss` is the mean loss before the tree.

    Below the root only the child with the smaller hessian is summed, a column at a time: the other is what
    the parent has left. All sums are whole numbers, so the difference is exact.
    """
    n, used = len(label), np.array(allowed)
    wide = np.array([widths[f] for f in allowed])
    offset = np.concatenate([[0], np.cumsum(wide)])
    total = int(offset[-1])
    grid = np.ascontiguousarray(bins[:, used].astype(np.uint16))
    columns = [grid[:, k].astype(np.int64) for k in range(len(used))]
    last = np.zeros(total, bool)
    last[offset[1:] - 1] = True  # no split after a column's last bin
    begin = np.repeat(offset[:-1], wide)
    margin = np.zeros(n)

    def histogram(rows: np.ndarray | None, slot: np.ndarray, slots: int, weights: tuple[np.ndarray, ...]) -> np.ndarray:
        """Sums of the weights per (slot, column, bin) over some rows, or all."""
        flat = np.zeros((len(weights), slots, total), np.int64)
        chosen = weights if rows is None else [w[rows] for w in weights]
        for k, column in enumerate(columns):
            at = slot * wide[k] + (column if rows is None else column[rows])
            for i, w in enumerate(chosen):
                flat[i, :, offset[k] : offset[k + 1]] = np.bincount(at, w, slots * wide[k]).reshape(slots, wide[k])
        return flat

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g = np.rint((p - label) * UNIT) * weight
        h = np.rint(p * (1.0 - p) * UNIT) * weight
        each = np.where(label > 0, np.logaddexp(0.0, -margin), np.logaddexp(0.0, margin))
        totals = exchange(np.array([np.rint(each * UNIT) @ weight, weight.sum()]).astype(np.int64))
        node = np.ones(n, np.int64)
        feature = np.full(1 << depth, -1, np.int64)
        split = np.zeros(1 << depth, np.int64)
        gain = np.zeros(1 << depth)
        value = np.zeros(2 << depth)
        for level in range(depth + 1):
            first = 1 << level
            if level == depth:  # leaves of the last level
                flat = np.stack([np.bincount(node - first, x, first) if n else np.zeros(first) for x in (g, h)])
                gs, hs = exchange(flat.astype(np.int64)) / UNIT
                value[first:] = np.where(hs > 0, -gs / (hs + PENALTY), 0.0)
                break
            if level == 0:
                sums = exchange(histogram(None, np.zeros(n, np.int64), 1, (g, h)))
            else:
                parent = (node >> 1) - (first >> 1)
                rows = np.flatnonzero((node & 1) == lesser[parent])
                part = exchange(histogram(rows, parent[rows], first >> 1, (g, h)))
                both = np.empty((2, first >> 1, 2, total), np.int64)
                of = np.arange(first >> 1)
                both[:, of, lesser], both[:, of, 1 - lesser] = part, sums - part
                sums = both.reshape(2, first, total)
            gs, hs = sums / UNIT
            upto_g, upto_h = gs.cumsum(1), hs.cumsum(1)
            all_g, all_h = gs[:, : wide[0]].sum(1)[:, None], hs[:, : wide[0]].sum(1)[:, None]
            before_g = np.concatenate([np.zeros((first, 1)), upto_g], 1)[:, begin]
            before_h = np.concatenate([np.zeros((first, 1)), upto_h], 1)[:, begin]
            lg, lh = upto_g - before_g, upto_h - before_h
            rg, rh = all_g - lg, all_h - lh
            score = lg**2 / (lh + PENALTY) + rg**2 / (rh + PENALTY) - all_g**2 / (all_h + PENALTY)
            score[(lh < LEAST_HESSIAN) | (rh < LEAST_HESSIAN) | last] = 0.0
            score = np.round(score, 9)
            best = score.argmax(1)
            top = score[np.arange(first), best]
            column = np.searchsorted(offset, best, "right") - 1
            here = slice(first, 2 * first)
            ok = top > LEAST_GAIN
            at_best = np.arange(first), best
            lesser = np.where(ok & (lh[at_best] < rh[at_best]), 0, 1)  # without a split nothing goes right
            feature[here] = np.where(ok, column, -1)
            split[here] = np.where(ok, best - offset[column], 0)
            gain[here] = np.where(ok, top, 0.0)
            of = node
            right = (feature[of] >= 0) & (grid[np.arange(n), np.maximum(feature[of], 0)] > split[of])
            node = 2 * of + right  # without a split all rows go left
        value *= rate
        margin += value[node]
        yield np.where(feature >= 0, used[np.maximum(feature, 0)], -1), split, gain, value, float(totals[0] / UNIT / max(totals[1], 1))


def _allgather(x: np.ndarray) -> np.ndarray:
    """The sum over all tasks of a barrier stage; histograms are mostly zeros and travel compressed."""
    sent = BarrierTaskContext.get().allGather(base64.b64encode(zlib.compress(x.tobytes(), 1)).decode())
    return sum(np.frombuffer(zlib.decompress(base64.b64decode(s)), x.dtype) for s in sent).reshape(x.shape)


def _apart(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers that `repartition(n, ...)` deals to n different tasks. Only the balance depends on it."""
    part = F.pmod(F.hash("id"), F.lit(max(n, 1))).alias("part")
    found = dict(spark.range(100 * n).groupBy(part).agg(F.min("id")).collect())
    return [found.get(i, -1 - i) for i in range(n)]


# ---------------------------------------------------------------------------- models
@dataclass
class Fit:
    """What one model learns from: some columns, and all rows but those of a fold."""

    name: str
    columns: tuple[str, ...]
    without_fold: int | None = None


@dataclass
class Boosted:
    """Trees over `columns`: heaps of split columns, thresholds (at or above goes right), gains and leaf values."""

    columns: tuple[str, ...]
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    value: np.ndarray
    loss: np.ndarray

    def score(self, df: DataFrame, output: str = "probability") -> DataFrame:
        """Add the probability of class 1, in batches and streams alike: a walk of all trees for a whole Arrow
        batch at a time. A row that meets a NULL in a split has none; NaN is larger than any threshold."""
        keep = [F.col(c) for c in df.columns if c != output]
        margin = F.arrow_udf(self._margins(), "double")(*[F.col(c).cast("double") for c in self.columns])
        ready = df.select(*keep, margin.alias("_margin"))
        return ready.select(*keep, (1.0 / (1.0 + F.exp(-F.col("_margin")))).alias(output))

    def _margins(self) -> Callable[..., pa.Array]:
        depth, width = self.depth, 1 << self.depth
        feature, value = np.maximum(self.feature, 0), self.value[:, width:]
        # Infinite thresholds are as large as a double gets.
        limit = np.finfo(np.float64).max
        threshold = np.clip(self.threshold, -limit, limit)

        def margins(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)
            unknown = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns], 1)
            some = unknown.any()
            n = len(x)
            at = np.arange(n)
            total, lost = np.zeros(n), np.zeros(n, bool)
            for t in range(len(feature)):
                i = np.ones(n, np.int64)
                for _ in range(depth):
                    of = feature[t][i]
                    if some:
                        lost |= unknown[at, of]
                    i = 2 * i + ~(x[at, of] < threshold[t][i])
                total += value[t][i - width]
            return pa.array(total, pa.float64(), mask=lost)

        return margins

    def importance(self) -> list[tuple[str, float]]:
        """(column, share): the mean gain of a column's splits, as a share of all columns'."""
        mean = []
        for i in range(len(self.columns)):
            of = self.gain[self.feature == i]
            mean.append(float(of.mean()) if len(of) else 0.0)
        total = sum(mean) or 1.0
        return [(c, m / total) for c, m in zip(self.columns, mean)]

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, feature, threshold, gain, value, loss): the heaps of each tree, a row per tree."""
        return spark.createDataFrame(pa.table({
            "tree": pa.array(range(len(self.feature)), pa.int32()), "feature": pa.array(self.feature.tolist(), pa.list_(pa.int32())),
            "threshold": pa.array(self.threshold.tolist(), pa.list_(pa.float64())), "gain": pa.array(self.gain.tolist(), pa.list_(pa.float64())),
            "value": pa.array(self.value.tolist(), pa.list_(pa.float64())), "loss": pa.array(self.loss, pa.float64()),
        })).withColumn("columns", F.array(*map(F.lit, self.columns)))

    def save(self, spark: SparkSession, path: str) -> None:
        self.table(spark).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Boosted":
        rows = spark.read.parquet(path).orderBy("tree").collect()  # a row per tree
        parts = [np.array([r[c] for r in rows]) for c in ("feature", "threshold", "gain", "value", "loss")]
        return Boosted(tuple(rows[0]["columns"]), len(rows[0]["feature"]).bit_length() - 1, *parts)


def constant(values: list, kind: str) -> Column:
    """A constant array, however long: parsed once, by the optimizer."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def fit_all(
    rows: DataFrame, fits: list[Fit], trees: int, depth: int, rate: float, label: str = "label",
    fold: str = "fold", shard_rows: int = SHARD_ROWS,
) -> dict[str, Boosted]:
    """All fits over `rows` (the columns, a label 0 or 1, a fold), whose columns are cut once.

    Rows with the same bins of a fit's columns, label and fold are one row with a weight. A fit whose distinct rows
    are at most `shard_rows` is one task, and all such fits are one job. Beyond that each fit is a barrier
    stage of as many tasks as it takes; a level's histograms are summed between them. A lost task
    starts its fit again. Sums are exact, so the trees do not depend on how rows are dealt.
    """
    every = tuple(dict.fromkeys(c for f in fits for c in f.columns))
    marks = dict(zip(every, cuts(rows, every)))
    known = F.coalesce(F.col(fold), F.lit(-1)).cast("int") if fold in rows.columns else F.lit(-1)
    packed, size = {}, {}
    for columns in dict.fromkeys(f.columns for f in fits):
        packed[columns] = durable(rows.select(
            codes(columns, [marks[c] for c in columns]).alias("bins"), F.col(label).cast("int").alias("label"), known.alias("fold")
        ).groupBy("bins", "label", "fold").agg(F.count("*").alias("weight")))
        size[columns] = packed[columns].count()
    shape = "fit string, tree int, feature array<int>, split array<int>, gain array<double>, value array<double>, loss double"
    names = [c.split()[0] for c in shape.split(", ")]
    types = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()]

    def learn(fit: Fit, table: pa.Table, exchange: Exchange) -> pa.RecordBatch:
        raw = b"".join(table.column("bins").to_pylist())
        grid = np.frombuffer(raw, ">u2").reshape(-1, len(fit.columns))
        label, weight = (table.column(c).to_numpy().astype(np.float64) for c in ("label", "weight"))
        widths = [len(marks[c]) + 1 for c in fit.columns]
        grown = grow(grid, label, weight, widths, list(range(len(widths))), trees, depth, rate, exchange)
        found = [(fit.name, t, f.tolist(), s.tolist(), g.tolist(), v.tolist(), loss) for t, (f, s, g, v, loss) in enumerate(grown)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * len(types), types)], names)

    alone = {}
    small = sorted((f for f in fits if size[f.columns] <= shard_rows), key=lambda f: -size[f.columns])
    for f, key in zip(small, _apart(rows.sparkSession, len(small))):
        alone[key] = f
    together = None
    for key, f in alone.items():
        part = packed[f.columns] if f.without_fold is None else packed[f.columns].where(F.col("fold") != f.without_fold)
        part = part.select("bins", "label", "weight", F.lit(key).cast("long").alias("at"))
        together = part if together is None else together.unionByName(part)
    found = [] if together is None else [together.repartition(len(alone), "at").groupBy("at").applyInArrow(
        lambda key, table: pa.Table.from_batches([learn(alone[key[0].as_py()], table, lambda x: x)]), shape
    ).toArrow()]  # a row per tree, packed
    for f in (f for f in fits if size[f.columns] > shard_rows):
        def run(parts: Iterator[pa.RecordBatch], fit: Fit = f) -> Iterator[pa.RecordBatch]:
            mine = learn(fit, pa.Table.from_batches(list(parts), empty), _allgather)
            if BarrierTaskContext.get().partitionId() == 0:  # all shards have grown the same trees
                yield mine

        empty = pa.schema([("bins", pa.binary()), ("label", pa.int32()), ("weight", pa.int64())])
        part = packed[f.columns] if f.without_fold is None else packed[f.columns].where(F.col("fold") != f.without_fold)
        shards = ceil(size[f.columns] / shard_rows)
        found.append(part.select("bins", "label", "weight").repartition(shards).mapInArrow(run, shape, barrier=True).toArrow())
    models, grown = {}, pa.concat_tables(found) if found else None
    for f in fits:
        mine = grown.filter(pc.equal(grown["fit"], f.name)).sort_by("tree") if found else []
        if not len(mine):  # a fit without rows knows nothing: one leaf of 0
            none = (1 << depth)
            mine = pa.table(dict(zip(names, ([f.name], [0], [[-1] * none], [[0] * none], [[0.0] * none], [[0.0] * 2 * none], [0.0]))))
        feature, split, gain, value = (
            mine[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1) for c in names[2:6])
        loss = mine["loss"].to_numpy()
        threshold = np.full(feature.shape, np.inf)
        for t, i in zip(*np.nonzero(feature >= 0)):
            threshold[t, i] = marks[f.columns[feature[t, i]]][split[t, i]]
        models[f.name] = Boosted(f.columns, depth, feature, threshold, gain, value, loss)
    return models
