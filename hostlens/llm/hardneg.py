"""Hard negatives of a query set by exact integer inner products, many candidates to one wide integer."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sumprod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from hostlens.llm.common import arrow_batches
from hostlens.sources.scratch import durable, scratch_path

SCALE = 256
PACK = 1024  # candidates in one wide integer
ANCHORS = 4096  # anchors that one pass over the candidates carries
TASK_ROWS = 65_536  # candidates of one task on large inputs
SMALL_TASK_ROWS = 2048  # on inputs too small to give every core a task of TASK_ROWS


# ------------------------------------------------------------------ packed products
def quantize(vectors: list, width: int, scale: int = SCALE) -> list[list[int]]:
    """Components floor(scale * x), x as double; a vector shorter than `width` counts as padded with 0."""
    out = []
    for v in vectors:
        q = [int(x) for x in np.floor(scale * np.asarray(v, np.float64))]
        out.append(q + [0] * (width - len(q)))
    return out


class Pack:
    """Some candidates' biased components side by side: field c of `wide[j]` is component j of candidate c."""

    def __init__(self, rows: list[list[int]], least: int, field: int):
        self.n, self.least, self.field = len(rows), least, field
        biased = [[x - least for x in r] for r in rows]
        columns = list(zip(*biased))
        if field in (4, 8):
            self.wide = [int.from_bytes(np.array(c, f"<u{field}").tobytes(), "little") for c in columns]
        else:
            self.wide = [int.from_bytes(b"".join(x.to_bytes(field, "little") for x in c), "little") for c in columns]
        self.sums = _longs([sum(r) for r in biased])

    def scores(self, biased: list[int], bias: int) -> np.ndarray:
        """Exact inner products of (biased + bias) with every candidate: one product of a component with
        a wide integer per component, whose fields cannot run over, then the biases taken back."""
        total = sumprod(biased, self.wide).to_bytes(self.field * self.n, "little")
        if self.field in (4, 8):
            fields = np.frombuffer(total, f"<u{self.field}").astype(np.int64)
        else:
            fields = _longs([
                int.from_bytes(total[i : i + self.field], "little") for i in range(0, len(total), self.field)
            ])
        return fields + (self.least * sum(biased) + len(biased) * bias * self.least) + bias * self.sums


def _longs(values: list[int]) -> np.ndarray:
    return np.array(values, np.int64)  # raises OverflowError beyond a long


def field_bytes(width: int, anchor_span: int, candidate_span: int, scores: int) -> int:
    """Bytes of a field that holds any biased product; OverflowError where a score can leave a long."""
    if scores >= 1 << 62:
        raise OverflowError("inner products beyond a long")
    need = (max(width, 1) * anchor_span * candidate_span).bit_length()
    return 4 if need <= 32 else 8 if need <= 63 else ceil(need / 8)


def _packs(rows: list[list[int]], anchors: list[list[int]], width: int, pack: int) -> tuple[list[Pack], int]:
    """Packs of the rows, and the anchors' bias, from the values that occur."""
    lo = min((min(r) for r in rows if r), default=0)
    hi = max((max(r) for r in rows if r), default=0)
    bias = min((min(a) for a in anchors if a), default=0)
    top = max((max(a) for a in anchors if a), default=0)
    largest = width * max(abs(lo), abs(hi), hi - lo, 1) * max(abs(bias), abs(top), top - bias, 1)
    field = field_bytes(width, top - bias, hi - lo, largest)
    return [Pack(rows[i : i + pack], lo, field) for i in range(0, len(rows), pack)], bias


# ---------------------------------------------------------------------------- tasks
class _Block:
    """The anchors of one pass, as plain integers, by label."""

    def __init__(self, rows, width: int, scale: int, pack: int):
        self.pack = pack
        self.row = [r.row for r in rows]
        self.label = [r.label for r in rows]
        self.width = width
        self.vec = quantize([r.vec for r in rows], width, scale)
        self.scale = scale


def _candidates(parts, block: _Block):
    """All rows of the task by label: ids, row numbers and quantized vectors, ids ascending."""
    ids, rows, labels, vecs = [], [], [], []
    for part in parts:
        ids += part.column("id").to_pylist()
        rows += part.column("row").to_pylist()
        labels += part.column("label").to_pylist()
        vecs += quantize(part.column("vec").to_pylist(), block.width, block.scale)
    order = sorted(range(len(ids)), key=lambda i: (ids[i], rows[i]))
    by_label: dict = {}
    for i in order:
        by_label.setdefault(labels[i], []).append(i)
    for label, at in by_label.items():
        yield label, np.array([ids[i] for i in at], np.int64), np.array([rows[i] for i in at], np.int64), [vecs[i] for i in at]


def _scored(parts, block: _Block, same: bool):
    """(anchor number, ids, rows, scores) for each anchor and pack of candidates whose label is, or is
    not, the anchor's. The scores come best first, ties by id."""
    for label, ids, rows, vecs in _candidates(parts, block):
        mine = [a for a, x in enumerate(block.label) if (x == label) == same]
        if not mine:
            continue
        packs, bias = _packs(vecs, [block.vec[a] for a in mine], block.width, block.pack)
        for a in mine:
            biased = [x - bias for x in block.vec[a]]
            for k, pack in enumerate(packs):
                scores = pack.scores(biased, bias)
                order = np.argsort(-scores, kind="stable")
                at = order + k * block.pack
                yield a, ids[at], rows[at], scores[order]


def _best(found: dict, key, new: list, most: int) -> None:
    found[key] = sorted(found.get(key, []) + new)[:most]


def _emit(found: dict, names: list[str]) -> pa.RecordBatch:
    rows = [(*key, -s, i, r) for key, best in found.items() for s, i, r in best]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _positives(block: _Block, most: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for a, ids, rows, scores in _scored(parts, block, True):
            first = [x for x in zip((-scores[: most + 1]).tolist(), ids[: most + 1].tolist(), rows[: most + 1].tolist())
                     if x[2] != block.row[a]][:most]
            _best(found, (block.row[a],), first, most)
        yield _emit(found, ["anchor_row", "score", "id", "row"])

    return run


def _negatives(block: _Block, wanted: dict[int, list[tuple[int, int]]], low: int, high: int, most: int):
    """`wanted`: (number, score) of the positives of each anchor's row."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for a, ids, rows, scores in _scored(parts, block, False):
            for number, score in wanted.get(block.row[a], ()):
                # 100 * negative <= high * positive, in whole numbers, is negative <= floor(high * positive / 100).
                begin = int(np.searchsorted(-scores, -(high * score // 100)))
                end = min(begin + most, int(np.searchsorted(-scores, low * score // -100, side="right")))
                if begin < end:
                    new = list(zip((-scores[begin:end]).tolist(), ids[begin:end].tolist(), rows[begin:end].tolist()))
                    _best(found, (block.row[a], number), new, most)
        yield _emit(found, ["anchor_row", "number", "score", "id", "row"])

    return run


# ------------------------------------------------------------------------- operator
def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding",
    label: str = "label", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = SCALE, anchors: int = ANCHORS, pack: int = PACK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and
    each of its best `positives` other rows of the same label, the best `negatives` rows of another label
    whose score is from `low` to `high` percent of the positive's.

    Scores are inner products of floor(scale * x); higher first, ties by smaller id, then by the row's
    place in the input. Every row is a row of its own: repeated rows, and rows that share an id, compete
    one by one, and an anchor is only not its own positive. Rows with a NULL id, label or vector, or a
    NULL or non-finite component take no part. Vectors of different lengths count as padded with zeros.
    Scores that could leave a long end the job with an OverflowError. No rows or anchors give no rows.

    The anchors are a query set: `anchors` of them at a time go to all tasks, which multiply them with
    their packed candidates and keep the best few; the rest is a grouped top-k over what tasks kept.
    First the rows of the anchor's label, then the others, so that every product is formed once.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    ids, vec, names = F.col(f"`{vec_id}`").cast("long"), F.col(f"`{embedding}`"), F.col(f"`{label}`").cast("long")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = vectors.select(
        ids.alias("id"), names.alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    n = whole.count()
    parts = max(ceil(n / TASK_ROWS), min(2 * spark.sparkContext.defaultParallelism, ceil(n / SMALL_TASK_ROWS)), 1)
    rows = durable(whole.repartition(parts).withColumn("row", F.monotonically_increasing_id()))
    n_anchors, width = rows.agg(
        F.count(F.when(F.col("is_anchor"), 1)), F.coalesce(F.max(F.size("vec")), F.lit(0))
    ).first()
    blocks = max(ceil(n_anchors / anchors), 1)
    spread = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
    path = scratch_path(spark, "anchors")
    rows.where("is_anchor").withColumn("block", spread).write.partitionBy("block").parquet(path)
    queries = spark.read.schema(StructType([*rows.schema, StructField("block", IntegerType())])).parquet(path)
    candidates = rows.select("row", "id", "label", "vec")
    anchor_ids = rows.where("is_anchor").select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"))
    best = [F.col("score").desc(), "id", "row"]
    out = scratch_path(spark, "negatives")
    for b in range(blocks):
        # About `anchors` rows: the queries' bounded block.
        block = _Block(queries.where(F.col("block") == b).collect(), width, scale, pack)
        first = candidates.mapInArrow(_positives(block, positives), "anchor_row long, score long, id long, row long")
        near = durable(first.withColumn(
            "number", F.row_number().over(Window.partitionBy("anchor_row").orderBy(*best))
        ).where(F.col("number") <= positives))
        wanted: dict = {}
        for r in near.select("anchor_row", "number", "score").collect():  # `positives` rows for each of the block
            wanted.setdefault(r.anchor_row, []).append((r.number, r.score))
        kept = candidates.mapInArrow(
            _negatives(block, wanted, low, high, negatives), "anchor_row long, number long, score long, id long, row long"
        )
        ranked = kept.withColumn(
            "rank", F.row_number().over(Window.partitionBy("anchor_row", "number").orderBy(*best))
        ).where(F.col("rank") <= negatives)
        ranked.select(
            "anchor_row", F.col("number").cast("int"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
        ).join(
            near.select("anchor_row", "number", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")),
            ["anchor_row", "number"],
        ).write.mode("append").parquet(out)
    shape = ("anchor_row long, number int, rank int, negative_id long, negative_score long, positive_id long, "
             "positive_score long")
    found = spark.read.schema(shape).parquet(out)
    return found.join(anchor_ids, "anchor_row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
