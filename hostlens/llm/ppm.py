"""Language-model scoring by prediction by partial matching over bytes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, id_and_text
from hostlens.sources.scratch import durable

EDGE = 256  # the symbol before the first byte and after the last
BASE = 257
ORDER = 3  # bytes of context


def grams_of(data: bytes) -> np.ndarray:
    """One number per coded symbol (each byte, then the edge): three symbols of context and itself,
    as two halves (first pair, second pair) in base 257."""
    s = np.empty(len(data) + ORDER + 1, np.int32)
    s[:ORDER] = EDGE
    s[ORDER:-1] = np.frombuffer(data, np.uint8)
    s[-1] = EDGE
    return s[:-1] * BASE + s[1:]  # pair k covers symbols k and k + 1


class _Chunk:
    """Distinct four-symbol grams of a chunk of documents, with counts of the training ones, in a
    square over the pairs that occur."""

    def __init__(self, texts: list[bytes]):
        seen = np.zeros(BASE * BASE, bool)
        for t in texts:
            seen[grams_of(t)] = True
        self.pairs = np.flatnonzero(seen)
        self.number = np.zeros(BASE * BASE, np.int64)
        self.number[self.pairs] = np.arange(len(self.pairs))

    def cells(self, data: bytes) -> np.ndarray:
        p = self.number[grams_of(data)]
        return p[:-2] * len(self.pairs) + p[2:]

    def grams(self, cells: np.ndarray) -> np.ndarray:
        n = len(self.pairs)
        return self.pairs[cells // n] * BASE * BASE + self.pairs[cells % n]


BLOCK = 1 << 22


def _counts(chunk: _Chunk, texts: list[bytes], train: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """(cells, training counts) of all grams of the texts, sorted by cell; memory follows the grams."""
    cells, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal cells, counts, held, size
        every = np.concatenate([cells, *(c for c, _ in held)])
        weight = np.concatenate([counts, *(w for _, w in held)])
        order = np.argsort(every, kind="stable")
        every, weight = every[order], weight[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        cells, counts = every[first], np.add.reduceat(weight, first) if len(first) else weight
        held, size = [], 0

    area = len(chunk.pairs) ** 2
    if area <= 1 << 24:  # few pairs, as in alphabets: count in the square itself
        dense, there = np.zeros(area, np.int32), np.zeros(area, bool)
        for data, learn in zip(texts, train):
            at = chunk.cells(data)
            for k in range(0, len(at), BLOCK):
                there[at[k : k + BLOCK]] = True
                if learn:
                    np.add.at(dense, at[k : k + BLOCK], 1)
        cells = np.flatnonzero(there)
        return cells, dense[cells].astype(np.int64)
    for data, learn in zip(texts, train):
        at, n = np.unique(chunk.cells(data), return_counts=True)
        held.append((at, n if learn else np.zeros(len(n), np.int64)))
        size += len(at)
        if size > BLOCK:
            fold()
    fold()
    return cells, counts


def is_training(doc_id: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds != held, F.lit(True))


def chunks(rows: DataFrame) -> DataFrame:
    """Rows of three kinds from (doc_id, train, text): per document (chunk, doc_id, train, packed),
    per chunk its distinct words and grams with their counts in training documents. A chunk is one
    Arrow batch, bounded in bytes."""
    arrow_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"chunk string, doc_id {kind}, train boolean, packed binary, words array<binary>, "
        "word_counts array<long>, grams array<long>, gram_counts array<long>"
    )

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, part in enumerate(parts):
            chunk, k = f"{task}-{n}", part.num_rows
            train = part.column("train").to_pylist()
            texts = [t.as_py().encode("utf-8", "surrogatepass").lower() for t in part.column("text")]
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * k), ids, part.column("train"),
                 pa.array([zstandard.compress(t, 1) for t in texts], pa.binary()),
                 pa.nulls(k, pa.list_(pa.binary())), *[pa.nulls(k, pa.list_(pa.int64()))] * 3],
                names,
            )
            learnt: Counter[bytes] = Counter()
            words: set[bytes] = set()
            for t, learn in zip(texts, train):
                (learnt if learn else words).update(t.split())
            words.difference_update(learnt)
            every = [*learnt, *words]
            square = _Chunk(texts)
            cells, counts = _counts(square, texts, train)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk]), pa.nulls(1, ids.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()),
                 pa.array([every], pa.list_(pa.binary())),
                 pa.array([[*learnt.values(), *[0] * len(words)]], pa.list_(pa.int64())),
                 pa.array([square.grams(cells)], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int64()))],
                names,
            )

    names = [c.split()[0] for c in schema.split(", ")]
    return rows.select("doc_id", "train", "text").mapInArrow(run, schema)


def trie(grams: DataFrame) -> list[DataFrame]:
    """Context trie of orders 0 to ORDER from (gram, n): for each order (gram, n, total, distinct,
    inner), where gram is context and symbol, total and distinct belong to the context's node, and
    inner is the count that the node's symbols have one order lower: what an escape from this node
    excludes there."""
    levels = [grams.groupBy("gram").agg(F.sum("n").alias("n"))]
    for k in range(ORDER, 0, -1):
        levels.append(levels[-1].groupBy((F.col("gram") % BASE**k).alias("gram")).agg(F.sum("n").alias("n")))
    levels = levels[::-1]
    out = []
    for k, level in enumerate(levels):
        if k:
            low = levels[k - 1].select(F.col("gram").alias("short"), F.col("n").alias("inner"))
            level = level.withColumn("short", F.col("gram") % BASE**k).join(low, "short")
        else:
            level = level.withColumn("inner", F.lit(0).cast("long"))
        nodes = level.groupBy(_div(F.col("gram"), BASE).alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), F.sum("inner").alias("inner")
        )
        out.append((level.select("gram", "n"), nodes))
    return out


def _div(a: Column, b: int) -> Column:
    return F.floor((a - a % b) / b).cast("long")


def gram_costs(wanted: DataFrame, levels: list) -> DataFrame:
    """(gram, cost): log10 of the probability of the gram's symbol after its context.

    From the longest context that occurs in training: escape probability by method C (distinct
    symbols / (total + distinct)); a symbol seen in a longer context is excluded from all shorter
    ones; below order 0 the symbols not yet seen share the rest evenly.
    """
    df = wanted.select("gram")
    for k in range(ORDER, -1, -1):
        edges, nodes = levels[k]
        df = df.withColumn(f"g{k}", F.col("gram") % BASE ** (k + 1)).withColumn(f"c{k}", _div(F.col(f"g{k}"), BASE))
        df = df.join(edges.select(F.col("gram").alias(f"g{k}"), F.col("n").alias(f"n{k}")), f"g{k}", "left").join(
            nodes.select(
                F.col("context").alias(f"c{k}"), F.col("total").alias(f"t{k}"),
                F.col("distinct").alias(f"d{k}"), F.col("inner").alias(f"i{k}"),
            ), f"c{k}", "left",
        )
    zero = F.lit(0).cast("long")
    escape, cost = F.lit(0.0), F.lit(None).cast("double")
    for k in range(ORDER, -1, -1):
        out_n, out_d = (F.coalesce(f"i{k + 1}", zero), F.coalesce(f"d{k + 1}", zero)) if k < ORDER else (zero, zero)
        distinct = (F.coalesce(f"d{k}", zero) - out_d).cast("double")
        whole = (F.coalesce(f"t{k}", zero) - out_n).cast("double") + distinct
        seen = F.col(f"n{k}").isNotNull()
        cost = F.when(cost.isNotNull(), cost).when(seen, escape + F.log10(F.col(f"n{k}") / whole))
        escape = escape + F.when(distinct > 0, F.log10(distinct / whole)).otherwise(0.0)
    rest = F.lit(BASE) - F.coalesce("d0", zero)
    return df.select("gram", F.coalesce(cost, escape - F.log10(rest.cast("double"))).alias("cost"))


def score_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Trained on all documents whose crc32(doc_id) mod `folds` is not `held`. `base_score` is the
    add-one unigram score over words and one end token; `score` the PPM code length as log10 of the
    probability of the lower-cased bytes and the end. Counts of the whole corpus are summed in
    tables; each chunk of documents gets the values of just its own distinct words and grams. NULL
    texts count as empty: one end token. A NULL doc_id is in training. Without training rows all
    symbols are equally likely.
    """
    rows = id_and_text(docs, doc_id, text)
    rows = rows.withColumn("train", is_training(F.col("doc_id"), folds, held))
    stored = durable(chunks(rows), compression="zstd")
    parts = stored.where("words IS NOT NULL")
    words = parts.select("chunk", F.explode(F.arrays_zip("words", "word_counts")).alias("w")).select(
        "chunk", F.col("w.words").alias("word"), F.col("w.word_counts").alias("n")
    )
    grams = parts.select("chunk", F.explode(F.arrays_zip("grams", "gram_counts")).alias("g")).select(
        "chunk", F.col("g.grams").alias("gram"), F.col("g.gram_counts").alias("n")
    )
    learnt = durable(words.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")))
    ends = stored.where("packed IS NOT NULL AND train").count()
    total, distinct = learnt.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    levels = trie(durable(grams.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n"))))
    levels = [(durable(edges), durable(nodes)) for edges, nodes in levels]
    costs = durable(gram_costs(grams.select("gram").distinct(), levels))
    values = words.join(learnt, "word").select(
        F.col("chunk").alias("of_chunk"), "word", F.lit(0).cast("long").alias("gram"), F.col("c").cast("double").alias("value")
    ).union(grams.join(costs, "gram").select("chunk", F.lit(None).cast("binary"), "gram", "cost"))
    out = stored.where("packed IS NOT NULL").select("chunk", "doc_id", "train", "packed")
    kind = out.schema["doc_id"].dataType.simpleString()
    below = float(np.log10(total + distinct + 1))
    end = float(np.log10(ends + 1))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        word, value = right.column("word").to_pylist(), right.column("value").to_numpy()
        is_word = right.column("word").is_valid().to_numpy()
        logs = np.log10(value[is_word] + 1.0).tolist()
        known = dict(zip([w for w in word if w is not None], logs))
        gram, cost = right.column("gram").to_numpy()[~is_word], value[~is_word]
        texts = [zstandard.decompress(p) for p in left.column("packed").to_pylist()]
        square = _Chunk(texts)
        n = len(square.pairs)
        cell = square.number[gram // BASE**2] * n + square.number[gram % BASE**2]
        dense = None
        if n * n <= 1 << 24:
            dense = np.zeros(n * n)
            dense[cell] = cost
        else:
            order = np.argsort(cell)
            cell, cost = cell[order], cost[order]
        res = {"tokens": [], "known": [], "base": [], "score": []}
        for data in texts:
            found = [known[w] for w in data.split() if w in known]
            tokens = len(data.split()) + 1
            at = square.cells(data)
            got = dense[at] if dense is not None else cost[np.searchsorted(cell, at)]
            res["tokens"].append(tokens)
            res["known"].append(len(found) + (ends > 0))
            res["base"].append(float(np.sum(found)) + end - tokens * below)
            res["score"].append(float(got.sum()))
        train = left.column("train")
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": pa.array([not t for t in train.to_pylist()]),
            "n_tokens": pa.array(res["tokens"], pa.int64()), "n_known": pa.array(res["known"], pa.int64()),
            "train_tokens": pa.array([total] * left.num_rows, pa.int64()),
            "base_score": pa.array(res["base"], pa.float64()), "score": pa.array(res["score"], pa.float64()),
        })

    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return out.groupBy("chunk").cogroup(values.groupBy("of_chunk")).applyInArrow(run, schema)
