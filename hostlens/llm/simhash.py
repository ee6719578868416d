"""Near-duplicate groups by SimHash and a table of distances to pivots."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, give_back, id_and_text, lookup, text_or_empty
from hostlens.llm.graph import components
from hostlens.sources.scratch import durable

MAX_BITS = 4
WORDS = 4
SEED = 42
PIVOTS = 16
BUCKET = 1024  # larger buckets are joined through midpoints instead of pairs


def shingles(text: str, words: int, seed: int = SEED) -> list[int]:
    """Hashes of the text's word shingles; a text of fewer words is one."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII blanks
    if not tokens:
        return []
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return [xxhash.xxh64_intdigest(joined, seed)]
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], seed) for i, j in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of the text's word shingles; 0 without a word."""
    if not (hashes := shingles(text, words, seed)):
        return 0
    block = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    set_in = np.zeros(64, np.int64)
    for i in range(0, len(block), 1 << 16):
        set_in += np.unpackbits(block[i : i + (1 << 16)], axis=1, bitorder="little").sum(0, np.int64)
    return int(np.packbits(set_in * 2 > len(block), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) per row; fp holds the 64 bits as a long."""
    arrow_batches(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            bits = np.array([fingerprint(t.as_py()) for t in part.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(bits.view(np.int64))],
                ["doc_id", "text_hash", "fp"],
            )
            give_back()

    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the hashes of their numbers."""
    return [_signed(xxhash.xxh64_intdigest(str(i).encode(), SEED)) for i in range(n)]


def _distance(a: Column, b) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def with_pivot_table(df: DataFrame, n: int = PIVOTS) -> DataFrame:
    """Distances of `fp` to n pivots, eight to a long (`far0`, `far1`, ...)."""
    refs = pivots(n)
    for k in range(0, n, 8):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(refs[k : k + 8]):
            packed = packed.bitwiseOR(F.shiftleft(_distance(F.col("fp"), F.lit(p)).cast("long"), 8 * i))
        df = df.withColumn(f"far{k // 8}", packed)
    return df


def _within(n: int = PIVOTS, bits: int = MAX_BITS) -> Column:
    """No pivot tells the pair (x, y) apart: the largest difference of coordinates is at most bits."""
    ok = F.lit(True)
    for i in range(n):
        at = [F.shiftright(F.col(f"{s}.far{i // 8}"), 8 * (i % 8)).bitwiseAND(F.lit(255)) for s in "xy"]
        ok = ok & (F.abs(at[0] - at[1]) <= bits)
    return ok


def _blocks(distinct: int, bits: int) -> tuple[int, int]:
    """(blocks, equal ones): a pair within `bits` differences agrees on `equal` of the blocks. More
    blocks give longer keys and so smaller buckets, for more copies; any choice finds every pair."""
    equal = 2
    while equal < 4 and distinct > 16 << (64 * equal // (equal + bits)):
        equal += 1
    return equal + bits, equal


def links(points: DataFrame, bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct `fp` within `bits` bits.

    Pairs meet where some of the blocks that the 64 bits are cut into agree, are discarded by the
    pivot table, and verified by their own distance. Fingerprints in a bucket of more than `bucket`
    are linked without pairs: two fingerprints within 4 bits have a common midpoint within 2 bits of
    each, so all variants with at most 2 changed bits are grouped, and every group (all of it within
    4 bits) is a star. Nothing is left out, and no group's pairs are listed.
    """
    blocks, equal = _blocks(points.count(), bits)
    cut = [64 * i // blocks for i in range(blocks + 1)]
    parts = [
        F.shiftright("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(cut, cut[1:])
    ]
    keys = []
    for t, chosen in enumerate(combinations(range(blocks), equal)):
        key = F.lit(t).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cut[i + 1] - cut[i]).bitwiseOR(parts[i])
        keys.append(key)
    keyed = with_pivot_table(points).withColumn("key", F.explode(F.array(*keys)))
    crowded = durable(keyed.groupBy("key").count().where(F.col("count") > bucket))
    many = crowded.count()
    if many:
        keyed = keyed.join(crowded.select("key"), "key", "left_anti")
    near = (
        keyed.alias("x").join(
            keyed.alias("y"),
            (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _within(bits=bits)
            & (_distance(F.col("x.fp"), F.col("y.fp")) <= bits),
        )
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    )
    if not many:
        return near
    dense = points.withColumn("key", F.explode(F.array(*keys))).join(crowded, "key", "left_semi")
    return near.union(_midpoints(dense.select("fp").distinct(), bits))


def _midpoints(points: DataFrame, bits: int) -> DataFrame:
    masks = [0] + [
        _signed(sum(1 << i for i in chosen))
        for n in range(1, bits // 2 + 1) for chosen in combinations(range(64), n)
    ]
    flips = F.array(*[F.lit(m) for m in masks])
    spread = points.withColumn("mid", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))))
    low = spread.groupBy("mid").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top")
    return spread.join(low, "mid").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS,
    bucket: int = BUCKET,
) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, keep) per row of `docs`.

    component_id is the smallest doc_id that links of at most `bits` (even) differing bits reach;
    `keep` marks the rows with the component's smallest (doc_id, text_hash), of which repeated rows
    share one. NULL or empty texts have fingerprint 0 and link like any other. A NULL doc_id is
    never the smallest unless the component has no other. No rows give no rows.
    """
    rows = durable(fingerprints(docs, doc_id, text))
    points = _points(rows)
    return _kept(rows, points, durable(components(links(points, bits, bucket))))


def _points(rows: DataFrame) -> DataFrame:
    return durable(rows.groupBy("fp").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first"), F.count("*").alias("n"),
    ))


def _kept(rows: DataFrame, points: DataFrame, roots: DataFrame) -> DataFrame:
    of = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    best = of.groupBy("root").agg(F.min("first").alias("head"))
    heads = durable(of.join(best, "root").select("fp", "head"))
    out = lookup(rows, heads, "fp")
    return out.select(
        "doc_id", "text_hash", "fp", F.col("head.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))
        .alias("keep"),
    )


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS, bucket: int = BUCKET,
) -> DataFrame:
    """`docs` with one row of each group of `near_duplicates`, its columns unchanged: the one with the
    smallest (id, text hash), of rows repeated with id and text any one. NULL and empty texts are one
    group, in which texts without a fingerprint bit are too. No rows give no rows."""
    def key(of: Column, hash_of: Column) -> Column:
        return F.concat_ws(":", F.coalesce(of.cast("string"), F.lit("")), of.isNull(), hash_of)

    kept = durable(near_duplicates(docs, doc_id, text, bits, bucket).where("keep").groupBy(
        key(F.col("doc_id"), F.col("text_hash")).alias("key")
    ).agg(F.count("*").alias("rows")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*columns).alias("row"), key(F.col(f"`{doc_id}`"), F.xxhash64(text_or_empty(text))).alias("key"))
    # The narrow side is hashed, so that texts are neither sorted nor held.
    one = keyed.join(kept.select("key").hint("shuffle_hash"), "key", "left_semi")
    if kept.where("rows > 1").limit(1).count():  # rows repeated with id and text
        one = one.dropDuplicates(["key"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
