"""Document fingerprints by Order MinHash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hostlens.llm.common import hex_of, text_or_empty

SIGNATURES = 32  # a power of two
TUPLE = 2  # k-mers of a signature
WORDS = 3  # words of a k-mer
LONGEST = 16  # a longer word, as of writing without blanks, counts as its characters


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _kmers(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(rf"(?<!\S)\S{{1,{LONGEST}}}(?!\S)|\S"), F.lit(0))

    def hashes(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - WORDS), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
        few = F.when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(n >= WORDS, each).otherwise(few)

    return let(words, hashes)


def _numbered(kmers: Column) -> Column:
    """(g, i) of each k-mer: the hash of k-mer and occurrence number, and its place in the text."""
    def plain(h: Column) -> Column:
        return F.transform(h, lambda x, i: F.struct(F.xxhash64(x, F.lit(0)).alias("g"), i.alias("i")))

    def runs(s: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, j: F.when(
            (j == 0) | (F.get(s, j - 1)["h"] != x["h"]), j
        )), lambda j: j.isNotNull())
        return let(first, lambda b: F.flatten(F.transform(b, lambda at, r: F.transform(
            F.slice(s, at + 1, F.coalesce(F.get(b, r + 1), F.size(s)) - at),
            lambda x, o: F.struct(F.xxhash64(x["h"], o).alias("g"), x["i"].alias("i")),
        ))))

    def either(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), plain(h)).otherwise(let(ordered, runs))

    return let(kmers, either)


def _least(numbered: Column, bits: int) -> Column:
    """The TUPLE smallest hashes of each bin; the highest `bits` bits are the bin."""
    def of(g: Column) -> Column:
        return F.shiftright(g, 64 - bits)

    def pick(all_: Column) -> Column:
        return let(F.array_sort(all_), lambda s: F.filter(s, lambda x, j: (j < TUPLE) | (
            of(F.get(s, F.greatest(j - TUPLE, F.lit(0)))["g"]) != of(x["g"])
        )))

    full = TUPLE << bits
    rest = F.lit((1 << (64 - bits)) - 1)

    def choose(e: Column) -> Column:
        # Of many k-mers, only small hashes can be picked; if they fill all bins, no other one is.
        cut = F.floor(F.lit(float(1 << (64 - bits))) * (8 * full) / F.size(e)).cast("long")
        small = F.filter(e, lambda x: x["g"].bitwiseAND(rest) < cut)
        return F.when(F.size(e) <= 8 * full, pick(e)).otherwise(
            let(pick(small), lambda p: F.when(F.size(p) == full, p).otherwise(pick(e)))
        )

    return let(numbered, choose)


def signatures(text: Column, n: int = SIGNATURES) -> Column:
    """Array of n numbers, NULL where no k-mer fell into the bin.

    K-mers (WORDS consecutive words; of a word longer than LONGEST its characters) are numbered by occurrence and hashed; the hash space is cut
    into n bins, in each of which the TUPLE smallest are selected, put in text order, and hashed as a
    tuple. So a signature changes with what a text has and with the order it has it in, and the share
    of equal signatures falls with the edit distance.
    """
    bits = n.bit_length() - 1

    def tuples(kept: Column) -> Column:
        def of_bin(b: Column) -> Column:
            inside = F.filter(kept, lambda x: F.shiftright(x["g"], 64 - bits) == b)
            placed = F.transform(F.array_sort(F.transform(
                inside, lambda x: F.struct(x["i"].alias("i"), x["g"].alias("g"))
            )), lambda x: x["g"])
            return let(placed, lambda t: F.when(F.size(t) > 0, F.xxhash64(t).bitwiseAND(F.lit(0xFFFFFFFF))))

        return F.transform(F.sequence(F.lit(-(n // 2)), F.lit(n // 2 - 1)), lambda b: of_bin(b.cast("long")))

    return let(_least(_numbered(_kmers(text)), bits), tuples)


def written(sig: Column) -> Column:
    """Eight hex digits per signature, dashes for none."""
    return F.array_join(
        F.transform(sig, lambda s: F.coalesce(F.lpad(F.lower(F.hex(s)), 8, "0"), F.lit("-" * 8))), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal signatures among those that either has; 1 if neither has one."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    there = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(there == 0, 1.0).otherwise(same / there)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, signatures) per row; NULL texts count as empty, which have dashes only."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text")).select(
        "doc_id", signatures(F.col("text")).alias("signatures")
    ).select("doc_id", written(F.col("signatures")).alias("fingerprint"), "signatures")


def with_next(docs: DataFrame, per_partition: int = 2) -> DataFrame:
    """(doc_id, text, next_text, sig, next_sig): every row with the next one in descending doc_id, the
    last with the first; equal ids by text, NULL ids last. One row alone is its own next.

    doc_id (a number) is cut into ranges at approximate quantiles, which bound no result. The first
    row of each range also goes, marked, to the end of the range before, so every next row is found
    inside its range with one shuffle of the texts.
    """
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")) * per_partition, 1)
    at = F.col("doc_id").cast("double")
    cuts = sorted(set(docs.select(at.alias("v")).approxQuantile("v", [i / parts for i in range(1, parts)], 0.2 / parts)))
    bounds = F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>")
    part = F.when(at.isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b <= at)))
    rows = docs.select("doc_id", "text", part.alias("part"), F.lit(False).alias("mark"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), (-F.col("doc_id")).alias("d"), "text", "doc_id")
    heads = rows.groupBy("part").agg(F.min(order).alias("head"))
    there = sorted((r[0] for r in rows.groupBy("part").count().select("part").collect()), reverse=True)
    before = dict(zip(there, there[-1:] + there[:-1]))  # the range that comes before, in that order
    if there:
        to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        rows = rows.unionByName(heads.select(
            "head.doc_id", "head.text", F.get(F.array(to[F.col("part")]), F.lit(0)).alias("part"), F.lit(True).alias("mark"),
        ))
    turn = Window.partitionBy("part").orderBy("mark", F.col("doc_id").desc_nulls_last(), "text")
    both = rows.withColumn("sig", signatures(F.col("text")))
    return both.withColumn("next", F.lead(F.struct("text", "sig")).over(turn)).where(~F.col("mark")).select(
        "doc_id", "text", "sig", F.col("next.text").alias("next_text"), F.col("next.sig").alias("next_sig")
    )


def edit_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its fingerprint, that of an edited copy (the last third replaced by the start of the
    next document), and the likeness of its fingerprint to the copy's and to the next document's."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_or_empty(text).alias("text"))
    both = with_next(rows)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - third), F.col("next_text").substr(F.lit(1), third))
    out = both.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", let(edited, lambda t: F.struct(
        hex_of(t).alias("sha"), signatures(t).alias("sig")
    )).alias("edited"))
    return out.select(
        "doc_id", "n_chars", F.col("edited.sha").alias("edited_sha256"), written(F.col("sig")).alias("fingerprint"),
        written(F.col("edited.sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited.sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
