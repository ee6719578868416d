"""How far the sources of a language differ in their use of its terms, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, give_back, setting
from hostlens.sources.scratch import durable, scratch_path

MIN_DOCS = 30
SMOOTH = 5
UNIT = 1_000_000_000
TOP = 50
ALL_TERMS = 2**31 - 1  # the largest vocabSize: no term of the minimum document frequency is left out
TEXT_MB = 16
SLICE_TERMS = 1 << 18  # vocabulary of one fit at most, on average: what the driver and a broadcast hold
SIZED_BY = 32
SOURCES, TERMS = 256, 4096  # groups and terms of a dense tile
VECTOR = "counts struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def _letters() -> np.ndarray:
    """What each byte of a text in UTF-8 becomes: 0 between terms, the lower case of A to Z, else itself."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[:65] = out[91:97] = out[123:128] = 0
    return out


def split_terms(texts: pa.StringArray) -> pa.ListArray:
    """The terms of each text, all texts of a batch at once on their bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    data = _letters()[data]
    letter = data != 0
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    edges = at[:-1][at[:-1] < len(data)]
    begins[edges] = letter[edges]  # a term ends with its text
    starts = np.flatnonzero(begins)
    size = np.add.reduceat(letter, starts, dtype=np.int32) if len(starts) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data[letter]))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, at).astype(np.int32)), words)


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def _of(lang: Column) -> Column:
    """A language's folder: any text is a name there."""
    return F.hex(F.xxhash64(lang))


class Tokens:
    """(lang, source, terms) per row, stored by language: the terms of the whole text, repeats included."""

    def __init__(self, docs: DataFrame, text: str, lang: str, source: str):
        spark = docs.sparkSession
        arrow_batches(spark, TEXT_MB)
        names = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), _text(text).alias("text"))

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                terms = split_terms(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("source"), terms], ["lang", "source", "terms"])
                give_back()

        self.path = scratch_path(spark, "terms")
        rows = names.mapInArrow(run, "lang string, source string, terms array<string>").withColumn("of", _of(F.col("lang")))
        with setting(spark, "spark.sql.maxConcurrentOutputFileWriters", "16"):  # few languages need no sort
            rows.write.partitionBy("of").parquet(self.path)
        self.rows = spark.read.schema("lang string, source string, terms array<string>, of string").parquet(self.path)
        self.groups = durable(self.rows.groupBy("lang", "source").count())

    def of(self, lang: str) -> DataFrame:
        here = F.lit(lang)
        return self.rows.where((F.col("of") == _of(here)) & (F.col("lang") == here)).select("source", "terms")


def slices_of(rows: DataFrame, min_docs: int, slice_terms: int, part: int = SIZED_BY) -> int:
    """Into how many slices the terms of a language are cut, so that each keeps about `slice_terms` at most.
    Terms that occur often enough are counted among one in `part` by their hash; this sizes the work and
    changes no result."""
    words = rows.select(F.explode("terms").alias("term")).where(F.pmod(F.xxhash64("term"), F.lit(part)) == 0)
    often = words.groupBy("term").count().where(F.col("count") >= min_docs).count()
    return max(ceil(often * part / slice_terms), 1)


def term_counts(
    tokens: Tokens, min_docs: int = MIN_DOCS, slice_terms: int = SLICE_TERMS
) -> tuple[DataFrame, DataFrame]:
    """Vocabulary (lang, slice, index, term), and (lang, slice, index, source, n): the occurrences of each
    kept term in each group that has it.

    A CountVectorizer per language, with `minDF` and no bound on the vocabulary's size, makes exact sparse
    vectors of the documents, and their sum per group is an aggregation over their entries. Its
    vocabulary passes through the driver, so a language whose kept terms are more than `slice_terms` is
    cut by a hash of the term: every slice has a fit of its own, and no term is in two.
    """
    spark = tokens.rows.sparkSession
    vectors, words = scratch_path(spark, "vectors"), scratch_path(spark, "vocabulary")
    fits = 0
    for (lang,) in sorted(map(tuple, tokens.groups.select("lang").distinct().collect())):  # a row per language
        whole = tokens.of(lang)
        slices = slices_of(whole, min_docs, slice_terms)
        for k in range(slices):
            part = whole
            if slices > 1:
                part = part.withColumn("terms", F.filter("terms", lambda t: F.pmod(F.xxhash64(t), F.lit(slices)) == k))
            try:
                fit = CountVectorizer(inputCol="terms", outputCol="counts", minDF=min_docs, vocabSize=ALL_TERMS).fit(part)
            except IllegalArgumentException as e:
                if "vocabulary size" not in str(e):
                    raise
                continue  # no term of the slice has the documents
            here = F.lit(lang).alias("lang"), F.lit(k).alias("slice")
            fit.transform(part).select(*here, "source", "counts").write.mode("append").parquet(vectors)
            spark.createDataFrame(pa.table({
                "index": pa.array(range(len(fit.vocabulary)), pa.int32()), "term": pa.array(fit.vocabulary, pa.string()),
            })).select(*here, "index", "term").write.mode("append").parquet(words)
            fits += 1
    if not fits:
        none = spark.createDataFrame([], "lang string, slice int, index int, term string")
        return none, none.select("lang", "slice", "index", F.col("term").alias("source"), F.lit(0).cast("long").alias("n"))
    # A stored vector is a struct, so that its entries need no Python.
    entries = spark.read.schema(f"lang string, slice int, source string, {VECTOR}").parquet(vectors).select(
        "lang", "slice", "source", F.explode(F.arrays_zip("counts.indices", "counts.values")).alias("e")
    )
    sums = entries.groupBy("lang", "slice", F.col("e.indices").alias("index"), "source").agg(
        F.sum(F.col("e.values").cast("long")).alias("n")
    )
    return spark.read.schema("lang string, slice int, index int, term string").parquet(words), durable(sums)


def _share(n: str, total: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * v)) in whole numbers of 38 digits."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(20, 0)) * ({n} + {SMOOTH})) div ({total} + {SMOOTH} * v)")


def _tile(table: pa.Table, sources: int) -> pa.Table:
    """Sums of abs(p - q) over the terms of a tile, for the pairs of a block of groups with another; rows
    without a column give each group's share of a term that it lacks."""
    at = {k: table.column(k).to_numpy(zero_copy_only=False) for k in ("number", "p", "width")}
    column = np.array([-1 if x is None else x for x in table.column("col").to_pylist()], np.int64)
    head = column < 0
    numbers, first = np.unique(at["number"][head], return_index=True)
    shares = np.repeat(at["p"][head][first][:, None], int(at["width"].max()), axis=1)
    shares[np.searchsorted(numbers, at["number"][~head]), column[~head]] = at["p"][~head]
    left, right = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    block = numbers // sources
    others = np.flatnonzero(block == right)
    a, b, value = [], [], []
    for i in np.flatnonzero(block == left).tolist():
        js = others[others > i]
        a += [numbers[i]] * len(js)
        b += numbers[js].tolist()
        value += np.abs(shares[js] - shares[i]).sum(1).tolist()
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table([lang, *(pa.array(x, pa.int64()) for x in (a, b, value))], ["lang", "a", "b", "value"])


def divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    min_docs: int = MIN_DOCS, top: int = TOP, slice_terms: int = SLICE_TERMS,
    tile: tuple[int, int] = (SOURCES, TERMS),
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group of a language and a source, its distance to
    every other source of the language (part `pair`), and the terms that it uses more than its language
    does (part `term`, ranks to `top`).

    A group's share of a term is 1 + floor(10^9 * (count + 5) / (total + 5 * V)), over the V terms that at
    least `min_docs` documents of the language have; values are sums of differences of shares, in exact
    integers, larger first, ties by the item's UTF-8. NULL text, language and source are ''. Every row
    is a document, repeated ones too. A group without terms has distances like any other; a language
    without kept terms has distances 0. No rows give no rows.

    Distances come from dense tiles of two blocks of groups (of `tile[0]`) by `tile[1]` terms, whose sums
    are added up; a common term or a large source is only ever a count.
    """
    width, height = tile[1], tile[0]
    rows = Tokens(docs, text, lang, source)
    words, sums = term_counts(rows, min_docs, slice_terms)
    size = words.groupBy("lang").agg(F.count("*").alias("v"))
    totals = sums.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = durable(
        rows.groups.select("lang", "source").join(totals, ["lang", "source"], "left").join(size, "lang", "left")
        .na.fill(0, ["total", "v"])
        .withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
        .withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / height).cast("int"))
        .withColumn("p0", F.when(F.col("v") > 0, _share("0", "total")).otherwise(0).cast("long"))
    )
    counts = durable(sums.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total").cast("long")))

    of_tile = F.floor(F.col("index") / width).cast("int").alias("tile")
    widths = words.groupBy("lang", "slice", of_tile).agg(F.count("*").cast("int").alias("width"))
    tiles = groups.select("lang").distinct().join(widths, "lang", "left").na.fill(0, ["slice", "tile", "width"])
    heads = groups.join(tiles, "lang").select(
        "lang", "slice", "tile", "width", "number", "blocks", F.lit(None).cast("int").alias("col"), F.col("p0").alias("p")
    )
    cells = counts.select("lang", "slice", of_tile, F.lit(0).alias("width"), "number", "blocks", (F.col("index") % width).alias("col"), "p")
    own = F.floor(F.col("number") / height).cast("int")
    met = heads.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "slice", "tile", F.least(own, "other").alias("bi"), F.greatest(own, "other").alias("bj"),
        F.col("number").cast("long"), "col", "p", "width",
    )
    keys = ("lang", "slice", "tile", "bi", "bj")
    partial = met.groupBy(*keys).applyInArrow(lambda t: _tile(t, height), "lang string, a long, b long, value long")
    half = durable(partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    both = half.select("lang", "a", "b", "value").union(half.select("lang", "b", "a", "value"))
    named = groups.select("lang", F.col("number").cast("long").alias("a"), "source")
    pairs = both.join(named, ["lang", "a"]).join(named.toDF("lang", "b", "item"), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"
    )

    whole = counts.groupBy("lang", "slice", "index").agg(F.sum("n").alias("lang_n"))
    lang_total = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.first("v").alias("v"))
    of_lang = whole.join(lang_total, "lang").select("lang", "slice", "index", _share("lang_n", "lang_total").cast("long").alias("q"))
    terms = counts.join(of_lang, ["lang", "slice", "index"]).where("p > q").join(words, ["lang", "slice", "index"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))

