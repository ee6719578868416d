"""Benchmark decontamination: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, give_back, id_and_text, text_or_empty

Q = 7  # code points of a q-gram
RATE = 0.12  # edits per code point of a benchmark text
BLOCK_CHARS = 1 << 20  # code points of benchmark texts that one pass takes
WINDOW = 1 << 20  # code points of a document that are looked at together
SLICE = 1 << 21  # q-gram occurrences that are held at a time
TOGETHER = 128  # alignments that go row by row together
CELLS = 1 << 22  # texts times items that are counted together
BREAK = 0x110000  # separates texts; no text holds it
UNSPACED = 0x2E80  # East Asian writing begins here; it puts no blanks between words
_BITS = 20


def codes_of(text: str) -> np.ndarray:
    """Code points, lower-cased one by one (so positions stay), with every white space a blank."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    s = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (s < 33) & np.isin(s, [9, 10, 11, 12, 13, 28, 29, 30, 31])
    return np.where(blank | (s == 0xA0) | (s == 0x3000), np.uint32(32), s)


def _qgrams(s: np.ndarray, q: int) -> np.ndarray:
    h = np.zeros(max(len(s) - q + 1, 0), np.uint64)
    for k in range(q):
        h = h * np.uint64(0x100000001B3) + s[k : k + len(h)]
    return h * np.uint64(0x9E3779B97F4A7C15)


def budget(length: int, q: int = Q, rate: float = RATE) -> tuple[int, int]:
    """(edits, shared q-grams): a region within that many edits of a text of this length shares at
    least length - q + 1 - q * edits q-grams with it. The edits are at most rate * length, and as
    many as leave at least one q-gram to share; a text shorter than q has (0, 0)."""
    if length < q:
        return 0, 0
    edits = min(int(rate * length), (length - q) // q)
    return edits, length - q + 1 - q * edits


@dataclass
class Block:
    """Benchmark texts of a bounded size with their q-grams."""

    ids: list
    texts: list[np.ndarray]
    q: int
    rate: float
    keys: np.ndarray = field(init=False)

    def __post_init__(self):
        grams = [_qgrams(t, self.q) for t in self.texts]
        h = np.concatenate([*grams, np.empty(0, np.uint64)])
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)])
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        budgets = [budget(len(t), self.q, self.rate) for t in self.texts]
        self.edits = np.array([b[0] for b in budgets], np.int64)
        self.least = np.array([b[1] for b in budgets], np.int64)
        self.longest = max((len(t) for t in self.texts), default=0)
        self.short = [i for i, t in enumerate(self.texts) if len(t) < self.q]

    def hits(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, key number) of the q-grams of s that the block has."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = _qgrams(s, self.q)
        at = np.flatnonzero(self.maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        return at[same], k[same]

    def occurrences(self, at: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position, item, position in the item) of all hits, a slice at a time."""
        ends = np.cumsum(self.count[k])
        i = 0
        while i < len(k):
            done = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, done + SLICE, "right")))
            n = self.count[k[i:j]]
            hit = np.repeat(np.arange(i, j), n)
            occ = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[k[hit]]
            yield at[hit], self.item[occ], self.at[occ]
            i = j


def align(
    items: list[np.ndarray], texts: list[np.ndarray], low: np.ndarray, width: int
) -> list[tuple[int, int, int]]:
    """(edits, start, end) of the best match of each whole item in its text, with a path on the
    `width` diagonals from low (text position minus item position); start and end are free. All
    items go row by row together; a cell holds its edits and, below them, where its path began."""
    n, longest = len(items), max(map(len, items))
    one, far = np.int64(1 << 32), np.int64(1 << 52)
    want = np.full((n, longest), BREAK + 1, np.uint32)
    window = np.full((n, longest + width), BREAK, np.uint32)  # window[c, x] is text c at low + x
    place = low[:, None] + np.arange(longest + width + 1)
    for c, (item, text) in enumerate(zip(items, texts)):
        want[c, : len(item)] = item
        a, b = max(-int(low[c]), 0), min(longest + width, len(text) - int(low[c]))
        if b > a:
            window[c, a:b] = text[low[c] + a : low[c] + b]
    outside = (place < 0) | (place > np.array([len(t) for t in texts])[:, None])
    step = np.arange(width, dtype=np.int64) * one
    row = np.where(outside[:, :width], far, place[:, :width])
    ends = np.array([len(i) for i in items])
    out: list = [None] * n
    for i in range(longest):
        seen = window[:, i : i + width]
        new = row + np.where(seen == want[:, i : i + 1], 0, np.where(seen == BREAK, far, one))
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + one)
        new[outside[:, i + 1 : i + 1 + width]] = far
        row = np.minimum(np.minimum.accumulate(new - step, axis=1) + step, far)
        for c in np.flatnonzero(ends == i + 1):
            best = int(row[c].argmin())
            out[c] = (int(row[c, best] >> 32), int(row[c, best] & (one - 1)), int(low[c]) + best + i + 1)
    return out


def find(
    block: Block, texts: list[np.ndarray], whole: list[tuple[bool, bool]] | None = None
) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of every region of the texts that is within the edit budget of
    an item; of regions of one item that overlap, the one with the fewest edits. An item shorter than a
    q-gram must match exactly and end where words end. `whole` tells of each text whether its start and
    end are those of a text, not of a window that was cut out of one."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    s = np.full(int(size.sum()) + block.q, BREAK, np.uint32)
    for b, t in zip(begin, texts):
        s[b : b + len(t)] = t
    at, k = block.hits(s)
    n = len(block.texts)
    shared = np.zeros(len(texts) * n, np.int64)
    for p, item, _ in block.occurrences(at, k):
        doc = np.searchsorted(begin, p, "right") - 1
        shared += np.bincount(doc * n + item, minlength=len(shared))
    enough = (shared.reshape(-1, n) >= block.least) & (block.least > 0)
    found = []
    if enough.any():
        some = np.flatnonzero(enough.any(1)[np.searchsorted(begin, at, "right") - 1])
        bands: list[np.ndarray] = []
        width = block.edits + 1
        most, deep = int(len(s) + block.longest) * 2, block.longest + 1
        for p, item, i in block.occurrences(at[some], k[some]):
            doc = np.searchsorted(begin, p, "right") - 1
            good = enough[doc, item]
            p, item, i, doc = p[good], item[good], i[good], doc[good]
            diag = p - begin[doc] - i + block.longest
            band, left = np.divmod(diag, width[item])
            key = ((doc * n + item) * most + band) * deep + i
            bands.append(key)
            bands.append(key[(left < block.edits[item]) & (band > 0)] - deep)  # the band before overlaps
            if sum(map(len, bands)) > 4 * SLICE:
                bands = [_distinct(np.concatenate(bands))]
        # An item's q-gram counts once in a band, however often the text repeats it.
        key, total = _counted(_distinct(np.concatenate(bands)) // deep)
        pair, band = np.divmod(key, most)
        kept = total >= block.least[pair % n]
        doc, item = np.divmod(pair[kept], n)
        found += _verify(block, texts, doc, item, band[kept] * width[item] - block.longest)
    for item in block.short:
        want = block.texts[item]
        for doc, t in enumerate(texts):
            same = np.ones(max(len(t) - len(want) + 1, 0), bool)
            for k, c in enumerate(want):
                same &= t[k : k + len(same)] == c
            edges = whole[doc] if whole else (True, True)
            spans = [(int(d), int(d) + len(want)) for d in np.flatnonzero(same)]
            found += [(doc, item, a, b, 0) for a, b in spans if _between(t, a, edges[0]) and _between(t, b, edges[1])]
    return _best(found)


def _between(t: np.ndarray, at: int, edge: bool) -> bool:
    """Whether a place lies at a border of words; `edge` answers for the ends, where a cut window cannot tell
    and the window that overlaps it can."""
    if at in (0, len(t)):
        return edge
    before, after = int(t[at - 1]), int(t[at])
    return max(before, after) >= UNSPACED or not (chr(before).isalnum() and chr(after).isalnum())


def _starts(ordered: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_starts(x)]


def _counted(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = _starts(ordered)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _verify(block: Block, texts: list[np.ndarray], doc: np.ndarray, item: np.ndarray, low: np.ndarray) -> list:
    """Regions (text, item, start, end, edits) within the budget in the bands of diagonals from low."""
    order = np.argsort(np.array([len(t) for t in block.texts])[item], kind="stable")
    out = []
    for k in range(0, len(order), TOGETHER):
        part = order[k : k + TOGETHER]
        edits = block.edits[item[part]]
        got = align(
            [block.texts[i] for i in item[part]], [texts[d] for d in doc[part]], low[part] - edits,
            4 * int(edits.max()) + 2,
        )
        out += [
            (int(doc[c]), int(item[c]), start, end, cost)
            for c, e, (cost, start, end) in zip(part, edits, got) if cost <= e
        ]
    return out


def _best(found) -> list[tuple[int, int, int, int, int]]:
    out: list = []
    for f in sorted(set(found), key=lambda f: (f[0], f[1], f[4], f[2], f[3])):
        if not any(o[:2] == f[:2] and o[2] < f[3] and f[2] < o[3] for o in reversed(out) if o[0] == f[0]):
            out.append(f)
    return out


def blocks_of(benchmark: DataFrame, item_id: str, text: str, q: int, rate: float, chars: int) -> Iterator[Block]:
    """The query set in blocks of a bounded size (or of one text), read one after the other."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), text_or_empty(text).alias("text"))
    for r in rows.where("trim(text) <> ''").distinct().toLocalIterator():
        codes = codes_of(r["text"])
        if ids and size + len(codes) > chars:
            yield Block(ids, texts, q, rate)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(codes)
        size += len(codes)
    if ids:
        yield Block(ids, texts, q, rate)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every region of a text that repeats a benchmark text
    with at most rate * length edits, case and kind of white space aside; code points, end exclusive.

    The benchmark is a query set that passes over the documents in blocks of `block_chars`, each small
    enough to broadcast; texts are read whole, in overlapping windows if very long. NULL and blank
    texts match nothing; repeated rows give repeated regions; empty tables give no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark, 8)
    rows = id_and_text(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, start int, end int, edits int"
    out = spark.createDataFrame([], schema)
    for block in blocks_of(benchmark, item_id, item_text, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_chars
        overlap = _overlap(block)

        def run(parts: Iterator[pa.RecordBatch], shared=shared, overlap=overlap) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part in parts:
                kept: list[list] = [[], [], [], [], []]
                for where, windows in _groups(part.column("text").to_pylist(), overlap, len(block.ids)):
                    regions = [
                        (where[w][0], i, s + where[w][1], e + where[w][1], n)
                        for w, i, s, e, n in find(block, windows, [x[2] for x in where])
                    ]
                    for row, i, s, e, n in _best(regions):
                        for column, value in zip(kept, (row, block.ids[i], s, e, n)):
                            column.append(value)
                ids = part.column("doc_id").take(pa.array(kept[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(kept[1], pa.array(block.ids).type), *(pa.array(c, pa.int32()) for c in kept[2:])],
                    ["doc_id", "item_id", "start", "end", "edits"],
                )

        out = out.unionByName(rows.mapInArrow(run, schema))
    return out


def _groups(
    texts: list[str], overlap: int, items: int
) -> Iterator[tuple[list[tuple[int, int, tuple[bool, bool]]], list[np.ndarray]]]:
    """(row, place, whether start and end are the text's) and the texts of a batch, put together up to a window's size; a longer one in overlapping windows, all
    in one group so that a region in two windows counts once."""
    where, windows, size = [], [], 0
    step = max(WINDOW, 2 * overlap)
    for row, t in enumerate(texts):
        codes = codes_of(t)
        if windows and (size + len(codes) > WINDOW or len(windows) * items > CELLS):
            yield where, windows
            where, windows, size = [], [], 0
        for begin in range(0, max(len(codes) - overlap, 1), step):
            where.append((row, begin, (begin == 0, begin + step + overlap >= len(codes))))
            windows.append(codes[begin : begin + step + overlap])
        size += len(codes)
    if windows:
        yield where, windows


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    q: int = Q, rate: float = RATE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """`docs` without the rows whose text repeats a benchmark text; its columns unchanged. NULL and empty
    texts stay, repeated rows go or stay together."""
    spark = docs.sparkSession
    arrow_batches(spark, 8)
    for block in blocks_of(benchmark, item_id, item_text, q, rate, block_chars):
        shared = spark.sparkContext.broadcast(block)  # bounded by block_chars
        docs = docs.where(_clean(shared, _overlap(block))(text_or_empty(text)))
    return docs


def _clean(shared, overlap: int):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        ok = np.ones(len(texts), bool)
        for where, windows in _groups(texts.tolist(), overlap, len(shared.value.ids)):
            for w, *_ in find(shared.value, windows, [x[2] for x in where]):
                ok[where[w][0]] = False
        give_back()
        return pd.Series(ok)

    return clean


def _overlap(block: Block) -> int:
    return 2 * (block.longest + int(block.edits.max(initial=0)) + block.q)
