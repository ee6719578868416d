"""Repeated passages of a corpus: byte strings of a fixed length that start in more than one place.

Windows that are equal share their smallest hashed gram, so the texts are cut into short pieces by that
gram, and pieces of one gram meet in one task. There a column-wise construction sorts all suffixes of the
task's pieces: one symbol of each piece is inserted a round, which keeps the collection's transform and
the common prefixes of neighbours up to date; neighbours that share a whole window are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, bucketed, give_back, id_and_text
from hostlens.sources.scratch import durable

WINDOW = 200
GRAM = 32
CROWDED = 400  # distinct pieces of one gram that a task takes; more are cut finer
TASK_BYTES = 1 << 19  # pieces of one construction: a round's few calls weigh little, its short list fits a core's cache
ROUNDS = 32  # of the construction between two times that its whole list is rewritten
SEGMENT = 1 << 20  # windows of a long text at a time
NARROWER = 4
PIECE = ("key", "h1", "h2")


# ------------------------------------------------------------- construction of a task
def repeated_windows(pieces: list[bytes], window: int = WINDOW, rounds: int = ROUNDS) -> list[np.ndarray]:
    """For each piece, whether the window at each of its starts occurs elsewhere in the pieces.

    The list of suffixes is kept as two arrays: `order`, in which a suffix is its first symbol and the place of
    the rest of it (so the symbol before the suffix at place p stands where its entry names p), and `common`, its
    common prefix with the one before, up to `window`. Round j inserts the suffix of length j of every piece: its
    place follows from its symbol and the place of the suffix of length j - 1, its common prefixes from the
    smallest one between the rests of the neighbours. The list is rewritten in sequence once in `rounds` rounds.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum(size)
    shift = int(size.sum() + len(pieces) + 1).bit_length()
    low = (1 << shift) - 1
    order = np.arange(len(pieces), dtype=np.int64)  # ends of pieces, all different, come first
    common = np.zeros(len(pieces) + 1, np.uint8 if window < 255 else np.uint32)
    place = order.copy()
    rounds = max(min(rounds, (1 << max(54 - shift, 0)) // (len(pieces) + 1) - 1), 1)  # keys have 63 bits
    longest = int(size.max(initial=0))
    for begin in range(1, longest + 1, rounds):
        columns = []
        for j in range(begin, min(begin + rounds, longest + 1)):
            of = np.flatnonzero(size >= j)
            columns.append((of, text[end[of] - j].astype(np.int64) + 1))
        order, common, place = _inserted(order, common, place, columns, shift, window)
    whole = common >= window
    hit = whole[:-1] | whole[1:]
    starts = np.maximum(size - window + 1, 0)
    first = np.cumsum(starts) - starts
    out = np.zeros(int(starts.sum()), bool)
    left = np.flatnonzero(starts > 0)
    for i in range(int(starts.max(initial=0))):  # from each suffix to the rest of it
        left = left[starts[left] > i]
        out[first[left] + i] = hit[place[left]]
        place[left] = order[place[left]] & low
    return [out[i : i + n] for i, n in zip(first.tolist(), starts.tolist())]


def _inserted(
    order: np.ndarray, common: np.ndarray, place: np.ndarray, columns: list[tuple[np.ndarray, np.ndarray]], shift: int,
    window: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The list after some rounds, each the pieces that go on and their next symbols; `place` is that of the longest
    suffix of each piece.

    The suffixes of these rounds are a short list of their own, in order, and only that is rewritten in a round.
    Each knows the gap of the long list that it lies in, and its common prefixes with both sides of the gap. Its key
    is its symbol, the gap of the rest of it, and the place of that in the short list; a rest in the long list
    comes after all of the short list in its gap.
    """
    size, low = len(order), (1 << shift) - 1
    total = sum(len(of) for of, _ in columns)
    bits = int(total + 1).bit_length()
    far = (1 << bits) - 1
    # The longest suffix of each piece: its gap, its place in the short list, and its number in `gaps`, `lefts`, `rights`.
    gap_of, at_of, number = place.copy(), np.full(len(place), far), np.full(len(place), -1)
    left_of, right_of = common[place], np.full(len(place), window, common.dtype)
    gaps, lefts, rights = np.empty(total, np.int64), np.empty(total, common.dtype), np.empty(total, common.dtype)
    key, numbers, among = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, common.dtype)
    done = 0
    for of, symbol in columns:
        new = (((symbol << shift) | gap_of[of]) << bits) | at_of[of]
        by = np.argsort(new)
        new, of, symbol = new[by], of[by], symbol[by]
        rest, mine = gap_of[of], at_of[of]
        left, right = left_of[of], right_of[of]
        gap, at = np.searchsorted(order, new >> bits), np.searchsorted(key, new)
        # Neighbours with the same first symbol: in the long list before and after, in the short list before, and after
        # the last of those inserted at one place.
        before, after = order[gap - 1], order[np.minimum(gap, size - 1)]
        lower = np.flatnonzero(before >> shift == symbol)
        upper = np.flatnonzero((after >> shift == symbol) & (gap < size))
        previous = np.append(0, key)[at]
        together = at[1:] == at[:-1]
        previous[1:] = np.where(together, new[:-1], previous[1:])
        near = np.flatnonzero(previous >> bits + shift == symbol)
        last = np.flatnonzero(np.append(~together, True))
        following = np.append(key, 0)[at[last]]
        same = following >> bits + shift == symbol[last]
        last, following = last[same], following[same]
        previous = previous[near]
        p_at, f_at = previous & far, following & far
        p_far, f_far = p_at == far, f_at == far
        p_long, f_long = near[p_far], last[f_far]
        # Between a rest in the long list and one in a gap lie the entries up to the gap, and then its own prefix.
        inside = mine[p_long] == far
        shared = _smallest(
            common,
            np.concatenate([(before[lower] & low) + 1, rest[upper] + 1, (previous[p_far] >> bits & low) + 1, rest[f_long] + 1]),
            np.concatenate([rest[lower], (after[upper] & low) + 1, rest[p_long] + inside, (following[f_far] >> bits & low) + 1]),
            np.concatenate([left[lower], right[upper], np.where(inside, common.dtype.type(window), left[p_long]), right[f_long]]),
        )
        n_lower, n_upper, n_long = len(lower), len(lower) + len(upper), len(lower) + len(upper) + len(p_long)
        p_short, f_short = near[~p_far], last[~f_far]
        short = _smallest(
            among, np.append(p_at[~p_far], mine[f_short]) + 1, np.append(mine[p_short], f_at[~f_far]) + 1,
            np.full(len(p_short) + len(f_short), window, common.dtype),
        )
        left, right, prefix = np.zeros((3, len(new)), common.dtype)
        left[lower], right[upper] = _longer(shared[:n_lower], window), _longer(shared[n_lower:n_upper], window)
        prefix[p_long], prefix[p_short] = _longer(shared[n_upper:n_long], window), _longer(short[: len(p_short)], window)
        among[at[f_long]] = _longer(shared[n_long:], window)
        among[at[f_short]] = _longer(short[len(p_short) :], window)
        # The places of the short list move up by the number of new ones at or before them.
        slots = at + np.arange(len(at))
        moved = np.repeat(np.arange(len(at) + 1), np.diff(at, prepend=0, append=len(key) + 1))
        moved[-1] = 0  # rests in the long list stay
        new += moved[np.minimum(mine, len(key))]
        key += moved[np.minimum(key & far, len(key))]
        stays = np.ones(len(key) + len(at), bool)
        stays[slots] = False
        those = np.arange(done, done + len(at))
        key, numbers = _merged(key, stays, slots, new), _merged(numbers, stays, slots, those)
        among = np.append(_merged(among[:-1], stays, slots, prefix), common.dtype.type(0))
        gaps[those], lefts[those], rights[those] = gap, left, right
        gap_of[of], at_of[of], number[of], left_of[of], right_of[of] = gap, slots, those, left, right
        done += len(at)
    gap = gaps[numbers]
    slots = gap + np.arange(total)
    moved = np.repeat(np.arange(total + 1), np.diff(gap, prepend=0, append=size + 1))
    at, rest = key & far, key >> bits & low
    rest = np.where(at == far, rest + moved[rest], slots[np.minimum(at, total - 1)])
    apart = gap[1:] != gap[:-1]
    prefix = np.where(np.append(True, apart), lefts[numbers], among[:-1])
    last = np.append(apart, True)
    common[gap[last]] = rights[numbers[last]]
    order += moved[order & low]
    now = np.empty(total, np.int64)
    now[numbers] = slots
    place = np.where(number < 0, place + moved[place], now[number])
    stays = np.ones(size + total, bool)
    stays[slots] = False
    order = _merged(order, stays, slots, (key >> bits + shift << shift) | rest)
    return order, np.append(_merged(common[:-1], stays, slots, prefix), common.dtype.type(0)), place


def _longer(common: np.ndarray, window: int) -> np.ndarray:
    """One symbol more than the rests have in common, up to the window."""
    return np.minimum(common, window - 1) + common.dtype.type(1)


def _merged(old: np.ndarray, stays: np.ndarray, slots: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(stays), old.dtype)
    out[stays] = old
    out[slots] = new
    return out


def _smallest(common: np.ndarray, begin: np.ndarray, end: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The smallest of common[begin:end] and `most`, for each."""
    if not len(begin):
        return common[:0]
    by = np.argsort(-begin)  # later ranges first: what lies between two ranges is not walked
    pairs = np.empty(2 * len(by), np.int64)
    pairs[::2], pairs[1::2] = begin[by], end[by]
    out = np.empty(len(by), common.dtype)
    out[by] = np.minimum.reduceat(common, pairs)[::2]
    return np.where(begin < end, np.minimum(out, most), most)


# -------------------------------------------------------------------------- anchors
@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(n, np.uint64(b))
        row[0] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram at each place."""
    n = len(data)
    up, down = _powers(1 << max(n, 1).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def smallest_grams(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive hashes, by running minima inside blocks."""
    n = len(h)
    a = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    a[:n] = h
    blocks = a.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def cut(text: bytes, window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start, windows, key): runs of consecutive windows with the same smallest gram, cut where they are
    longer than the grams of a window, or in two if they hold their gram twice. Equal windows have equal
    keys, wherever they are, and a key with equal windows has two starts."""
    for columns in cuts(text, window, gram):
        yield from zip(*(c.tolist() for c in columns))


def cuts(text: bytes, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The columns of `cut`, a segment of the text at a time."""
    width = window - gram + 1
    whole = np.frombuffer(text, np.uint8)
    for begin in range(0, len(text) - window + 1, SEGMENT):
        h = gram_hashes(whole[begin : begin + SEGMENT + window - 1], gram)
        key = smallest_grams(h, width)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        run = np.diff(np.append(edge, len(key)))
        # Equal windows have their first smallest gram at the same place in them: in a run of such windows that
        # of the first window lies before the last window.
        within = np.minimum.reduceat(h, np.stack([edge, edge + run - 1], 1).ravel())[::2]
        again = (run > 1) & (within == key[edge])
        parts = np.maximum(-(-run // width), 1 + again)
        long = np.where(run > width, width, -(-run // parts))
        first = np.repeat(edge, parts) + np.repeat(long, parts) * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        n = np.diff(np.append(first, len(key)))
        yield first + begin, n, key[first].view(np.int64)


def finer(piece: bytes, key: int, step: int, window: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(start, windows, key) of the parts of a piece whose windows have their smallest gram in the same
    `step` places. All of them share the bytes around it that every such window holds, and the key is of
    those bytes: with step 1, of the whole window."""
    width = window - gram + 1
    h = gram_hashes(np.frombuffer(piece, np.uint8), gram)
    lowest = smallest_grams(h, width)
    anchor = np.array([i + int(np.argmin(h[i : i + width])) for i in range(len(lowest))])
    cell = (anchor - np.arange(len(anchor))) // step
    edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
    for i, n in zip(edge.tolist(), np.diff(np.append(edge, len(anchor))).tolist()):
        least = int(cell[i]) * step
        most = min(least + step, width) - 1
        shared = piece[max(int(anchor[i]) - least, 0) : int(anchor[i]) - most + window]
        yield i, n, _signed(xxhash.xxh64_intdigest(shared, key & 0xFFFFFFFF ^ least))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _name(piece: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(piece)
    return _signed(x >> 64), _signed(x & 0xFFFFFFFFFFFFFFFF)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


# ------------------------------------------------------------------------- on Spark
def _chunks(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(chunk, row, doc_id, t1, t2, size, text), stored by chunk: a chunk is what one Arrow batch held."""
    arrow_batches(docs.sparkSession)
    rows = id_and_text(docs, doc_id, text).select("doc_id", F.encode("text", "UTF-8").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, part in enumerate(parts):
            chunk = (task << 24) + i
            names = [_name(x.as_py()) for x in part.column("text")]
            n = len(names)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * n, pa.int64()), pa.array(range(chunk << 20, (chunk << 20) + n), pa.int64()),
                part.column("doc_id"), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                pa.array([len(x.as_py()) for x in part.column("text")], pa.int64()), part.column("text"),
            ], ["chunk", "row", "doc_id", "t1", "t2", "size", "text"])
            give_back()

    return bucketed(rows.mapInArrow(
        run, f"chunk long, row long, doc_id {kind}, t1 long, t2 long, size long, text binary"
    ), "chunk")


def _references(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(chunk, row, t1, t2, start, windows, key, h1, h2): the pieces of all texts, without their bytes."""
    names = ["chunk", "row", "t1", "t2", "start", "windows", *PIECE]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found, hashes, pieces = [], [], []
            for text in part.column("text"):
                whole, count = text.as_py(), 0
                for columns in cuts(whole, window, gram):
                    found.append(columns)
                    ends = columns[0] + columns[1] - 1 + window
                    hashes += [xxhash.xxh3_128_digest(whole[a:b]) for a, b in zip(columns[0].tolist(), ends.tolist())]
                    count += len(ends)
                pieces.append(count)
            of = [np.repeat(part.column(c).to_numpy(), np.array(pieces, np.int64)) for c in ("chunk", "row", "t1", "t2")]
            runs = [np.concatenate(c) for c in zip(*found)] or [np.empty(0, np.int64)] * 3
            both = np.frombuffer(b"".join(hashes), ">i8").reshape(-1, 2).astype(np.int64)  # as `_name`
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*of, *runs, *both.T)], names)
            give_back()

    found = rows.where(F.col("size") >= window).select("chunk", "row", "t1", "t2", "text").mapInArrow(
        run, ", ".join(f"{c} long" for c in names))
    return durable(found, compression="zstd")


def _differ(*names: str) -> Column:
    """Whether a group has two rows that differ in one of the columns, without gathering it."""
    out = F.lit(False)
    for c in names:
        out = out | (F.min(c) < F.max(c))
    return out


def _texts_of(kinds: DataFrame, rows: DataFrame, window: int) -> DataFrame:
    """The bytes of distinct pieces, from the text of one reference each."""

    def run(wanted: pa.Table, texts: pa.Table) -> pa.Table:
        of = dict(zip(texts.column("row").to_pylist(), texts.column("text")))
        names = ["row", "start", "windows", *PIECE, "n"]
        found = [
            (key, h1, h2, n, of[row].as_py()[start : start + windows - 1 + window])
            for row, start, windows, key, h1, h2, n in zip(*(wanted.column(c).to_pylist() for c in names))
        ]
        give_back()
        return pa.Table.from_batches([_table(found, [*PIECE, "n", "piece"], [pa.int64()] * 4 + [pa.binary()])])

    return kinds.groupBy("chunk").cogroup(rows.select("chunk", "row", "text").groupBy("chunk")).applyInArrow(
        run, "key long, h1 long, h2 long, n long, piece binary")


def _runs(pieces: DataFrame, window: int, task_bytes: int) -> DataFrame:
    """(key, h1, h2, begin, stop): runs of repeated windows in distinct pieces (key, h1, h2, n, piece). A
    piece with n of 2 or more repeats as a whole; the construction finds the windows that pieces share."""
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()[0]
    tasks = int(total // task_bytes) + 1
    spread = pieces.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))

    def run(table: pa.Table) -> pa.Table:
        found = []
        names = [table.column(c).to_pylist() for c in (*PIECE, "n", "piece")]
        for key, h1, h2, n, hit in zip(*names[:4], repeated_windows(names[4], window)):
            if n > 1 and len(hit):
                found.append((key, h1, h2, 0, len(hit)))
            elif hit.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                found += [(key, h1, h2, b, e) for b, e in zip(edge[::2].tolist(), edge[1::2].tolist())]
        give_back()
        return pa.Table.from_batches([_table(found, [*PIECE, "begin", "stop"], [pa.int64()] * 5)])

    return durable(spread.groupBy("task").applyInArrow(run, "key long, h1 long, h2 long, begin long, stop long"))


def _split(pieces: DataFrame, step: int, window: int, gram: int) -> DataFrame:
    """Parts of pieces by `finer`, each with its parent piece and its place there."""
    names = [*PIECE, "n", "at", "p_key", "p_h1", "p_h2", "piece"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for key, h1, h2, n, piece in zip(*(part.column(c).to_pylist() for c in (*PIECE, "n", "piece"))):
                for at, windows, fine in finer(piece, key, step, window, gram):
                    sub = piece[at : at + windows - 1 + window]
                    out.append((fine, *_name(sub), n, at, key, h1, h2, sub))
            yield _table(out, names, [pa.int64()] * 8 + [pa.binary()])

    return durable(pieces.select(*PIECE, "n", "piece").mapInArrow(
        run, ", ".join(f"{c} {'binary' if c == 'piece' else 'long'}" for c in names)), compression="zstd")


def _distinct_runs(pieces: DataFrame, window: int, gram: int, step: int, crowded: int, task_bytes: int) -> DataFrame:
    """Runs of repeated windows in all distinct pieces. A key with more than `crowded` pieces is cut by
    finer keys, until each is small; the last step's keys are whole windows, of which there is one."""
    keys = pieces.groupBy("key").agg(F.count("*").alias("pieces"), F.sum("n").alias("uses"))
    many = durable(keys.where(F.col("pieces") > crowded).select("key"))
    if step == 1 or not many.limit(1).count():
        return _runs(pieces, window, task_bytes)
    runs = _runs(pieces.join(many, "key", "left_anti"), window, task_bytes)
    step = -(-step // NARROWER)
    parts = _split(pieces.join(many, "key", "left_semi"), step, window, gram)
    kinds = parts.groupBy(*PIECE).agg(F.sum("n").alias("n"), F.first("piece").alias("piece"))
    alive = kinds.join(parts.groupBy("key").agg(F.sum("n").alias("uses")).where("uses > 1"), "key", "left_semi")
    below = _distinct_runs(durable(alive, compression="zstd"), window, gram, step, crowded, task_bytes)
    up = parts.select(*PIECE, "at", "p_key", "p_h1", "p_h2").join(below, list(PIECE)).select(
        F.col("p_key").alias("key"), F.col("p_h1").alias("h1"), F.col("p_h2").alias("h2"),
        (F.col("begin") + F.col("at")).alias("begin"), (F.col("stop") + F.col("at")).alias("stop"),
    )
    return durable(runs.unionByName(up))


def drop_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM,
    crowded: int = CROWDED, task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) per row: the removed spans (begin, stop) of the text's UTF-8 bytes, and
    the other bytes joined. A byte goes if a string of `window` bytes that covers it starts anywhere
    else too, in the same text or another row's; strings are those of the texts as given.

    NULL text is empty. Texts shorter than `window` lose nothing, rows that repeat a longer text lose
    all of it. Rows with a NULL or repeated id are rows like any other. No rows give no rows.

    A text is read four times by map tasks and never shuffled; of its pieces only those move whose key
    occurs in two places, once for all references to the same bytes.
    """
    rows = _chunks(docs, doc_id, text)
    ids = rows.select("chunk", "row", "t1", "t2", "size")
    references = _references(rows, window, gram)
    alive = references.groupBy("key").agg(_differ("t1", "t2", "start").alias("alive")).where("alive").select("key")
    texts = durable(ids.groupBy("t1", "t2").agg(F.count("*").alias("rows"), F.min("row").alias("row")))
    live = durable(
        references.drop("t1", "t2").join(alive, "key", "left_semi").join(texts.select("row"), "row", "left_semi"),
        compression="zstd",
    )
    place = F.struct("chunk", "row", "start", "windows")
    kinds = live.groupBy(*PIECE).agg(F.count("*").alias("n"), F.min(place).alias("at")).select(*PIECE, "n", "at.*")
    pieces = durable(_texts_of(kinds, rows, window), compression="zstd")
    runs = _distinct_runs(pieces, window, gram, window - gram + 1, crowded, task_bytes)
    spans = live.join(runs, list(PIECE)).select(
        "chunk", "row", (F.col("start") + F.col("begin")).alias("begin"),
        (F.col("start") + F.col("stop") - 1 + window).alias("stop"),
    )
    copies = ids.where(F.col("size") >= window).join(texts.where("rows > 1").select("t1", "t2"), ["t1", "t2"]).select(
        "chunk", "row", F.lit(0).cast("long").alias("begin"), F.col("size").alias("stop"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    whole = rows.select("chunk", "row", "doc_id", "text").groupBy("chunk")
    return whole.cogroup(spans.unionByName(copies).groupBy("chunk")).applyInArrow(
        _removed, f"doc_id {kind}, n_bytes long, spans array<struct<begin: long, stop: long>>, kept binary")


def _removed(texts: pa.Table, spans: pa.Table) -> pa.Table:
    by = np.lexsort([spans.column("begin").to_numpy(), spans.column("row").to_numpy()])
    row, begin, stop = (spans.column(c).to_numpy()[by] for c in ("row", "begin", "stop"))
    at = np.searchsorted(row, texts.column("row").to_numpy(), "left").tolist()
    to = np.searchsorted(row, texts.column("row").to_numpy(), "right").tolist()
    found, kept, size = [], [], []
    for i, j, text in zip(at, to, texts.column("text")):
        data = text.as_py()
        size.append(len(data))
        merged: list = []
        for b, e in zip(begin[i:j].tolist(), stop[i:j].tolist()):
            if merged and b <= merged[-1]["stop"]:
                merged[-1]["stop"] = max(e, merged[-1]["stop"])
            else:
                merged.append({"begin": b, "stop": e})
        found.append(merged)
        cuts = [0, *(x for s in merged for x in (s["begin"], s["stop"])), len(data)]
        kept.append(b"".join(data[b:e] for b, e in zip(cuts[::2], cuts[1::2])) if merged else data)
    give_back()
    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    return pa.table([texts.column("doc_id"), pa.array(size, pa.int64()), pa.array(found, span), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])
