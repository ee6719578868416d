"""Byte-pair encoding and decoding through a table of distinct words."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, bucketed, give_back, id_and_text

CHUNK_MB = 16
TOGETHER = 2000  # words that the tokenizer takes at a time
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

# Fixed value: how the byte-level vocabularies cut a text into words, blanks as Unicode has them.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)


class Vocabulary:
    """A tokenizer file, read on the driver; tasks get its text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pieces = dict(spec["model"]["vocab"]) | {t["content"]: t["id"] for t in spec["added_tokens"]}

    @property
    def id_type(self) -> str:
        return "<u2" if max(self.pieces.values()) < 1 << 16 else "<u4"


def words_of(text: Column, special: list[str]) -> Column:
    """The words of a text, in order; a special token's string is a word of its own."""
    def cut(part: Column) -> Column:
        return F.regexp_extract_all(part, F.lit(WORDS), F.lit(0))

    if not special:
        return cut(text)
    found = "|".join(_quoted(s) for s in sorted(special, key=len, reverse=True))
    has = F.lit(False)
    for s in special:
        has = has | F.contains(text, F.lit(s))
    between = F.transform(F.split(text, found, -1), cut)
    marks = F.transform(
        F.regexp_extract_all(text, F.lit(f"({found})"), F.lit(1)), lambda m: F.array(m)
    )
    mixed = F.flatten(F.flatten(F.transform(
        between, lambda part, i: F.filter(F.array(part, F.get(marks, i)), lambda a: a.isNotNull())
    )))
    return F.when(has, mixed).otherwise(cut(text))


def _quoted(literal: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() else c for c in literal)


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of equal weight, which packs well."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.compress(sizes + b"".join(parts), 3)


def _unpack(packed: bytes) -> list[bytes]:
    data = zstandard.decompress(packed)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = np.cumsum(np.frombuffer(data, "<i8", n, 8)) + 8 * (n + 1)
    return [data[e - s : e] for s, e in zip(np.frombuffer(data, "<i8", n, 8), ends)]


def positions(
    docs: DataFrame, special: list[str], parts: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Texts as word numbers. Two kinds of rows: per document (chunk, doc_id, numbers), and per chunk
    and part of the word table (chunk, part, cell): a cell holds the chunk's distinct words that hash
    to the part, with their numbers. A chunk is one Arrow batch, bounded in bytes; its most frequent
    words have the smallest numbers."""
    arrow_batches(docs.sparkSession, CHUNK_MB)
    rows = id_and_text(docs, doc_id, text).select("doc_id", words_of(F.col("text"), special).alias("words"))
    kind = rows.schema["doc_id"].dataType
    schema = f"chunk long, doc_id {kind.simpleString()}, numbers binary, part int, cell binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, batch in enumerate(batches):
            lists = batch.column("words")
            coded = lists.flatten().dictionary_encode()
            at = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(-np.bincount(at, minlength=len(coded.dictionary)), kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            at = rank[at]
            words = coded.dictionary.cast(pa.binary()).take(pa.array(order)).to_pylist()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            packed = [_pack(_planes(at[e - s : e])) for s, e in zip(sizes, ends)]
            chunk, k, ids = (task << 24) + n, len(packed), batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * k, pa.int64()), ids, pa.array(packed, pa.binary()),
                 pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names,
            )
            part = np.fromiter((zlib.crc32(w) % parts for w in words), np.int64, len(words))
            by_part = np.argsort(part, kind="stable")
            cells, of = [], []
            for numbers in np.split(by_part, np.flatnonzero(np.diff(part[by_part])) + 1):
                if len(numbers):
                    own = [words[i] for i in numbers.tolist()]
                    cells.append(_pack(
                        _planes(np.diff(numbers, prepend=0)), _planes(np.fromiter(map(len, own), np.uint32, len(own))),
                        b"".join(own),
                    ))
                    of.append(int(part[numbers[0]]))
            k = len(cells)
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk] * k, pa.int64()), pa.nulls(k, ids.type), pa.nulls(k, pa.binary()),
                 pa.array(of, pa.int32()), pa.array(cells, pa.binary())], names,
            )
            del lists, coded, words, cells, packed
            give_back()

    return rows.mapInArrow(run, schema)


def encode_cells(cells: DataFrame, vocabulary: Vocabulary, parts: int) -> DataFrame:
    """(of_chunk, cell) for (chunk, part, cell) rows: cells with ids in place of words.

    A part of the word table is in one task: its distinct words are encoded once, as they first come.
    What a task holds is its share of the distinct words, so it falls with the number of parts.
    """
    shared = cells.sparkSession.sparkContext.broadcast(vocabulary.text)  # one vocabulary file
    kind = vocabulary.id_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer, table = None, {}
        for batch in batches:
            out = []
            for cell in batch.column("cell"):
                if tokenizer is None:
                    tokenizer = Tokenizer.from_str(shared.value)
                    tokenizer.no_truncation()
                    tokenizer.no_padding()
                numbers, sizes, data = _unpack(cell.as_py())
                ends = np.cumsum(_numbers(sizes)).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in table]
                for k in range(0, len(new), TOGETHER):
                    some = new[k : k + TOGETHER]
                    coded = tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
                    table.update((w, np.array(e.ids, kind).tobytes()) for w, e in zip(some, coded))
                ids = [table[w] for w in words]
                out.append(_pack(numbers, _planes(np.fromiter(map(len, ids), np.uint32, len(ids))), b"".join(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(out, pa.binary())], ["of_chunk", "cell"])
        table.clear()
        give_back()

    return cells.repartition(parts, "part").mapInArrow(run, "of_chunk long, cell binary")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_table(vocabulary: Vocabulary) -> list[bytes]:
    """The bytes of each id; one row per vocabulary entry bounds it."""
    letters, special = byte_letters(), set(vocabulary.special)
    table = [b""] * (max(vocabulary.pieces.values(), default=-1) + 1)
    for piece, i in vocabulary.pieces.items():
        table[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
    return table


def decode(ids: np.ndarray, pieces: pa.Array) -> str:
    """Join ids to pieces and read the bytes as UTF-8."""
    found = pieces.take(pa.array(ids.astype(np.int64)))
    data = found.buffers()[2]
    return data.to_pybytes().decode("utf-8", "replace") if len(found) and data is not None else ""


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text",
    also: tuple[str, ...] = ("ids", "decoded"),
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), and if asked for the ids and the decoded text.

    Every text is cut into words. The distinct words of each chunk of documents go to the table of
    distinct words, which is spread over tasks by hash and encodes each word once; the ids come back
    to the chunk and are put into the documents by position. Decoding joins every document's ids to
    the broadcast id-to-piece table. Word numbers are stored in buckets by chunk, so they are not
    shuffled; words travel packed, once per chunk, so no frequent word is a hot key. NULL and empty
    texts have no ids. Each input row gives one row.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = bucketed(positions(docs, vocabulary.special, parts, doc_id, text), "chunk")
    found = encode_cells(stored.where("cell IS NOT NULL").select("chunk", "part", "cell"), vocabulary, parts)
    rows = stored.where("numbers IS NOT NULL").select("chunk", "doc_id", "numbers")
    doc_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += "".join(f", {c} {'array<int>' if c == 'ids' else 'string'}" for c in also)
    shared, kind = spark.sparkContext.broadcast(piece_table(vocabulary)), vocabulary.id_type

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        cells = [_unpack(c.as_py()) for c in right.column("cell")]
        numbers = [np.cumsum(_numbers(c[0])).astype(np.int64) for c in cells]
        counts = [_numbers(c[1]).astype(np.int64) // np.dtype(kind).itemsize for c in cells]
        n = sum(map(len, numbers))
        start, size, written = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, object)
        begin = 0
        for no, count, cell in zip(numbers, counts, cells):
            ends = np.cumsum(count)
            start[no], size[no] = begin + ends - count, count
            begin += int(count.sum())
            text = list(map(str, np.frombuffer(cell[2], kind).tolist()))
            written[no] = [",".join(text[e - c : e]) for e, c in zip(ends.tolist(), count.tolist())]
        flat = np.frombuffer(b"".join(c[2] for c in cells), kind)
        del cells
        pieces = pa.array(shared.value, pa.large_binary())
        out: dict[str, list] = {name: [] for name in names[1:]}
        for packed in left.column("numbers"):
            words = _numbers(_unpack(packed.as_py())[0])
            each = size[words]
            at = np.arange(each.sum()) + np.repeat(start[words] - np.cumsum(each) + each, each)
            ids = flat[at]
            decoded = decode(ids, pieces)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(written[words].tolist()).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
            if "ids" in out:
                out["ids"].append(ids.astype(np.int32))
            if "decoded" in out:
                out["decoded"].append(decoded)
        columns = [left.column("doc_id"), *(pa.array(out.pop(n), types[n]) for n in names[1:])]
        del written, flat, start, size
        give_back()
        return pa.table(columns, names)

    names = [c.split()[0] for c in schema.split(", ")]
    types = {
        "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(),
        "ids": pa.list_(pa.int32()), "decoded": pa.string(),
    }
    return rows.groupBy("chunk").cogroup(found.groupBy("of_chunk")).applyInArrow(run, schema)
