"""WARC archives: written from pages, read back, and assembled into one row per capture."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlens.llm.common import arrow_batches, lookup, text_or_empty
from hostlens.sources.scratch import durable, scratch_path

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base 32
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PER_FILE = 1000  # captures of one archive, at most
FILE_BYTES = 64 << 20  # payload bytes of one archive, unless one payload is larger
SIZES = (1 << 16, 1 << 20, 1 << 24)  # payloads from each of these on go to archives of their own
STEP = 1 << 20  # compressed bytes that a reader takes at a time
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value


def base32_sha1(data: Column) -> Column:
    """Upper-case base-32 SHA-1: 160 bits are 32 digits, eight from each ten hex digits."""
    digits = F.sha1(data)

    def digit(i: Column) -> Column:
        forty = F.conv(F.substr(digits, (F.floor(i / 8) * 10 + 1).cast("int"), F.lit(10)), 16, 10).cast("long")
        five = F.floor(forty / F.pow(F.lit(32.0), 7 - i % 8)).cast("long") % 32
        return F.substr(F.lit(ALPHABET), (five + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), digit), "")


def _record_id(kind: str, page: Column) -> Column:
    """A UUID from what the record is of, the same in every run."""
    h = F.md5(F.concat(F.lit(f"{kind}:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    ]), F.lit(">"))


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record, less the last line feed, which the text writer puts after it. NULL headers are left out."""
    lines = [F.lit("WARC/1.1")] + [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, *lines, size), F.lit(CRLF * 2), block, F.lit("\r\n\r"))


def plan_records(pages: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(page, page_id, url, html, digest, size, refers_to): of payloads of min_bytes or more that are
    equal, the smallest page_id is stored and the others refer to it; of repeated rows of one page_id
    the first in an arbitrary but fixed order is stored."""
    rows = pages.select(
        F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"),
        text_or_empty(html).alias("html"),
    )
    stored = durable(rows.select(
        F.monotonically_increasing_id().alias("row"), "*", base32_sha1(F.col("html").cast("binary")).alias("digest"),
        F.octet_length("html").cast("long").alias("size"),
    ), compression="zstd")  # row numbers hold from here on
    narrow = stored.where(F.col("size") >= min_bytes).select("row", "page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "row")).alias("first"))
    again = lookup(narrow, durable(first), "digest", "inner").where("row <> first.row").select(
        "row", F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("first_row")
    )
    return stored.join(again, "row", "left")


def write_archives(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, per_file: int = PER_FILE,
) -> None:
    """Gzipped WARC files at `path`: a request, a response or revisit, and a metadata record per row.

    Archives are bounded by captures and by payload bytes: pages of a size class share archives, fewer of
    them the larger they may be, down to one. A revisit has no payload; it names the response's record and the payload's digest. NULL html is
    an empty payload, a NULL url an empty target.
    """
    planned = plan_records(pages, page_id, url, html, min_bytes)
    page = F.col("row")
    main, revisit = _record_id("response", page), F.col("first_row").isNotNull()
    target = F.coalesce(F.regexp_replace("url", r"[\r\n]", ""), F.lit(""))
    date = {"WARC-Date": F.lit(DATE), "WARC-Target-URI": target}
    also = {"WARC-Concurrent-To": main}
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = F.concat(F.lit(
        f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
    ), F.col("size").cast("string"), F.lit(CRLF * 2))
    host = F.coalesce(F.parse_url(F.when(target.rlike(r"^https?://[A-Za-z0-9.-]+(?:[:/?#]|$)"), F.regexp_extract(target, r"^https?://[A-Za-z0-9.-]+", 0)), F.lit("HOST")), F.lit(""))
    request = _record(
        {"WARC-Type": F.lit("request"), "WARC-Record-ID": _record_id("request", page), **date, **also,
         "Content-Type": F.lit("application/http; msgtype=request")},
        F.concat(F.lit("GET "), F.when(target == "", "/").otherwise(target), F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2)),
    )
    response = _record(
        {"WARC-Type": F.when(revisit, "revisit").otherwise("response"), "WARC-Record-ID": main, **date,
         "WARC-Payload-Digest": digest,
         "WARC-Profile": F.when(revisit, REVISIT),
         "WARC-Refers-To": F.when(revisit, _record_id("response", F.col("first_row"))),
         "Content-Type": F.lit("application/http; msgtype=response")},
        F.concat(http, F.when(revisit, "").otherwise(F.col("html"))),
    )
    fields = {
        "page-id": F.col("page_id"), "payload-bytes": F.col("size"), "refers-to-page": F.col("refers_to")
    }
    metadata = _record(
        {"WARC-Type": F.lit("metadata"), "WARC-Record-ID": _record_id("metadata", page), **date, **also,
         "Content-Type": F.lit("application/warc-fields")},
        F.concat_ws("", *[F.concat(F.lit(f"{k}: "), v.cast("string"), F.lit(CRLF)) for k, v in fields.items()]),
    )
    found = pages.select(_size_class(F.octet_length(text_or_empty(html))).alias("c")).distinct().collect()
    present = sorted(r["c"] for r in found) or [0]
    for i, c in enumerate(present):
        lines = planned if len(present) == 1 else planned.where(_size_class(F.col("size")) == c)
        most = min(per_file, max(FILE_BYTES // SIZES[c], 1)) if c < len(SIZES) else 1
        out = lines.select(F.explode(F.array(request, response, metadata)).alias("value")).write
        out.mode("append" if i else "errorifexists").option("compression", "gzip").option("maxRecordsPerFile", 3 * most).text(path)


def _size_class(size: Column) -> Column:
    out = F.lit(0)
    for limit in SIZES:
        out = out + (size >= limit).cast("int")
    return out


def inflate(data: bytes, step: int = STEP) -> Iterator[bytes]:
    """The decompressed bytes in pieces of a few `step`, of all gzip members one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        member = zlib.decompressobj(47)
        while at < len(view) and not member.eof:
            part = view[at : at + step]
            out = member.decompress(part, 4 * step)
            at += len(part) - len(member.unused_data) - len(member.unconsumed_tail)
            yield out
        if not member.eof:
            yield member.flush()
            if not member.eof:
                raise ValueError("archive ends inside a gzip member")


def parse(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by its Content-Length; one record is held at a
    time. An archive that ends inside a record is an error."""
    held = bytearray()

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (at := held.find(b"WARC/")) < 0:
            del held[:-4]
            if not more():
                return
        del held[:at]
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(len(held) - 3, 0)
            if not more():
                raise ValueError("archive ends inside a record's headers")
        lines = held[:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        while len(held) < stop:
            if not more():
                raise ValueError("archive ends inside a record")
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        yield headers, block


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all archives at `path`: type, id, concurrent_to, refers_to, url, date,
    digest as declared, block fields, and of payloads their size and digest as read (and themselves).

    A task holds one compressed archive and one record at a time, whatever the archive's length.
    """
    arrow_batches(spark, 8)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = (
        "type string, id string, concurrent_to string, refers_to string, url string, date string, "
        "declared string, fields string, size long, digest string, payload binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(content: bytes) -> Iterator[list]:
        for h, block in parse(inflate(content)):
            kind = h.get("warc-type")
            http = kind in ("response", "revisit")
            body = block.partition(b"\r\n\r\n")[2] if http else b""
            yield [
                kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"),
                None if http else block.decode("utf-8", "replace"), len(body) if kind == "response" else None,
                base64.b32encode(hashlib.sha1(body).digest()).decode() if kind == "response" else None,
                body if payload and kind == "response" else None,
            ]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 8 + [pa.int64(), pa.string(), pa.binary()]
        for part in parts:
            for content in part.column("content"):
                held: list[list] = []
                size = 0
                for row in rows(content.as_py()):
                    held.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return files.mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (id, url, date, response, request, metadata), where request and
    metadata records join the response or revisit that they are concurrent to. A capture without one
    has NULL there; of several, the smallest record id is taken, so a capture stays one row."""
    def side(kind: str) -> DataFrame:
        return records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("id")).agg(
            F.min(F.struct(F.col("id").alias("record_id"), "fields")).alias(kind)
        )

    main = records.where(F.col("type").isin("response", "revisit")).select("id", "url", "date", F.struct(
        "type", "refers_to", "declared", "size", "digest", "payload"
    ).alias("response"))
    return main.join(side("request"), "id", "left").join(side("metadata"), "id", "left")


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract("metadata.fields", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))


def capture_report(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) per capture. Size and digest
    of a response are those of the payload that was read; of a revisit those of its metadata record
    and its declared digest."""
    return captures.select(
        _field("page-id").cast("long").alias("page_id"),
        F.coalesce("response.size", _field("payload-bytes").cast("long")).alias("payload_bytes"),
        F.coalesce("response.digest", F.regexp_replace("response.declared", "^sha1:", "")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), _field("refers-to-page").cast("long").alias("refers_to"),
    )


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the pages' archives to shared storage, read them back, and report every capture."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, page_id, url, html, min_bytes)
    return capture_report(assemble(read_records(spark, path, payload=False)))
