"""Archives written, read back and assembled."""

import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hostlens.llm import warc

PAGES = [
    (1, "http://a.example/x", "<p>é same</p>", "c"), (2, None, "<p>é same</p>", "c"), (3, "bad url\r\nX: y", None, "c"),
    (4, "http://é.example/ä", "", "c"), (5, "http://a.example", "WARC/1.1\r\nContent-Length: 3\r\n\r\nab\r\n\r\n", None),
    (6, "u", "\x00𝒳\r\n\r"), (7, "u", "long " * 100_000), (8, "u", "long " * 100_000), (9, "http://b.example", "x"),
    *((100 + i, "http://hot.example", "hot") for i in range(20)),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([r[:3] for r in PAGES], "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("row", F.lit(1)).repartition(3)


@pytest.mark.parametrize("least", [0, 4])
def test_round_trip(pages, least):
    got = {r["page_id"]: r for r in warc.round_trip(pages, min_bytes=least).collect()}
    first = {}
    for page, _, html, *_ in PAGES:
        data = (html or "").encode()
        ref = first.setdefault(data, page) if len(data) >= least else page
        r = got[page]
        assert r["payload_bytes"] == len(data)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if ref == page else ("revisit", ref))
    assert len(got) == len(PAGES)


def test_repeated_rows_and_no_rows(spark, pages):
    twice = warc.round_trip(pages.where("page_id = 9").union(pages.where("page_id = 9"))).collect()
    assert sorted(r["record_type"] for r in twice) == ["response", "revisit"]
    assert {r["refers_to"] for r in twice if r["record_type"] == "revisit"} == {9}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_captures_are_nested_and_carry_payloads(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w")
    records = warc.read_records(spark, f"file://{tmp_path}/w")
    assert records.groupBy("type").count().where("type = 'request'").first()["count"] == len(PAGES)
    captures = warc.assemble(records).collect()
    assert len(captures) == len(PAGES) and all(c["request"] and c["metadata"] for c in captures)
    payloads = {bytes(c["response"]["payload"]) for c in captures if c["response"]["type"] == "response"}
    assert payloads == {(p[2] or "").encode() for p in PAGES}


def test_incomplete_transactions():
    data = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    (headers, block), = warc.parse(iter([data]))
    assert headers["warc-type"] == "response" and block == b"ab\r\nc"


def test_assemble_takes_one_record_of_each_kind(spark):
    rows = [("response", "a", None), ("request", "r2", "a"), ("request", "r1", "a"), ("revisit", "b", None), ("metadata", "m", "zz")]
    records = spark.createDataFrame(rows, "type string, id string, concurrent_to string")
    for c in ("refers_to", "url", "date", "declared", "fields", "digest"):
        records = records.withColumn(c, F.lit(None).cast("string"))
    records = records.withColumn("size", F.lit(1).cast("long")).withColumn("payload", F.lit(None).cast("binary"))
    got = {r["id"]: r for r in warc.assemble(records).collect()}
    assert got["a"]["request"]["record_id"] == "r1" and got["b"]["request"] is None and len(got) == 2


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", (100, 1000, 10_000))
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    r = random.Random(1)
    sizes = [0, 5, 99, 100, 999, 1000, 9999, 10_000, 90_000] * 20
    rows = [(i, f"http://x/{i}", r.randbytes(n).hex()[:n]) for i, n in enumerate(sizes)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/w")
    for f in sorted((tmp_path / "w").glob("*.gz")):
        blocks = [len(b) for h, b in warc.parse(warc.inflate(f.read_bytes(), 64)) if h["warc-type"] == "response"]
        assert sum(b - 200 for b in blocks) <= 4000 or len(blocks) == 1
    captures = warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w")).collect()
    assert sorted(c["response"]["size"] for c in captures if c["response"]["type"] == "response") == sorted(
        len(html) for html in {html for _, _, html in rows})
    assert len(captures) == len(rows)


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_members_one_after_the_other(step):
    blocks = [b"", b"a" * 100_000, b"WARC/1.1\r\n\r\n", bytes(range(256)) * 50]
    whole = b"".join(
        gzip.compress(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n") for b in blocks)
    assert [b for _, b in warc.parse(warc.inflate(whole, step))] == blocks
    for cut in (len(whole) - 1, len(whole) // 2):
        with pytest.raises(ValueError):
            list(warc.parse(warc.inflate(whole[:cut], step)))


def test_a_record_that_is_cut_off():
    data = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc"
    for part in (data, data[:20]):
        with pytest.raises(ValueError):
            list(warc.parse(iter([part])))
