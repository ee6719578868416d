"""Order MinHash against a plain version, and the next document."""

import hashlib
import random
import re
import struct
from collections import Counter

import xxhash

from hostlens.llm import orderhash
from tests.llm.conftest import EDGES, documents


def h_long(x, seed=42):
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", x), seed & (2**64 - 1)))


def signed(x):
    return x - 2**64 if x >> 63 else x


def h_words(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return signed(seed)


def h_int(x, seed):
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", x), seed & (2**64 - 1)))


def plain(text):
    words = re.findall(r"[^ \t\n\x0b\f\r]+", text)
    words = [part for w in words for part in ([w] if len(w) <= 16 else w)]
    kmers = [h_words(words[i : i + 3]) for i in range(len(words) - 2)] or ([h_words(words)] if words else [])
    seen, numbered = Counter(), []
    for i, k in enumerate(kmers):
        numbered.append((h_int(seen[k], h_long(k)), i))
        seen[k] += 1
    out = []
    for b in range(-16, 16):
        own = sorted(g for g in numbered if g[0] >> 59 == b)[:2]
        if not own:
            out.append(None)
            continue
        seed = 42
        for g, _ in sorted(own, key=lambda x: x[1]):
            seed = h_long(g, seed) & (2**64 - 1)
        out.append(seed & 0xFFFFFFFF)
    return out


def test_signatures_and_edits(spark):
    r = random.Random(4)
    texts = ["a b", "a b c", "a a a a a a a a a a", "w" * 100, " ".join(str(r.randint(0, 40)) for _ in range(3000)),
             " ".join(str(r.randint(0, 10**6)) for _ in range(900))]
    rows = EDGES + [(100 + i, t, "en", "a") for i, t in enumerate(texts)]
    docs = documents(spark, rows)
    for row in orderhash.fingerprints(docs).join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        assert row["signatures"] == plain(row["text"] or ""), (row["text"] or "")[:40]
    got = orderhash.edit_report(docs).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0)))
    texts = [x[1] or "" for x in order]
    want = Counter()
    for k, t in enumerate(texts):
        nxt, third = texts[(k + 1) % len(texts)], len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        want[(order[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((g["doc_id"], g["n_chars"], g["edited_sha256"]) for g in got) == want
    for g in got:
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1 and len(g["fingerprint"]) == 256
    assert orderhash.edit_report(docs.limit(0)).count() == 0
    (one,) = orderhash.edit_report(docs.where("doc_id = 104")).collect()
    assert one["near_next"] == 1.0 and one["near_edited"] < 1.0


def test_order_matters(spark):
    words = [f"w{i}" for i in range(300)]
    blocks = [words[i : i + 30] for i in range(0, 300, 30)]
    moved = [w for b in reversed(blocks) for w in b]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(moved), "en", "a"), (3, " ".join(words[:290]), "en", "a")]
    sig = {r["doc_id"]: r["signatures"] for r in orderhash.fingerprints(documents(spark, rows)).collect()}
    same = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 32
    assert same(1, 3) > 0.8 > 0.7 > same(1, 2)


def test_unspaced_text_keeps_its_fingerprint_when_shifted(spark):
    r = random.Random(8)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(4000))
    docs = documents(spark, [(1, text, "zh", "a"), (2, "X" + text, "zh", "a"), (3, text[:2000] + "yz" + text[2000:], "zh", "a")])
    a, b, c = (x["signatures"] for x in orderhash.fingerprints(docs).orderBy("doc_id").collect())
    for other in (b, c):
        assert sum(x == y for x, y in zip(a, other)) >= 28
