"""Language-model scores against a plain context trie with symbol exclusion."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from hostlens.llm import ppm
from tests.llm.conftest import EDGES, documents

TEXTS = [
    "the cat sat on the mat", "the cat ran", "a dog sat on a log", "Über die Straße", "zzzz zzzz zzzz", "THE CAT", "\x00\x01\x00",
    "the mat the mat the mat " * 40, "日本語 日本", "on", "cat", "unseen wörds hère",
]
ROWS = [r for r in EDGES if r[0] != 4] + [(100 + i, t, "en", "a") for i, t in enumerate(TEXTS)]


def trained(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 != 2


def low(text):
    return (text or "").encode().lower()


def symbols(text):
    return [256] * 3 + list(low(text)) + [256]


def reference(rows):
    words, trie = Counter(), [defaultdict(Counter) for _ in range(4)]
    for doc_id, text, *_ in rows:
        if trained(doc_id):
            words.update([*low(text).split(), None])
            s = symbols(text)
            for p in range(3, len(s)):
                for k in range(4):
                    trie[k][tuple(s[p - k : p])][s[p]] += 1
    total, distinct = sum(words.values()), len(words)

    def score(text):
        out, s = 0.0, symbols(text)
        for p in range(3, len(s)):
            excluded = set()
            for k in (3, 2, 1, 0):
                seen = {a: n for a, n in trie[k].get(tuple(s[p - k : p]), {}).items() if a not in excluded}
                if not seen:
                    continue
                whole = sum(seen.values()) + len(seen)
                if s[p] in seen:
                    out += math.log10(seen[s[p]] / whole)
                    break
                out += math.log10(len(seen) / whole)
                excluded |= set(seen)
            else:
                out -= math.log10(257 - len(excluded))
        return out

    def base(text):
        return sum(math.log10((words[w] + 1) / (total + distinct + 1)) for w in [*low(text).split(), None])

    return words, total, base, score


@pytest.mark.parametrize("rows", [ROWS, [(d, t, *r) for d, t, *r in ROWS if not trained(d)]], ids=["all", "no training rows"])
def test_scores(spark, rows):
    words, total, base, score = reference(rows)
    got = ppm.score_documents(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        text = texts[r["doc_id"]]
        tokens = [*low(text).split(), None]
        assert r["held_out"] == (not trained(r["doc_id"])) and r["train_tokens"] == total
        assert (r["n_tokens"], r["n_known"]) == (len(tokens), sum(words[w] > 0 for w in tokens))
        assert r["base_score"] == pytest.approx(base(text), abs=1e-9)
        assert r["score"] == pytest.approx(score(text), abs=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    grams = spark.createDataFrame([(97, 98, 99, 100, 3), (97, 98, 99, 101, 1), (1, 98, 99, 102, 2), (2, 3, 99, 103, 5)], "a int, b int, c int, d int, n long")
    grams = grams.selectExpr("((cast(a as long) * 257 + b) * 257 + c) * 257 + d AS gram", "n")
    wanted = spark.range(257).selectExpr("((97L * 257 + 98) * 257 + 99) * 257 + id AS gram")
    costs = [r["cost"] for r in ppm.gram_costs(wanted, ppm.trie(grams)).collect()]
    assert sum(10**c for c in costs) == pytest.approx(1)


def test_sparse_and_dense_counts_agree(monkeypatch):
    texts = [low(t) for t in TEXTS]
    train = [i % 2 == 0 for i in range(len(texts))]
    square = ppm._Chunk(texts)
    dense = ppm._counts(square, texts, train)
    square.pairs = type("Wide", (), {"__len__": lambda s: 5000, "__getitem__": lambda s, k: k})()
    wide = ppm._counts(square, texts, train)
    assert dense[1].sum() == wide[1].sum() and len(dense[0]) == len(wide[0])


def test_no_rows(spark):
    assert ppm.score_documents(documents(spark, EDGES).limit(0)).count() == 0
