"""Repeated passages against brute force over all windows."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hostlens.llm import suffixes as sx
from hostlens.llm.suffixes import cut, drop_repeats, finer, repeated_windows


def brute(texts, window):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, bool)
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i + 1 : i + 1 + window] = True
        edge = np.flatnonzero(np.diff(gone.astype(np.int8))).tolist()
        out.append((len(d), list(zip(edge[::2], edge[1::2])), bytes(b for b, g in zip(d, gone[1:]) if not g)))
    return out


def run(spark, texts, window, **how):
    rows = [(i, t, "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, chunk string, key string, n string, piece string").repartition(3)
    found = sorted(drop_repeats(df, window=window, **how).collect(), key=lambda r: r.doc_id)
    return [(r.n_bytes, [(s.begin, s.stop) for s in r.spans], bytes(r.kept)) for r in found]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab\x00", max_size=24).map(str.encode), min_size=1, max_size=8), st.integers(1, 9))
def test_construction(pieces, window):
    seen = Counter(p[i : i + window] for p in pieces for i in range(len(p) - window + 1))
    want = [[seen[p[i : i + window]] > 1 for i in range(len(p) - window + 1)] for p in pieces]
    assert [x.tolist() for x in repeated_windows(pieces, window)] == want


def test_construction_over_all_bytes():
    r = random.Random(1)
    pieces = [bytes(r.randrange(256) for _ in range(300)) for _ in range(20)]
    pieces += [p[:70] + pieces[0][40:270] for p in pieces[:5]] + [b"\xff" * 300, b"\x00" * 300]
    seen = Counter(p[i : i + 200] for p in pieces for i in range(len(p) - 199))
    want = [[seen[p[i : i + 200]] > 1 for i in range(len(p) - 199)] for p in pieces]
    assert [x.tolist() for x in repeated_windows(pieces, 200)] == want


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop"])
def test_equal_windows_have_equal_keys(alphabet, monkeypatch):
    monkeypatch.setattr(sx, "SEGMENT", 37)
    r = random.Random(2)
    text = "".join(r.choices(alphabet, k=300)).encode() + b"a" * 60
    text += text[100:190]
    window, gram, keys, fine = 12, 4, {}, {}
    starts = []
    for start, n, key in cut(text, window, gram):
        starts += range(start, start + n)
        piece = text[start : start + n - 1 + window]
        for i in range(n):
            assert keys.setdefault(piece[i : i + window], key) == key
        for step in (3, 1):
            inside = []
            for at, m, k in finer(piece, key, step, window, gram):
                inside += range(at, at + m)
                for i in range(at, at + m):
                    assert fine.setdefault((step, piece[i : i + window]), k) == k
            assert inside == list(range(n))
    assert starts == list(range(len(text) - window + 1))
    by_key = Counter(k for (step, _), k in fine.items() if step == 1)
    assert set(by_key.values()) == {1}  # the finest key is the window itself


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh é", k=r.randrange(2, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(r.choices(words, k=n))

    shared = prose(30)
    texts = [prose(r.randrange(1, 60)) for _ in range(30)]
    texts += [prose(5) + shared + prose(7) for _ in range(12)]  # one passage between different texts
    copy = prose(40)
    texts += [copy] * 6 + [copy[: 60 + 9 * i] + "#" + copy[61 + 9 * i :] for i in range(8)]
    return [*texts, None, "", "short", "x" * 400, "ab" * 150, shared + " " + shared, "日本語 " * 40, texts[3] + prose(2)]


def test_against_brute_force(spark):
    texts = corpus(3)
    assert run(spark, texts, 50, gram=8) == brute(texts, 50)


def test_crowded_keys_are_cut_finer(spark):
    texts = corpus(4)
    assert run(spark, texts, 50, gram=8, crowded=2, task_bytes=3000) == brute(texts, 50)


def test_two_hundred_bytes(spark):
    r = random.Random(5)
    passage = "".join(r.choices("abcdefghij ", k=200))
    texts = ["one " + passage + " two", passage[:199], "tri!" + passage + "x", "alone " * 3, passage[1:] + "y"]
    got = run(spark, texts, 200)
    assert got == brute(texts, 200) and got[0][1] == [(4, 204)]


def test_small_tables(spark):
    for texts in ([], [None], ["", None], ["word " * 100]):
        assert run(spark, texts, 200) == brute(texts, 200)
