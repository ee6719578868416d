"""Distances of sources against brute force in Python's integers."""

import random
import re
from functools import partial

import pytest

from hostlens.llm import divergence as dv

TERM = re.compile("[A-Za-z\u0080-\U0010ffff]+")


def lowered(term):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def brute(rows, min_docs, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs = [([lowered(t) for t in TERM.findall(text)], source) for text, x, source in rows if x == lang]
        kept = sorted(t for t in {t for d, _ in docs for t in d} if sum(t in d for d, _ in docs) >= min_docs)
        sources = sorted({s for _, s in docs}, key=lambda s: s.encode())

        def share(of):
            counts = {t: sum(d.count(t) for d, s in docs if s in of) for t in kept}
            total = sum(counts.values())
            return counts, {t: 1 + 10**9 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

        _, q = share(sources)
        by = {s: share([s]) for s in sources}
        for s in sources:
            n, p = by[s]
            far = [(-sum(abs(p[t] - by[o][1][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            more = [(q[t] - p[t], t.encode(), t) for t in kept if n[t] > 0 and p[t] > q[t]]
            for part, found in (("pair", sorted(far)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **settings):
    shape = "text string, lang string, source string, terms string, number string, n string, p string, counts string"
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], shape).repartition(3)
    found = dv.divergence(df, **settings).collect()
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found)


def texts(n, seed, sources=4):
    r = random.Random(seed)
    words = ["Ab", "aB", "é", "É", "straße", "x", "日本", "𝒳y", "zz", "don't", "a1b", "w\x00v"]
    langs = ["en", "de", None, ""]
    return [(" ".join(r.choices(words, k=r.randrange(0, 9))), r.choice(langs), r.choice([f"s{i}" for i in range(sources)] + [None])) for _ in range(n)]


def test_against_brute_force(spark):
    rows = [*texts(120, 1), (None, "en", "s0"), ("", "xx", None), ("alone", "yy", "s1"), ("alone", "yy", "s2")]
    assert run(spark, rows, min_docs=8) == brute(rows, 8) != []


def test_slices_and_tiles_change_nothing(spark, monkeypatch):
    rows = texts(90, 2, sources=9)
    rows += [("only here " * 2000, "en", "s1")] + [("same text", "de", "s2")] * 40  # a long text, a group of copies
    monkeypatch.setattr(dv, "slices_of", partial(dv.slices_of, part=1))
    assert run(spark, rows, min_docs=5, slice_terms=3, top=4, tile=(3, 2)) == brute(rows, 5, 4) != []


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("few words", "en", "a"), ("few words", "en", "b")]])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows, 30)


def test_shares_are_exact(spark):
    df = spark.createDataFrame([(3_000_000_000_017, 7_000_000_000_000_003, 11)], "n long, total long, v long")
    want = 1 + 10**9 * (3_000_000_000_017 + 5) // (7_000_000_000_000_003 + 55)
    assert df.select(dv._share("n", "total")).first()[0] == want
