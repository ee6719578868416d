"""Benchmark regions against alignment of every item with every text."""

import random
import re

import pytest

from hostlens.llm import decontaminate as dc
from tests.llm.conftest import EDGES, documents


def least_edits(item, text):
    """Edits of the best match of the item anywhere in the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def sentence(r, n):
    return " ".join("".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8))) for _ in range(n))


def changed(r, text, edits):
    s = list(text)
    for _ in range(edits):
        p = r.randrange(len(s))
        kind = r.random()
        if kind < 0.34:
            s[p] = "#"
        elif kind < 0.67:
            del s[p]
        else:
            s.insert(p, "~")
    return "".join(s)


def test_finds_all_within_the_budget_and_no_more():
    r = random.Random(5)
    items = [sentence(r, n) for n in (3, 8, 15, 30, 60)] + ["abc", "a" * 60]
    block = dc.Block(list(range(len(items))), [dc.codes_of(t) for t in items], dc.Q, dc.RATE)
    texts = [sentence(r, 40) for _ in range(5)] + [items[0] * 3, "a" * 200, "ab" * 50, ""]
    for item in items[:5]:
        for share in (0.0, 0.05, 0.1, 0.2):
            texts.append(sentence(r, 10) + " " + changed(r, item.upper(), int(share * len(item))) + "\n" + sentence(r, 5))
    got = dc.find(block, [dc.codes_of(t) for t in texts])
    pairs = {(f[0], f[1]) for f in got}
    for t, text in enumerate(texts):
        for i, item in enumerate(items):
            budget = int(block.edits[i])
            low = text.lower().replace("\n", " ")
            near = least_edits(item, low) <= budget
            if len(item) < dc.Q:
                near = re.search(rf"(?<![^\W_]){re.escape(item)}(?![^\W_])", low) is not None
            assert ((t, i) in pairs) == near, (t, i)
    for t, i, start, end, edits in got:
        assert least_edits(items[i], texts[t].lower().replace("\n", " ")[start:end]) <= edits <= block.edits[i]


def test_documents_and_stage(spark, monkeypatch):
    monkeypatch.setattr(dc, "WINDOW", 2000)
    r = random.Random(6)
    item, other = sentence(r, 30), sentence(r, 25)
    benchmark = spark.createDataFrame([(7, item), (8, other), (9, None), (10, " "), (7, item)], "item_id long, text string")
    rows = EDGES + [
        (50, "before " + item + " after", "en", "a"), (51, sentence(r, 300) + " " + changed(r, item, 6) + " " + sentence(r, 900), "en", "a"),
        (52, item[: len(item) // 2], "en", "a"), (53, item + " and " + item + " " + other, "en", "a"), (53, item, "en", "b"),
        *((100 + i, item, "en", "a") for i in range(10)),
    ]
    docs = documents(spark, rows)
    for chars in (1 << 20, 10):  # one block; one item per block
        got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in dc.contamination(docs, benchmark, block_chars=chars).collect())
        found = {(d, i) for d, i, _ in got}
        assert found == {(50, 7), (51, 7), (53, 7), (53, 8), *((100 + i, 7) for i in range(10))}
        assert sum(g[:2] == (53, 7) for g in got) == 3 and (50, 7, 0) in got
    kept = dc.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([*(r[0] for r in EDGES), 52], key=str)
    nothing = benchmark.limit(0)
    assert dc.contamination(docs, nothing).count() == 0 and dc.drop_contaminated(docs, nothing).count() == len(rows)
    assert dc.contamination(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("length", [7, 20, 81, 226, 394])
def test_budget_is_the_lemma(length):
    edits, shared = dc.budget(length)
    assert shared == length - dc.Q + 1 - dc.Q * edits >= 1 and edits <= dc.RATE * length


def test_short_items_match_whole_words_only(spark, monkeypatch):
    monkeypatch.setattr(dc, "WINDOW", 60)
    benchmark = spark.createDataFrame([(1, "a"), (2, "yes"), (3, "4-2"), (4, "東京都")], "item_id long, text string")
    texts = ["私は東京都に住む", "alpha beta", "only A there", "yesterday eyes", "oh yes!", "(4-2)", "14-2 4-23", "", None, "say yes"]
    # At every place of a text that is read in windows.
    texts += ["x" * k + "yes" + "x" * (400 - k) for k in range(0, 400, 7)]
    texts += ["x" * k + " yes " + "x" * (400 - k) for k in range(0, 400, 7)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    want = {i for i, t in enumerate(texts) if t and re.search(r"(?<!\w)(?:a|yes|4-2)(?!\w)|東京都", t.lower())}
    assert {r["doc_id"] for r in dc.contamination(docs, benchmark).collect()} == want
    kept = {r["doc_id"] for r in dc.drop_contaminated(docs, benchmark).collect()}
    assert kept == set(range(len(texts))) - want
