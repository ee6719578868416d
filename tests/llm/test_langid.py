"""Language identification on toy languages."""

import random

from pyspark.sql import functions as F

from hostlens.llm import langid
from tests.llm.conftest import EDGES, documents

PARTS = {"xx": ["ka", "to", "mi", "ra", "ku"], "yy": ["sch", "und", "ver", "ein", "öß"], "zz": ["tion", "eau", "ç", "oui", "les"]}


def made(n=240):
    r = random.Random(2)
    rows = []
    for i in range(n):
        lang = ("xx", "xx", "yy", "zz")[i % 4]
        words = ["".join(r.choice(PARTS[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(2, 60))]
        rows.append((1000 + i, " ".join(words), lang, "a"))
    return rows


def test_held_out_accuracy_and_rejection(spark):
    rows = made()
    docs = documents(spark, rows + [(r[0], r[1], None, r[3]) for r in EDGES] + [(50, "12 34 !!", None, "a")])
    model = langid.fit(docs, langid.in_training(F.col("doc_id")))
    assert model.languages == ["xx", "yy", "zz"]
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [r for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 20 and sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    for doc_id in (1, 2, 3, 50):
        assert (got[doc_id]["lang_pred"], got[doc_id]["score"], got[doc_id]["rejected"]) == ("und", 0.0, True)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & {1, 2, 3, 50} and {r[0] for r in rows} <= ids
    assert langid.identify(docs.limit(0), model).count() == 0


def test_without_labels_all_is_unknown(spark):
    docs = documents(spark, [(r[0], r[1], None, r[3]) for r in EDGES])
    model = langid.fit(docs, langid.in_training(F.col("doc_id")))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}


def test_subwords_ignore_case_and_what_separates_words():
    a, b = langid.subwords("Ab cd"), langid.subwords("aB 12, CD!")
    assert a.tolist() == b.tolist() and len(langid.subwords("1 2 !")) == 0
