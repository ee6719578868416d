"""Texts of languages that the model has not learnt."""

from pyspark.sql import functions as F

from hostlens.llm import langid
from tests.llm.conftest import documents
from tests.llm.test_langid import made

FOREIGN = [
    "Сегодня утром мы пошли на рынок и купили свежие овощи.", "今天天气很好，我们一起去公园散步吧。",
    "Σήμερα το πρωί πήγαμε στην αγορά με τα παιδιά.", "fghjw pqxyf wjhgy bdfgh jwxqp ghwyb fpjdx",
]


def test_unlearnt_languages_are_rejected(spark):
    rows = made(480)
    docs = documents(spark, rows + [(i, t, None, "a") for i, t in enumerate(FOREIGN)])
    trained = langid.in_training(F.col("doc_id"))
    got = langid.identify(docs, langid.fit(docs, trained)).withColumn("held", ~trained).collect()
    assert all(r["rejected"] for r in got if r["doc_id"] < len(FOREIGN))
    held = [r["rejected"] for r in got if r["held"] and r["doc_id"] >= 1000]
    assert len(held) > 40 and sum(held) <= 0.05 * len(held)
