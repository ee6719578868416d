"""The stages one after the other, on rows of which each stage has something to do."""

import random

import corpus_pipeline
from tests.llm.conftest import EDGES, documents
from tests.llm.test_langid import made


def test_stages(spark, tmp_path):
    r = random.Random(9)
    rows = made(160)
    known = [w for row in rows if row[2] == rows[50][2] for w in row[1].split()]
    item = " ".join(r.choices(known, k=40))  # its language must not be what drops it
    rows = rows + [(x[0], x[1], None, x[3]) for x in EDGES]
    rows += [(9001, rows[50][1] + " " + item, "xx", "a"), (9002, "".join(rows[40][1]), "xx", "b"), (9003, " ".join(reversed(rows[45][1].split())) + " password=abcdef1234", "yy", "b")]
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        new = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert new.columns == docs.columns
        seen.append({x["doc_id"] for x in new.select("doc_id").collect()})
        docs = new
        if name == "secret_scan":
            assert new.where("doc_id = 9003").first()["text"].endswith(" [SECRET]")
    language, dedup, clean, masked, tokens = seen
    assert not language & {1, 2, 3} and 9001 in language
    assert 9002 in language and 9002 not in dedup and rows[40][0] in dedup
    assert 9001 in dedup and 9001 not in clean and clean == masked == tokens == dedup - {9001}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x["doc_id"] for x in whole.collect()} == tokens
