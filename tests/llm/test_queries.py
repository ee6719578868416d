"""The registered queries: oracles on given tables, and on rows that hold what those may not."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import compare
from hostlens.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import EDGES, documents
from tests.llm.test_spans import HARD

TABLES = "/root/testdata/sf0.001"


def duck(folder):
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet{'' if folder == TABLES else '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert compare(QUERIES[name](spark, TABLES).toArrow(), duck(TABLES).sql(ORACLES[name]).to_arrow_table()) == "ok"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles_on_hard_rows(spark, tmp_path, name):
    secret = "Zx81Qw92Er73Ty64Ui55"
    rows = EDGES + [(100 + i, t, "en", f"s{i % 3}") for i, t in enumerate(HARD)]
    rows += [(200 + i, f"is {secret} copied", "en", f"s{i}") for i in range(4)] + [(300, "is Po10Lk29Mj38Nh47Bg56", "en", "s1")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    pages = [(i, "http://a.example", t) for i, t in enumerate(["x", None, "", "x", "é" * 100, "WARC/1.1\r\n\r\n"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES[name](spark, str(tmp_path)).toArrow()
    assert compare(got, duck(str(tmp_path)).sql(ORACLES[name]).to_arrow_table()) == "ok"


def test_registered_once_each():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 11)) and set(QUERIES) <= set(entry.queries())
