"""The report reads the stored requests where they lie."""

from checks import monitor_queries as mq
from hostlens.sources.scratch import durable


def test_stored_requests_are_not_written_again(spark, monkeypatch):
    stored, seen = durable(spark.range(3).selectExpr("id", "id = 1 AS is_reference")), []
    monkeypatch.setattr(mq.fx, "scored_features", lambda *a: stored)
    monkeypatch.setattr(mq.mon, "monitor", lambda traffic, reference, *a: seen.extend([traffic, reference]))
    monkeypatch.setattr(mq, "shared", lambda name, spark, sf, build: build())
    mq._monitor(spark, "nowhere")
    assert [sorted(x.inputFiles()) for x in seen] == [sorted(stored.inputFiles())] * 2
