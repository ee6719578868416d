"""Draws below a bound, and the slices made from them, on any number of rows."""

from pyspark.sql import functions as F

from hostlens.operators import drift
from hostlens.operators.estimation import low_draws, with_draws


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_low_draws_are_the_draws_below_the_bound(spark):
    df = spark.createDataFrame(
        [(f"k{i % 290}" if i % 50 else None, None if i % 31 == 0 else i % 7 / 10) for i in range(300)], "k string, b double")
    got = low_draws(df, "k", "b", 20, 42).toDF("key", "draw", "u")
    want = with_draws(df.withColumnRenamed("k", "key"), "key", 20, 42).where("u < b").select("key", "draw", "u")
    assert got.schema == want.schema and want.count() > 500
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_draws_are_generated_code(spark):
    """Functions over arrays are interpreted: two microseconds a draw, 200 draws a row."""
    df = spark.range(1000).selectExpr("string(id) AS k", "0.1D AS b")
    assert "lambda" not in plan(low_draws(df, "k", "b", 200, 42))


def test_slices_do_not_shuffle_the_reference(spark):
    reference = spark.range(3000, numPartitions=4).select(F.col("id").cast("string").alias("request_id"), F.col("id").alias("x"))
    sliced = drift.slices(reference, "request_id", 100, 7)
    assert "BroadcastHashJoin" in plan(sliced) and "SortMergeJoin" not in plan(sliced)
    assert sorted(r["count"] for r in sliced.groupBy("slice").count().collect()) == [100] * 7


def test_whole_numbers_are_counted_without_rounding(spark):
    values = [F.lit(3).alias(f) if f != "domain_entropy" else F.lit(1 / 3).alias(f) for f in drift.FEATURES]
    counts = drift.value_counts(spark.range(5).select(*values))
    assert counts._jdf.queryExecution().analyzed().toString().count("round(") == 1
    assert {(r.feature, r.value, r.n) for r in counts.collect()} == {
        (f, round(1 / 3, 12) if f == "domain_entropy" else 3.0, 5) for f in drift.FEATURES}
