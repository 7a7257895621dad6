"""The incremental quality profile and the fingerprint tree of run differences."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.operators import profile as PF
from slicewise.operators import quality as QA
from slicewise.session import scratch_path

DAY = "day_no"


@pytest.fixture(scope="module")
def table(spark):
    d = spark.range(20_000).select(
        (F.col("id") % 10).alias("day_no"), (F.col("id") % 1000).cast("double").alias("x"),
        F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit(float("nan"))).otherwise(
            F.sqrt(F.col("id").cast("double"))).alias("y"), F.lit(None).cast("double").alias("empty"))
    path = os.path.join(scratch_path(spark, "profile-input"))
    d.write.partitionBy("day_no").parquet(path)
    return spark.read.parquet(path).select("x", "y", "empty", "day_no")


def _report(spark, path):
    return {r["column"]: r for r in PF.profile_report(PF.read_profile(spark, path)).collect()}


def test_profile_of_appended_days_equals_the_whole(spark, table):
    path, cols = scratch_path(spark, "profile"), ["x", "y", "empty"]
    PF.add_days(table, path, F.col(DAY), only=list(range(9)), cols=cols)
    assert _report(spark, path)["x"]["rows"] == 18_000
    PF.add_days(table, path, F.col(DAY), only=[9], cols=cols)
    PF.add_days(table, path, F.col(DAY), only=[9], cols=cols)  # again: replaced, not counted twice
    got = _report(spark, path)
    exact = {r["column"]: r for r in QA.ranges(table.withColumn("y", F.nanvl("y", F.lit(None))), cols).collect()}
    for c in cols:
        assert got[c]["rows"] == 20_000
        assert [got[c][k] for k in ("min", "max", "mean", "std")] == [exact[c][k] for k in ("min", "max", "mean", "std")]
    assert got["y"]["n"] == 10_000 and got["y"]["missing_pct"] == 50.0
    assert got["empty"]["q1"] is None and got["empty"]["distinct"] == 0 and got["empty"]["outlier_pct"] == 0.0
    for c in ("x", "y"):
        v = np.sort([r[0] for r in table.where(F.col(c).isNotNull() & ~F.isnan(c)).select(c).collect()])
        for q, p in (("q1", 0.25), ("q3", 0.75)):
            low, high = np.searchsorted(v, got[c][q], "left"), np.searchsorted(v, got[c][q], "right")
            assert low <= (p + PF.RANK_ERROR) * len(v) and high >= (p - PF.RANK_ERROR) * len(v)
        assert abs(got[c]["distinct"] / len(set(v)) - 1) < PF.DISTINCT_ERROR
        out = QA.outliers_iqr(table.withColumn("y", F.nanvl("y", F.lit(None))), [c]).first()["outlier_pct"]
        assert abs(got[c]["outlier_pct"] - out) <= 2 * 100 * (PF.RANK_ERROR + 1 / PF.GRID)


def test_adding_a_day_reads_that_day_only(table):
    plan = PF.sketch_days(table.where(F.col(DAY).isin([9])), F.col(DAY), ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day_no" in plan and "= 9)" in plan


def test_score_from_sketches_is_near_the_exact_score(spark, table):
    t = table.withColumn("y", F.nanvl("y", F.lit(None)))
    t = t.unionByName(t.where("x < 100"))
    exact = QA.quality_score(t).first()
    got = PF.profile_score(PF.sketch_days(t, F.col(DAY), ["x", "y", "empty", "day_no"])).first()
    assert got["total_records"] == exact["total_records"]
    assert got["avg_missing_pct"] == pytest.approx(exact["avg_missing_pct"], abs=1e-6)
    assert abs(got["duplicate_pct"] - exact["duplicate_pct"]) <= 100 * PF.DISTINCT_ERROR
    assert abs(got["quality_score"] - exact["quality_score"]) <= 100 * (PF.DISTINCT_ERROR + 2 * PF.RANK_ERROR + 2 / PF.GRID)


def test_rows_without_a_day_and_empty_tables(spark):
    d = spark.createDataFrame([(1.0, None), (2.0, 3), (None, 3)], "x double, day_no long")
    s = PF.sketch_days(d, F.col(DAY), ["x"])
    assert {(r["column"], r["day"], r["rows"], r["n"]) for r in s.collect()} == {
        ("x", -1, 1, 1), ("x", 3, 2, 1), ("*", -1, 1, 1), ("*", 3, 2, 2)}
    assert PF.profile_report(PF.sketch_days(d.where("false"), F.col(DAY), ["x"])).collect() == []


def _diff(a, b):
    return tuple(QA.diff_runs(a, b).first())


def test_diff_counts_rows_of_either_side(spark):
    schema = "a int, b string, c double"
    left = [(None, "x", 1.0), (1, None, 0.0), (1, None, 0.0), (2, "y", float("nan")), (3, "z", None)]
    a = spark.createDataFrame(left, schema)
    assert _diff(a, spark.createDataFrame([*left[::-1][:-2], (1, None, -0.0), left[0]], schema)) == (0, 0, True)
    # a null moved to another column, one copy less, one row more
    b = spark.createDataFrame([(1, "x", None), *left[2:], (4, "w", 2.0)], schema)
    assert _diff(a, b) == (2, 2, False)
    assert _diff(a, a.where("false")) == (5, 0, False)
    assert _diff(a.where("false"), a.where("false")) == (0, 0, True)
    # columns by name and of a wider type
    assert _diff(a, a.select("c", "b", F.col("a").cast("long").alias("a"))) == (0, 0, True)


def test_diff_finds_one_row_in_many(spark):
    a = spark.range(200_000).select("id", (F.col("id") % 7).alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 123_456, F.lit(9)).otherwise(F.col("v")))
    assert _diff(a, b) == (1, 1, False)
    assert _diff(a, a.repartition(13)) == (0, 0, True)


def test_equal_runs_group_no_rows(spark):
    a = spark.range(1000).select("id", F.col("id").cast("string").alias("t"))
    plan = QA.diff_runs(a, a)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan  # the grouping by value has an empty input
