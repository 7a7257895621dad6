import hashlib

import pandas as pd
from pyspark.sql import functions as F

from slicewise.operators import prep as PR
from slicewise.plans import registry as R


def _h(k, seed=42):
    return hashlib.md5(f"{k}|{seed}".encode()).hexdigest()


def test_sample_n_is_smallest_hashes(spark, sf):
    f = R.features(spark, sf)
    keys = [r.row_key for r in f.select("row_key").collect()]
    got = sorted(r.row_key for r in PR.sample_n(f, 500).select("row_key").collect())
    want = sorted(sorted(keys, key=_h)[:500])
    assert got == want
    assert PR.sample_n(f, 10**9).count() == len(keys)


def test_stratified_split_counts(spark, sf):
    f = R.features(spark, sf)
    s = PR.stratified_split(f, "slice_id")
    pdf = s.select("row_key", "slice_id", "split").toPandas()
    for sid, g in pdf.groupby("slice_id"):
        k = int(0.2 * len(g))
        assert (g.split == "test").sum() == k
        assert sorted(g[g.split == "test"].row_key) == sorted(sorted(g.row_key, key=_h)[:k])


def test_kfold_matches_ntile(spark, sf):
    from conftest import unique_by
    f = unique_by(R.features(spark, sf).select("row_key"), "row_key")
    got = PR.kfold_assign(f, "row_key").toPandas().sort_values("row_key")
    n = len(got)
    keys = sorted(got.row_key)
    q, rem = divmod(n, 5)
    want = []
    for i in range(n):
        want.append(i // (q + 1) + 1 if i < (q + 1) * rem else rem + (i - (q + 1) * rem) // q + 1)
    assert list(got.fold) == want
    assert list(got.row_key) == keys


def test_split_is_repartition_proof(spark, sf):
    f = R.features(spark, sf)
    a = PR.random_split(f).select("row_key", "split")
    b = PR.random_split(f.repartition(7)).select("row_key", "split")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_missing_columns_are_named(spark, sf):
    f = R.features(spark, sf)
    import pytest
    with pytest.raises(ValueError, match="nope"):
        PR.check_columns(f, ["nope"], "allocation_efficiency")


def test_standardize_zero_std_is_one(spark):
    df = spark.createDataFrame([(1.0, 2.0, "train"), (1.0, 4.0, "train"), (1.0, 6.0, "test")],
                               "a double, b double, split string")
    out = PR.standardize(df, ["a", "b"]).orderBy("b").collect()
    assert [r.a for r in out] == [0.0, 0.0, 0.0]
    assert [r.b for r in out] == [-1.0, 1.0, 3.0]


def test_tie_breaking_at_the_cut(spark, sf, monkeypatch):
    """With a one-digit hash prefix almost every row lies in the cut's prefix; the cut must still
    be exact, by the full hash and then the key."""
    monkeypatch.setattr(PR, "PREFIX_DIGITS", 1)
    f = R.features(spark, sf)
    keys = [r.row_key for r in f.select("row_key").collect()]
    got = sorted(r.row_key for r in PR.sample_n(f, 777).select("row_key").collect())
    assert got == sorted(sorted(keys, key=lambda k: (_h(k), k))[:777])
    pdf = PR.stratified_split(f, "slice_id").select("row_key", "slice_id", "split").toPandas()
    for sid, g in pdf.groupby("slice_id"):
        k = int(0.2 * len(g))
        assert sorted(g[g.split == "test"].row_key) == sorted(sorted(g.row_key, key=lambda x: (_h(x), x))[:k])


def test_repeated_keys(spark):
    """Rows sharing a key: exactly n rows, every row once, exact shares per stratum."""
    df = spark.range(100).selectExpr("'same' row_key", "id", "cast(id % 4 as int) stratum").where("id < 90")
    assert PR.sample_n(df, 50).count() == 50 and PR.sample_n(df, 0).count() == 0
    assert PR.sample_n(df, 500).count() == 90 and PR.sample_n(df.where("false"), 5).count() == 0
    out = PR.stratified_split(df, "stratum", test_fraction=0.5)
    assert out.count() == 90 and out.select("id").distinct().count() == 90
    assert {r.stratum: r.c for r in out.where("split = 'test'").groupBy("stratum").agg(F.count("*").alias("c")).collect()} \
        == {0: 11, 1: 11, 2: 11, 3: 11}


def test_stratified_split_many_strata(spark, sf):
    """Thousands of strata, one with a third of the rows, and null as a stratum."""
    f = R.features(spark, sf).withColumn("stratum", F.when(F.col("slice_id") == 0, F.lit("big")).when(
        F.col("slice_id") == 1, F.md5("row_key")))
    pdf = f.select("row_key", "stratum").toPandas()
    out = PR.stratified_split(f, "stratum").select("row_key", "stratum", "split").toPandas()
    assert len(out) == len(pdf)
    for s_, g in out.groupby("stratum", dropna=False):
        k = int(0.2 * len(g))
        assert sorted(g[g.split == "test"].row_key) == sorted(sorted(g.row_key, key=lambda x: (_h(x), x))[:k])


def test_split_of_nothing_and_of_all(spark):
    """Shares of 0 and 1, and one that rounds to 1 in 16 bits, put every row on one side."""
    df = spark.range(3000).selectExpr("cast(id as string) row_key")
    for share, tests in ((0.0, 0), (1.0, 3000), (0.999999, 3000)):
        assert PR.random_split(df, test_fraction=share).where("split = 'test'").count() == tests
