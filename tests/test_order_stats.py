import numpy as np
import pytest

from slicewise.functions import order_stats
from slicewise.functions.order_stats import exact_quantiles


@pytest.mark.parametrize("slices", [4096, 2])
def test_exact_quantiles_match_numpy(spark, slices, monkeypatch):
    monkeypatch.setattr(order_stats, "SLICES", slices)
    rng = np.random.default_rng(7)
    a = rng.normal(size=3000)
    b = np.round(rng.exponential(size=3000), 1)          # many ties
    c = np.where(rng.random(3000) < 0.4, 1.0, rng.random(3000))  # one value holds 40 %
    nulls = rng.random(3000) < 0.1
    rows = [(float(x), float(y), None if n else float(z)) for x, y, z, n in zip(a, b, c, nulls)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["a", "b", "c"], probs, accuracy=100)
    for name, arr in (("a", a), ("b", b), ("c", c[~nulls])):
        want = np.quantile(arr, probs)  # linear interpolation
        assert np.allclose(got[name], want, rtol=0, atol=1e-12), (name, got[name], want)


def test_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("accuracy", [10000, 20])
def test_ranks_between_two_heavy_values_end(spark, accuracy):
    """Few distinct values, the quartiles exactly between two of them: minutes, and two values."""
    df = spark.range(120_000).selectExpr("cast(id % 60 as double) minute", "cast(id % 2 as double) two",
                                         "case when id = 0 then double('inf') when id = 1 then double('-inf') "
                                         "else cast(id as double) end ends")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["minute", "two", "ends"], probs, accuracy=accuracy)
    assert np.allclose(got["minute"], np.quantile(np.arange(120_000) % 60, probs))
    assert np.allclose(got["two"], np.quantile(np.arange(120_000) % 2, probs))
    assert got["ends"][0] == -np.inf and got["ends"][-1] == np.inf
    assert np.allclose(got["ends"][1:4], np.quantile(np.arange(1, 120_001), probs)[1:4], atol=1.5)
