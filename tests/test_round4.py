"""What the findings of round 4 were about: work that grew faster than it must."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slicewise.operators import forest as FO
from slicewise.operators import network as NW
from slicewise.operators import quality as QA
from slicewise.plans import properties as PR


def test_f1_cells_are_told_apart_only_where_they_part(monkeypatch):
    """Cells that stay together down a tree are scored by one value, not put down one by one."""
    names, cuts = ["slice_id", "allocated_rbgs", "a"], [[0.5, 1.5], [3.5, 9.5], [1.5]]
    # node 0 splits on a; its right child on the groups, their left child on the slice
    feature, cut, child = np.array([2, 0, 1, 0, 0, 0, 0], np.uint8), np.array([0, 255, 1, 0, 255, 255, 255], np.uint8), np.array([1, 1, 3, 5, 4, 5, 6], np.int32)
    flat = FO.Flat(np.array([0], np.int32), feature, cut, child, np.array([0, 0.1, 0, 0, 0.2, 0.3, 0.4]), 4)
    seen = []
    old = np.unpackbits
    monkeypatch.setattr(FO.np, "unpackbits", lambda a, **kw: seen.append(len(a)) or old(a, **kw))
    a = np.arange(40) % 4
    x = FO.bin_rows([0 * a, 0 * a, a], cuts)
    got = FO.cell_scores(flat, cuts, names, x, np.ones(40), 12, 3)
    s, g = np.arange(36) // 12, np.arange(36) % 12 + 1
    want = np.where(a[:, None] <= 1, 0.1, np.where(g <= 9, np.where(s == 0, 0.3, 0.4), 0.2))
    assert np.array_equal(got, want)
    assert sum(seen) == 2 * (a > 1).sum()  # two partings, and only in the states that get there


def test_f2_a_step_of_the_network_shuffles_few_rows(spark, monkeypatch):
    t = spark.range(2000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 50 / 50).alias("x"), (F.col("id") % 50 / 50).alias("y"))
    made = []
    old = type(t).mapInArrow
    monkeypatch.setattr(type(t), "mapInArrow", lambda self, f, schema, *a, **kw: made.append(old(self, f, schema, *a, **kw)) or made[-1])
    net = NW.fit_network(t, ["x"], "y", steps=3)
    tasks = made[-1].rdd.getNumPartitions()
    assert made[-1].count() <= tasks * (len(net.weights) // 4000 + 1)
    monkeypatch.setattr(NW, "PIECE", 1000)
    assert np.array_equal(NW.fit_network(t, ["x"], "y", steps=3).weights, net.weights)


def test_f4_unequal_runs_of_many_columns_are_planned_without_a_filter_on_hashes(spark):
    """A filter on a hash of sixteen renamed columns took the planner minutes."""
    a = spark.range(500).select(F.col("id").cast("string").alias("k"), *[(F.col("id") * (i + 3) % 11).cast("double").alias(f"c{i}") for i in range(15)])
    a = a.withColumn("c3", F.when(F.col("c3") > 2, F.col("c3")))
    b = a.where("c1 < 9").withColumn("c2", F.when(F.col("c0") > 0, F.col("c2"))).unionByName(a.where("c5 = 4"))
    d = QA.diff_runs(a, b)
    plan = d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("Filter" in line and "xxhash64" in line for line in plan)
    left, right = (Counter(map(tuple, x.collect())) for x in (a, b))
    r = d.first()
    assert (r["left_only"], r["right_only"]) == ((left - right).total(), (right - left).total()) and not r["equal"]
    assert QA.diff_runs(a, a).first()["equal"]


def test_f4_faulty_inputs_make_the_features_once(spark, sf, monkeypatch):
    made = []
    old = PR.FE.kpi_features
    monkeypatch.setattr(PR.FE, "kpi_features", lambda raw, **kw: made.append(len(raw.inputFiles())) or old(raw, **kw))
    rows = {r["name"]: r["n"] for r in PR.q_faulty_inputs(spark, sf).collect()}
    assert rows["duplicates"] > 0 and rows["left only"] > 0
    assert len(made) == 3 and min(made) >= spark.sparkContext.defaultParallelism  # features, states, rows without grants


def test_f4_a_constant_is_one_however_its_rows_are_dealt_out(spark):
    """0.5 / n * n is not 0.5 for every n, so the merged variance of equal values can be above 0."""
    for n in (2, 3, 7):
        f = spark.range(0, 1234, 1, n).select(F.lit(0.1).alias("a"), F.col("id").alias("b"), F.lit(float("inf")).alias("c"), F.when(F.col("id") == 5, F.lit(1.5)).alias("d"))
        got = {r["column"]: (r["variance"], r["is_constant"]) for r in QA.constant_check(f.where("id % 9 > 2")).collect()}
        assert got["a"] == (0.0, True) and not got["b"][1] and not got["c"][1] and got["d"] == (None, None)


def test_f10_upper_levels_place_only_the_rows_of_a_tree(monkeypatch):
    """Rows of weight 0 do not walk a tree, and its histograms are those of plain sums."""
    got, placed = [], []

    class Packed:
        drop = groupBy = applyInArrow = lambda self, *_: self
        collect = lambda self: []

        def mapInArrow(self, f, schema):
            got.append(f)
            return self
    old = FO.Top.ends
    monkeypatch.setattr(FO.Top, "ends", lambda self, key, bins: placed.append(len(bins)) or old(self, key, bins))
    rng = np.random.default_rng(5)
    n, top = 20_000, FO.Top({(0, 1): {1: (0, 3), 2: (1, 2)}})
    h, fold, y, x = rng.integers(0, FO.PRIME, n), np.zeros(n, np.int32), rng.integers(0, 2**20, n).astype(np.int32), rng.integers(0, 8, (n, 2)).astype(np.uint8)
    growth = FO._Growth(Packed(), [0], 2, 5, 42, 8, 2, 1, 2)
    growth.top = top
    growth._level([(0, 0, 1), (0, 1, 4), (0, 1, 5)])  # node 3 is not asked for
    blob = pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in (("h", h), ("fold", fold), ("y", y), ("x", x))})
    out = {(r["tree"], r["node"]): r for b in got[0](iter([blob])) for r in b.to_pylist()}
    w = [FO.weights(h, 42, t) for t in (0, 1)]
    assert sum(placed) == sum((v > 0).sum() for v in w)
    node = np.where(x[:, 0] > 3, 3, 4 + (x[:, 1] > 2))
    for (t, at), rows in {(0, 1): np.full(n, True), (1, 4): node == 4, (1, 5): node == 5}.items():
        for f in (0, 1):
            cells = slice(8 * f, 8 * f + 8)
            assert out[t, at]["count"][cells] == np.bincount(x[rows, f], w[t][rows], 8).astype(int).tolist()
            assert out[t, at]["total"][cells] == np.bincount(x[rows, f], (w[t] * y.astype(np.int64))[rows], 8).astype(int).tolist()
    assert set(out) == {(0, 1), (1, 4), (1, 5)}


def test_f3_scores_of_a_state_are_not_gathered(spark, sf, monkeypatch):
    def gathered(*_):
        raise AssertionError("a state's cells are compared where they are")
    monkeypatch.setattr(PR.F, "collect_list", gathered)
    monkeypatch.setattr(PR.R, "RUN_TREES", 2)
    rows = {r["name"]: (r["n"], r["ok"]) for r in PR.q_alloc_properties(spark, sf).collect()}
    assert len(rows) == 6 and all(ok for _, ok in rows.values())
    assert rows["model scores as row by row, no exchange"][0] == rows["model search totals"][0] > 0
