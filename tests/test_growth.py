"""What must not grow with the table: broadcasts, rows of one task, micro-batches, routed rows."""

import itertools
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.functions import order_stats
from slicewise.operators import access_log as LG
from slicewise.operators import forest as FO
from slicewise.operators import genetic as GA
from slicewise.operators import prep as PR
from slicewise.operators import quality as QA
from slicewise.plans import registry as R
from slicewise.streaming import streams as SS


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f1_unequal_leaves_are_not_forced_into_a_broadcast(spark):
    a = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    d = QA.diff_runs(a, a.where("k % 10 > 0"))
    assert "strategy=broadcast" not in _plan(d)
    assert (d.first()["left_only"], d.first()["right_only"]) == (300, 0)


def test_f2_leaves_of_the_last_level_need_no_rows(spark, monkeypatch):
    f = spark.range(4000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 50).cast("double").alias("x"),
                                 (F.col("id") % 50 / 50).alias("y"))
    fit = lambda: sorted(map(tuple, FO.fit_forest(f, ["x"], "y", trees=3, depth=1).nodes.collect()))
    local = fit()
    monkeypatch.setattr(FO, "LOCAL_ROWS", 10)
    routed = []
    monkeypatch.setattr(FO._Growth, "subtrees", lambda self, old=FO._Growth.subtrees: routed.append(old(self)) or routed[-1])
    assert fit() == local
    assert "Union" in _plan(routed[0])
    paths = [p for p in routed[0].inputFiles() if "forest-nodes" in p]
    assert spark.read.parquet(*paths).count() == 0 if paths else True


def test_f3_small_blocks_of_states_give_the_same_search(monkeypatch):
    rng = np.random.default_rng(3)
    ids, scores = [str(i) for i in range(60)], rng.random((60, 120))
    scores[:5] = 0
    scores[5:10] *= rng.random((5, 120)) < 0.05
    whole = GA.run_batch(ids, scores, 17, 80, 15, 42)
    monkeypatch.setattr(GA, "STATES_AT_ONCE", 7)
    assert whole.equals(GA.run_batch(ids, scores, 17, 80, 15, 42))
    assert whole.equals(GA.run_batch(ids[:31], scores[:31], 17, 80, 15, 42)._append(
        GA.run_batch(ids[31:], scores[31:], 17, 80, 15, 42), ignore_index=True))
    with pytest.raises(ValueError):
        GA.run_batch(ids, scores, 17, 1, 1, 42)


def test_f21_rows_of_heavy_values_are_only_counted(spark, monkeypatch):
    kept = []

    @contextmanager
    def counting(df, **kw):
        kept.append(df.count())
        yield df
    monkeypatch.setattr(order_stats, "cached", counting)
    df = spark.range(20_000).selectExpr("cast(id % 4 as double) few", "if(id % 2 = 0, 2.5, cast(id as double)) many")
    got = order_stats.exact_quantiles(df, ["few", "many"], [0.25, 0.5])
    assert got == {"few": [0.75, 1.5], "many": [2.5, 2.5]} and max(kept) < 500


def test_f21_odd_values_are_ranked(spark):
    x = [None, 0.0, -0.0, float("nan"), float("inf"), float("-inf")] + [2.5] * 40 + [float(v) for v in range(-30, 30)]
    df = spark.createDataFrame([(v,) for v in x], "x double").repartition(3)
    got = order_stats.exact_quantiles(df, ["x"], [0.0, 0.5, 0.9, 1.0], accuracy=20)["x"]
    have = np.sort(np.array(x[1:]))  # NaN last
    assert got[0] == -np.inf and np.isnan(got[3])
    assert np.allclose(got[1:3], np.quantile(have[:-1], [0.5 * 104 / 103, 0.9 * 104 / 103]), atol=1e-9)


def test_f19_a_stratum_is_joined_in_parts(spark):
    f = spark.range(4000).select(F.col("id").cast("string").alias("row_key"),
                                 F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("s"))
    d = PR.stratified_split(f, "s")
    joins = [line for line in _plan(d).splitlines() if "Join LeftOuter" in line]
    assert any("_pp" in line for line in joins)
    got = {r["s"]: (r["n"], r["t"]) for r in d.groupBy("s").agg(F.count("*").alias("n"), F.count(F.when(F.col("split") == "test", 1)).alias("t")).collect()}
    assert got == {0: (1600, 320), 1: (1600, 320), None: (800, 160)}


def test_f23_prepared_rows_are_written_once(spark):
    f = spark.range(600).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 3).alias("s"),
                                F.rand(1).alias("x"), F.rand(2).alias("y"))
    d, _ = PR.prepare_data(f, ["x"], "y", stratum="s")
    assert "Join" not in _plan(d) and d.count() == 600


def test_f17_fits_read_written_rows(spark, sf):
    t = R.training_frame(spark, sf)
    assert all("training-rows" in p for p in t.inputFiles())


def test_f8_a_micro_batch_takes_many_files(spark, sf, monkeypatch):
    monkeypatch.setattr(R, "STREAM_FILE_ROWS", 500)
    asked = []
    old = SS.kpi_feature_stream
    monkeypatch.setattr(SS, "kpi_feature_stream", lambda *a, **kw: asked.append(kw["max_files_per_trigger"]) or old(*a, **kw))
    assert R.QUERIES["stream_kpi_features"](spark, sf).count() == R.features(spark, sf).count()
    assert asked == [spark.sparkContext.defaultParallelism]


def test_f7_rows_of_one_row_group_are_written_by_all_cores(spark, sf):
    assert len(R.training_frame(spark, sf).inputFiles()) >= spark.sparkContext.defaultParallelism


def test_f9_states_of_one_row_group_are_searched_by_all_cores(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "rf_model", lambda *_: (None, None))
    monkeypatch.setattr(R.MD, "model_search", lambda st, m: seen.append(st) or R.AL.exhaustive_search(st))
    R.q_alloc_model(spark, sf)
    assert len(seen[0].inputFiles()) >= spark.sparkContext.defaultParallelism


def test_f9_cells_beyond_one_word_and_prediction_blocks(spark, monkeypatch):
    names = ["slice_id", "allocated_rbgs", "prb_utilization", "a", "b"]
    f = spark.range(3000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 3).alias("slice_id"), (F.col("id") % 28 + 1).alias("allocated_rbgs"),
                                 (F.col("id") % 11 / 10).alias("prb_utilization"), (F.col("id") % 13).alias("a"), (F.col("id") % 17).alias("b"))
    f = f.withColumn("y", F.col("slice_id") + F.sin(F.col("allocated_rbgs") * F.col("a")) + F.col("prb_utilization") * F.col("b"))
    m = FO.fit_forest(f, names, "y", trees=4, depth=7)
    flat, parts = FO.flat_forest(m), 28
    rng = np.random.default_rng(1)
    a, b, req = rng.integers(0, 13, 9), rng.integers(0, 17, 9), rng.integers(0, 30, 9).astype(float)
    got = FO.cell_scores(flat, m.cuts, names, FO.bin_rows([0 * a, 0 * a, 0 * a, a, b], m.cuts), req, parts, 3)
    i, cell = np.repeat(np.arange(9), 84), np.tile(np.arange(84), 9)
    groups = cell % parts + 1
    x = FO.bin_rows([cell // parts, groups, np.minimum(1, req[i] / groups), a[i], b[i]], m.cuts)
    whole = FO.predict(flat, x)
    assert (got.ravel() == np.clip(whole, 0, 1)).all()
    monkeypatch.setattr(FO, "PREDICT_ROWS", 50)
    assert (FO.predict(flat, x) == whole).all()


def _one_row_group(df, tmp_path):
    path = str(tmp_path / "one")
    df.coalesce(1).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_f20_states_of_one_row_group_are_exploded_by_all_cores(spark, tmp_path):
    st = _one_row_group(spark.range(64).select(F.col("id").alias("state_id"), (F.col("id") % 9).alias("sum_requested_prbs")), tmp_path)
    for df in (R.AL.candidate_features(st), R.AL.candidate_scores_long(st.withColumns({"qos_score": F.lit(0.5), "network_load": F.lit(0.5)}))):
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= spark.sparkContext.defaultParallelism


def test_f18_split_search_is_that_of_all_splits():
    rng = np.random.default_rng(2)
    for slices, total, most in ((1, 7, 7), (2, 5, 4), (3, 4, 2), (3, 9, 3), (4, 8, 5)):
        scores = rng.integers(-3, 4, (60, slices, most))
        groups, best = R.AL.best_splits(scores, total)
        splits = [c for c in itertools.product(range(1, most + 1), repeat=slices) if sum(c) == total]
        sums = np.array([[sum(x[s, r - 1] for s, r in enumerate(c)) for c in splits] for x in scores])
        assert (best == sums.max(1)).all() and groups.tolist() == [list(splits[i]) for i in sums.argmax(1)]


def test_f18_a_group_is_looked_at_once_per_reachable_rest(monkeypatch):
    seen = []
    old = np.maximum
    monkeypatch.setattr(R.AL.np, "maximum", lambda a, b, **kw: seen.append(np.size(a)) or old(a, b, **kw))
    R.AL.best_splits(np.ones((10, 3, 15), np.int64), 17)
    assert sum(seen) <= 10 * (15 + 15 * 15 // 2 + 3 * 15)


def test_f25_a_bucket_makes_no_frame_of_its_own(spark, monkeypatch):
    made = []
    day = 86_400_000_000
    rows = pd.DataFrame({"_kind": 1, "client": np.repeat(np.arange(300), 2), "_b": np.tile([0, 1], 300), "_us": np.tile([5, day + 5], 300),
                         "event_id": np.arange(600), "ts": pd.Timestamp("2024-01-01"), "carry": None})
    frame = pd.DataFrame
    monkeypatch.setattr(LG.pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    out = list(LG._bucket_pass(2, day, day)(iter([rows])))
    assert len(made) < 10
    assert sum(o["carry"].isna().sum() for o in out) == 600


def test_f25_buckets_below_the_limit_decide_as_before(spark):
    rng = np.random.default_rng(4)
    times = np.sort(rng.integers(0, 3000, 400))
    rows = [(i, int(c), int(t)) for i, (c, t) in enumerate(zip(rng.integers(0, 6, 400), times))]
    log = spark.createDataFrame(rows, "event_id long, client long, s long").selectExpr(
        "event_id", "client", "cast(timestamp_seconds(s) as timestamp_ntz) as ts")
    want, past = {}, {}
    for i, c, t in rows:
        q = past.setdefault(c, [])
        want[i] = sum(t - x < 60 for x in q) < 3
        if want[i]:
            q.append(t)
    for factor in (1, 4):
        got = {r["event_id"]: r["accepted"] for r in LG.rate_limit(log, 3, 60, factor).collect()}
        assert got == want


def test_f12_held_out_rows_leave_a_tree_in_blobs(spark, monkeypatch):
    """The leaves of a tree's held-out rows are one packed row per blob of the input, not a row each."""
    f = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 50).cast("double").alias("x"),
                                             (F.col("id") % 50 / 50).alias("y"), (F.col("id") % 3 + 1).cast("int").alias("fold"))
    monkeypatch.setattr(FO, "LOCAL_ROWS", 500)
    monkeypatch.setattr(FO, "spread", lambda df: df)
    grown = []
    monkeypatch.setattr(FO._Growth, "subtrees", lambda self, old=FO._Growth.subtrees: grown.append(old(self)) or grown[-1])
    held = FO.fit_forest(f, ["x"], "y", trees=4, depth=5, fold_col="fold", folds=3).held_out.collect()
    assert len(held) == len({r["row"] for r in held}) == 3000
    assert sorted({r["model"] for r in held}) == [1, 2, 3]
    assert max(abs(r["prediction"] - r["y"]) for r in held) < 0.1
    assert grown[0].where("kind = 'row'").count() < 300


def test_f13_ensemble_makes_its_training_rows_once(spark, monkeypatch):
    made = []

    def frame(spark, sf_dir):
        made.append(sf_dir)
        return spark.range(400).select(
            F.col("id").cast("string").alias("row_key"), (F.col("id") % 50 / 50).alias(R.P.TARGET_COLUMN),
            *[(F.col("id") * (i + 1) % 50).cast("double").alias(c) for i, c in enumerate(R.P.FEATURE_COLUMNS)],
            F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), (F.col("id") % 10 == 1).alias("is_validation"))
    monkeypatch.setattr(R, "training_frame", frame)
    monkeypatch.setattr(R, "RUN_TREES", 3)
    monkeypatch.setattr(R, "NN_STEPS", 2)
    rows = R.q_ml_ensemble(spark, "nowhere").collect()
    assert made == ["nowhere"] and len(rows) == 80
    assert all(abs(r["ensemble_prediction"] - (r["rf_prediction"] + r["nn_prediction"]) / 2) < 1e-12 for r in rows)


def test_f6_packed_split_search_grows_the_same_subtree(monkeypatch):
    """Weight and label sum in one number, nodes and rows in small blocks: the nodes of the plain histograms."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, [3, 40, 9], (2000, 3)).astype(np.uint8)
    y, w = rng.integers(0, 2**20, 2000).astype(np.float64), rng.integers(0, 4, 2000).astype(np.float64)
    parts, leaf = FO.grow_subtree(x, y, w, 1, 9, 40, 2, 2)
    monkeypatch.setattr(FO, "SPLIT_ROWS", 37)
    monkeypatch.setattr(FO, "SPLIT_CELLS", 200)
    for a, b in zip(parts, FO.grow_subtree(x, y, w, 1, 9, 40, 2, 2)[0]):
        assert all(np.array_equal(p, q) for p, q in zip(a, b))
    at, node = np.zeros(2000, np.int64), 1
    for ids, feature, cut, s, gain, n in parts:
        g, f, c, nn, ss = FO.best_splits(*FO.histograms(at[w > 0], len(ids), x[w > 0], w[w > 0], y[w > 0], 40), 2)
        split = feature >= 0
        assert np.array_equal(nn, n) and np.array_equal(ss, s) and np.array_equal(g[split], gain[split])
        assert np.array_equal(f[split], feature[split]) and np.array_equal(c[split], cut[split])
        assert (g[~split & (n >= 2)] == 0).all() or len(ids) == len(parts[-1][0])
        keep = split[at]
        x, y, w, at = x[keep], y[keep], w[keep], at[keep]
        side = x[np.arange(len(x)), feature[at]] > cut[at]
        at = 2 * (np.cumsum(split) - 1)[at] + side


def test_f6_rows_are_placed_by_walking_the_tree():
    """A row steps down the tree instead of every split looking through all rows."""
    rng = np.random.default_rng(7)
    top = FO.Top({(0, 0): {1: (0, 4), 3: (1, 2), 6: (0, 6), 7: (1, 7)}})
    x = rng.integers(0, 10, (500, 2)).astype(np.uint8)
    want = np.ones(500, np.int64)
    for parent, (f, c) in sorted(top.split[0, 0].items()):
        here = np.flatnonzero(want == parent)
        want[here] = 2 * parent + (x[here, f] > c)
    assert np.array_equal(top.place((0, 0), x), want) and (top.place((0, 1), x) == 1).all()
    node, _, _, child = top.walk((0, 0))
    assert len(node) == len(child) == 9


class _State:
    """A state variable that counts the entries written."""

    def __init__(self):
        self.rows, self.written = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows

    def put(self, rows):
        self.rows, self.written = list(rows), self.written + len(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows, self.written = self.rows + list(rows), self.written + len(rows)

    def clear(self):
        self.rows = []


class _Value(_State):
    def get(self):
        return self.rows[0]

    def update(self, row):
        self.put([row])


class _Handle:
    getListState = staticmethod(lambda name, schema: _State())
    getValueState = staticmethod(lambda name, schema: _Value())
    registerTimer = deleteTimer = staticmethod(lambda ms: None)


def test_f22_state_of_the_stream_limiter_is_not_written_row_by_row():
    rng = np.random.default_rng(22)
    n, limit, window = 4000, 3, 50
    frame = pd.DataFrame({"us": rng.integers(0, 1000, n), "id": np.arange(n), "client": rng.integers(0, 200, n),
                          "no_client": False, "heartbeat": False})
    frame.loc[::7, ["client", "no_client"]] = [0, True]  # no client and client 0 are two
    r = SS.RateLimiter(limit, window)
    r.init(_Handle())
    got = []
    for part, seen_ms in ((frame[frame.us < 600], 0), (frame[frame.us >= 600], 2)):
        assert not list(r.handleInputRows((0,), iter([part]), None))
        timer = type("Timer", (), {"getCurrentWatermarkInMs": staticmethod(lambda ms=seen_ms: ms)})
        got += list(r.handleExpiredTimer((0,), timer, None))
    assert r.waiting.written <= 4 and r.accepted.written <= 2 and not r.accepted.exists()
    got = pd.concat(got).set_index("event_id")
    assert len(got) == n and got.client.isna().sum() == frame.no_client.sum()
    accepted: dict = {}
    for row in frame.sort_values(["us", "id"]).itertuples():
        q = accepted.setdefault((row.no_client, row.client), [])
        ok = sum(row.us - t < window for t in q) < limit
        if ok:
            q.append(row.us)
        assert got.accepted[row.id] == ok
    assert SS.limiter_buckets(0) == SS.limiter_buckets(SS.BUCKET_ROWS) and SS.limiter_buckets(1000 * SS.BUCKET_ROWS) == 1000
