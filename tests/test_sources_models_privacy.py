import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from slicewise.operators import models as MD
from slicewise.operators import privacy as DP
from slicewise.plans import registry as R
from slicewise.sources import kpi_csv as KC


def _write_tree(root, rows_per_file=20):
    rng = np.random.default_rng(3)
    n = 0
    for sched in ["sched0", "sched1", "sched2"]:
        for tr in ["tr0", "tr1", "tr2"]:
            for bs in [1, 8]:
                d = os.path.join(root, sched, tr, "exp1", f"bs{bs}", f"slices_bs{bs}")
                os.makedirs(d)
                for ue in range(3):
                    pdf = pd.DataFrame({
                        "Timestamp": 1_000_000 + np.arange(rows_per_file),
                        "tx_brate downlink [Mbps]": rng.uniform(5, 20, rows_per_file),
                        "sum_requested_prbs": rng.integers(1, 15, rows_per_file),
                        "sum_granted_prbs": rng.integers(1, 15, rows_per_file),
                        "tx_errors downlink (%)": rng.uniform(0, 3, rows_per_file),
                        "rx_errors uplink (%)": rng.uniform(0, 3, rows_per_file),
                        "dl_cqi": rng.integers(8, 15, rows_per_file),
                        "num_ues": rng.integers(1, 8, rows_per_file),
                    })
                    pdf.to_csv(os.path.join(d, f"{1010123456000 + ue}_metrics.csv"), index=False)
                    n += rows_per_file
    os.makedirs(os.path.join(root, "sched7", "tr0"))  # not a scanned policy
    return n


def test_kpi_tree_scan(spark):
    root = tempfile.mkdtemp(prefix="kpi-tree-")
    n = _write_tree(root)
    df = KC.scan_kpi_tree(spark, root)
    assert df.count() == n
    row = df.where("bs_id = 8").first()
    assert row.exp_id == 1 and row.sched_policy.startswith("sched") and row.training_config.startswith("tr")
    assert row.imsi.startswith("1010123456")
    assert {"ts_ms", "tx_brate_dl_mbps", "tx_errors_dl_pct", "rx_errors_ul_pct"} <= set(df.columns)
    feats = R.FE.kpi_features(df)
    assert feats.count() == n
    assert feats.where((F.col("allocation_efficiency") < 0) | (F.col("allocation_efficiency") > 1)).count() == 0


def test_kpi_tree_columns_by_name(spark, caplog):
    """Shuffled, extra and missing columns, a bad value and a file without a header."""
    root = tempfile.mkdtemp(prefix="kpi-tree-names-")
    n = _write_tree(root, rows_per_file=5)
    d = os.path.join(root, "sched0", "tr0", "exp1", "bs1", "slices_bs1")
    with open(os.path.join(d, "901_metrics.csv"), "w") as f:
        f.write("num_ues,slice_id,sum_granted_prbs,note,Timestamp,sum_requested_prbs,tx_brate downlink [Mbps]\n"
                "7,2,3.0,hello,1000,9,1.5\n8,1,x,,2000,4,NaN\n")
    with open(os.path.join(d, "902_metrics.csv"), "w") as f:
        f.write("no header here\n1,2\n")
    with caplog.at_level("WARNING"):
        df = KC.scan_kpi_tree(spark, root).cache()
    assert df.count() == n + 2
    assert "1 of" in caplog.text
    got = [(r.ts_ms, r.num_ues, r.slice_id, r.sum_requested_prbs, r.sum_granted_prbs, r.tx_brate_dl_mbps, r.note,
            r.dl_cqi) for r in df.where("imsi = '901'").orderBy("ts_ms").collect()]
    assert got == [(1000, 7, 2, 9, 3, 1.5, "hello", None), (2000, 8, 1, 4, None, None, None, None)]


def test_kpi_tree_opens_only_the_files_asked_for(spark):
    """Files of other dimensions are not opened: their bytes no longer matter."""
    root = tempfile.mkdtemp(prefix="kpi-tree-pruned-")
    _write_tree(root, rows_per_file=4)
    df = KC.scan_kpi_tree(spark, root, only={"sched_policy": ["sched1"], "bs_id": [8], "training_config": ["tr0", "tr2"]})
    whole = KC.scan_kpi_tree(spark, root)
    assert df.count() == 2 * 3 * 4
    same = whole.where("sched_policy = 'sched1' and bs_id = 8 and training_config in ('tr0', 'tr2')")
    assert df.exceptAll(same).isEmpty() and same.exceptAll(df).isEmpty()
    for d, _, names in os.walk(root):
        if "sched1" not in d or "bs8" not in d or "tr1" in d:
            for n in names:
                with open(os.path.join(d, n), "wb") as f:
                    f.write(b"Timestamp,num_ues\n" + b"5,6\n" * 3)
    assert df.count() == 2 * 3 * 4


def test_kpi_tree_ragged_rows_and_quotes(spark):
    root = tempfile.mkdtemp(prefix="kpi-tree-ragged-")
    d = os.path.join(root, "sched0", "tr0", "exp3", "bs2", "slices_bs2")
    os.makedirs(d)
    with open(os.path.join(d, "1_metrics.csv"), "wb") as f:
        f.write(b'\xef\xbb\xbfTimestamp, num_ues ,"note",num_ues\r\n1,2,"a, b",9\r\n2\r\n3,4,c,9,9,9\r\n\r\n4, 5 ,,9\r\n')
    with open(os.path.join(d, "2_metrics.csv"), "wb") as f:
        f.write(b"")
    with open(os.path.join(d, "3_metrics.csv"), "wb") as f:
        f.write(b"num_ues,Timestamp\n")
    df = KC.scan_kpi_tree(spark, root)
    got = sorted((r.ts_ms, r.num_ues, r.note, r.exp_id, r.bs_id, r.imsi) for r in df.collect())
    assert got == [(1, 2, "a, b", 3, 2, "1"), (2, None, None, 3, 2, "1"), (3, 4, "c", 3, 2, "1"), (4, 5, None, 3, 2, "1")]
    few = KC.scan_kpi_tree(spark, root, columns=["Timestamp"])
    assert "note" not in few.columns and few.count() == 4


def test_missing_tree_is_an_error(spark):
    import pytest
    with pytest.raises(FileNotFoundError):
        KC.scan_kpi_tree(spark, tempfile.mkdtemp(prefix="empty-tree-"))


def test_absent_optional_columns_use_defaults(spark):
    df = spark.createDataFrame([(0, "custom_policy", "custom_config", 0, 10, 8, 40.0, 1.0)],
                               "ts_ms long, sched_policy string, training_config string, slice_id int, "
                               "sum_requested_prbs int, sum_granted_prbs int, tx_brate_dl_mbps double, "
                               "tx_errors_dl_pct double")
    out = R.FE.kpi_features(df, configs={"custom_config": [10, 5, 2]}).first()
    assert out.allocated_rbgs == 10
    assert out.sched_policy_num is None
    assert abs(out.network_load - 5.0 / 42.0) < 1e-15
    want_qos = (0.4 * ((100 - 1.0) / 100) + 0.3 * ((100 - 2.5) / 100)) + 0.3 * (10.0 / 15)
    assert abs(out.qos_score - min(1.0, want_qos)) < 1e-15


def test_model_registry_roundtrip(spark, sf):
    t = R.training_frame(spark, sf)
    train = t.where("split = 'train'")
    m = MD.fit_random_forest(train, trees=5, depth=4)
    base = tempfile.mkdtemp(prefix="models-")
    v1 = MD.save_model(m, base, {"n": 1})
    m2 = MD.fit_random_forest(train, trees=3, depth=3)
    v2 = MD.save_model(m2, base, {"n": 2})
    loaded, meta, v = MD.load_model(base)
    assert v == v2 and meta == {"n": 2} and v2 > v1
    test = t.where("split = 'test'")
    a = MD.score(m2, test).select("row_key", "rf_prediction")
    b = MD.score(loaded, test).select("row_key", "rf_prediction")
    assert a.exceptAll(b).count() == 0
    old, meta1, _ = MD.load_model(base, v1)
    assert meta1 == {"n": 1}
    top = MD.feature_importance(m, k=3).collect()
    assert len(top) == 3 and top[0].importance >= top[-1].importance


def test_registry_of_several_writers(spark):
    """Writers at the same time: every version once, every model whole, a taken version refused."""
    import threading

    import pytest

    from slicewise.functions import commits
    base = tempfile.mkdtemp(prefix="commits-")
    log = os.path.join(base, "log")

    def writer(name):
        for i in range(20):
            commits.append(spark, log, lambda past: {"who": name, "i": i, "after": len(past)})
    threads = [threading.Thread(target=writer, args=(n,)) for n in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    got = commits.entries(spark, log)
    assert [e["after"] for e in got] == list(range(80))
    assert sorted((e["who"], e["i"]) for e in got) == sorted((n, i) for n in "abcd" for i in range(20))

    t = spark.range(40).selectExpr("id", "cast(id AS double) AS x", "cast(id % 3 AS double) AS y")
    m = MD.fit_random_forest(t, features=["x"], label="y", trees=2, depth=2)
    models = os.path.join(base, "models")
    MD.save_model(m, models, {"n": 1}, version="v1")
    with pytest.raises(FileExistsError):
        MD.save_model(m, models, {"n": 2}, version="v1")
    assert [r.version for r in MD.registry(models).collect()] == ["v1"]
    # a model whose writer died before the commit is not there
    m.write().save(os.path.join(models, "model-half"))
    assert MD.load_model(models)[1:] == ({"n": 1}, "v1")


def test_commits_through_the_hadoop_file_system(spark, monkeypatch):
    from slicewise.functions import commits
    monkeypatch.setattr(commits, "_local", lambda base: None)
    log = os.path.join(tempfile.mkdtemp(prefix="commits-h-"), "log")
    assert commits.entries(spark, log) == []
    for i in range(3):
        commits.append(spark, log, lambda past: {"i": len(past)})
    assert [e["i"] for e in commits.entries(spark, log)] == [0, 1, 2]
    assert not commits._claim(spark, log, 1, "{}\n")
    assert [e["i"] for e in commits.entries(spark, log)] == [0, 1, 2]


PRIVATE = {"client_col": "c", "id_cols": ["id"]}


def test_laplace_noise_statistics(spark):
    df = spark.range(20000).selectExpr("id", "id AS c", "id % 5000 AS g", "1.0 AS v")
    out = DP.noisy_aggregate(df, ["g"], secret="s", epsilon=0.5, **PRIVATE).toPandas()
    noise = out.noisy_count - 4.0
    assert abs(noise.mean()) < 0.15
    assert abs(noise.var() - 2 * (1 / 0.5) ** 2) < 1.0
    again = DP.noisy_aggregate(df.repartition(3), ["g"], secret="s", epsilon=0.5, **PRIVATE).toPandas()
    pd.testing.assert_frame_equal(out.sort_values("g").reset_index(drop=True),
                                  again.sort_values("g").reset_index(drop=True))
    other = DP.noisy_aggregate(df, ["g"], secret="t", epsilon=0.5, **PRIVATE).toPandas()
    assert (other.sort_values("g").noisy_count.values != out.sort_values("g").noisy_count.values).mean() > 0.99


def test_private_groups_with_nulls_have_their_own_noise(spark):
    rows = [(1, 1, None, "a"), (2, 2, "a", None), (3, 3, "1:a", ""), (4, 4, "", "1:a"), (5, 5, None, None)]
    df = spark.createDataFrame(rows, "id long, c long, g string, h string")
    out = DP.noisy_aggregate(df, ["g", "h"], secret="s", **PRIVATE).collect()
    assert len(out) == 5 and len({r.noisy_count for r in out}) == 5


def test_private_neighbours_differ_by_the_sensitivity_at_most(spark):
    """Without any one client, the bounded counts and sums change by at most the stated sensitivity,
    all groups together; repeated rows, a client in every group, rows without a client."""
    rows = [(i, i % 7 if i % 5 else 0, "g%d" % (i * i % 11), float(i % 4)) for i in range(400)]
    rows += [(i, None, "g1", 3.0) for i in range(400, 420)] + [(7, 0, "g3", 1.0)] * 3
    df = spark.createDataFrame(rows, "id long, c long, g string, v double")
    for max_rows, max_groups in ((1, 1), (2, 3), (1000, 1000)):
        def sums(x):
            x = DP.bounded(x, ["g"], "c", ["id"], "s", max_rows, max_groups)
            return {r.g: (r.n, r.s) for r in x.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
        whole = sums(df)
        if max_rows == 1000:
            assert sum(n for n, _ in whole.values()) == len(rows)
        for client in (0, 3, None):
            less = sums(df.where(~F.col("c").eqNullSafe(F.lit(client))))
            d = [(n - less.get(g, (0, 0))[0], s - less.get(g, (0, 0))[1]) for g, (n, s) in whole.items()]
            assert 0 < sum(abs(n) for n, _ in d) <= max_rows * max_groups
            assert sum(abs(s) for _, s in d) <= max_rows * max_groups * 3.0


def test_a_hot_client_is_bounded_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "1 AS c", "id % 3 AS g")
    plan = DP.bounded(df, ["g"], "c", ["id"], "s", 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "Partial" in plan


def test_private_groups_of_few_clients_stay_hidden(spark):
    df = spark.range(3000).selectExpr("id", "id AS c", "CASE WHEN id < 2000 THEN 'many' ELSE concat('own', id) END AS g")
    out = DP.noisy_aggregate(df, ["g"], secret="s", delta=1e-9, **PRIVATE).collect()
    assert [r.g for r in out] == ["many"]


def test_privacy_budget(spark):
    import pytest
    df = spark.range(10).selectExpr("id", "id AS c", "id % 2 AS g")
    ledger = DP.Ledger(spark, os.path.join(tempfile.mkdtemp(prefix="ledger-"), "t"), epsilon=1.0)
    DP.noisy_aggregate(df, ["g"], secret="one", epsilon=0.6, ledger=ledger, **PRIVATE)
    with pytest.raises(ValueError, match="budget"):
        DP.noisy_aggregate(df, ["g"], secret="two", epsilon=0.6, ledger=ledger, **PRIVATE)
    with pytest.raises(ValueError, match="secret"):
        DP.noisy_aggregate(df, ["g"], secret="one", epsilon=0.1, ledger=ledger, **PRIVATE)
    with pytest.raises(ValueError, match="budget"):
        DP.noisy_aggregate(df, ["g"], secret="two", epsilon=0.1, delta=1e-6, ledger=ledger, **PRIVATE)
    DP.noisy_aggregate(df, ["g"], secret="two", epsilon=0.4, ledger=ledger, **PRIVATE)
    assert ledger.spent() == (1.0, 0.0)
    with pytest.raises(ValueError, match="secret"):
        DP.noisy_aggregate(df, ["g"], secret="", **PRIVATE)


def test_compact_types_frame(spark, sf):
    out, report = R.FE.compact_types(R.feature_table(spark, sf))
    types = dict(out.dtypes)
    assert types["hour"] == "tinyint" and types["qos_score"] == "float"
    rep = {r.column: (r.old_type, r.new_type) for r in report.collect()}
    assert rep["slice_id"] == ("int", "tinyint")
    assert {r.column: r.new_type for r in R.FE.compact_types_report(R.feature_table(spark, sf)).collect()} == \
        {k: v[1] for k, v in rep.items()}


def test_search_on_a_stream_of_states(spark, sf):
    from slicewise.operators import allocation as AL
    st = R.states(spark, sf).select("state_id", "sum_requested_prbs", "qos_score", "network_load")
    src = R._stage_parquet(st, "states-stream-src")
    stream = spark.readStream.schema(st.schema).parquet(src)
    res = AL.exhaustive_search(stream)
    q = (res.writeStream.format("memory").queryName("stream_search_test").outputMode("append")
            .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("stream_search_test").select("state_id", "best_rbg_0", "best_rbg_1", "best_rbg_2", "best_score")
    want = AL.exhaustive_search(st).select("state_id", "best_rbg_0", "best_rbg_1", "best_rbg_2", "best_score")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_training_run_report(spark, sf):
    import tempfile
    from slicewise.plans.run import training_run
    base = tempfile.mkdtemp(prefix="run-")
    rep = training_run(R.kpi(spark, sf), base + "/report", model_path=base + "/models", trees=5, depth=4)
    sections = {r.section for r in rep.select("section").distinct().collect()}
    assert sections == {"quality", "metrics", "importance", "scenarios", "improvement", "verdict"}
    _, meta, _ = MD.load_model(base + "/models")
    assert meta["target"] == "allocation_efficiency" and "r2" in meta["test_metrics"]


def test_custom_csv_nan_is_missing(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="custom-csv-")
    pd.DataFrame({"ts_ms": [0, 60000], "sched_policy": ["sched1", "sched1"],
                  "training_config": ["tr0", "tr0"], "slice_name": [1, 2],
                  "sum_requested_prbs": [10, 10], "sum_granted_prbs": [5, 5],
                  "tx_brate_dl_mbps": [float("nan"), 20.0], "ue_count": [None, 21]}).to_csv(d + "/x.csv", index=False)
    df = KC.read_custom_csv(spark, d + "/x.csv")
    assert {"num_ues", "slice_id"} <= set(df.columns)
    rows = sorted(R.FE.kpi_features(df, keep=["ts_ms"]).collect(), key=lambda r: r.ts_ms)
    assert rows[0].throughput_efficiency == 0.0          # NaN throughput counts as missing
    assert abs(rows[0].network_load - 5.0 / 42.0) < 1e-15  # missing UEs -> 5
    assert abs(rows[1].network_load - 0.5) < 1e-15
    assert [r.allocated_rbgs for r in rows] == [13, 2]


def test_preconditions_are_errors(spark, sf):
    import pytest
    from slicewise.operators import prep as PR
    ft = R.feature_table(spark, sf)
    warn = PR.validate_for_training(ft)
    assert warn["infinite"] == [] and warn["constant"] == []
    with pytest.raises(ValueError, match="constant"):
        PR.validate_for_training(ft.withColumn("allocation_efficiency", F.lit(0.5)))
    with pytest.raises(ValueError, match="hour"):
        MD.fit_random_forest(ft.drop("hour"), trees=2, depth=2)
    with pytest.raises(ValueError, match="loaded: none"):
        MD.score_by_name({}, "rf", ft)


def test_model_search_missing_features_are_zero(spark, sf):
    from conftest import unique_by
    t = R.training_frame(spark, sf)
    m = MD.fit_random_forest(t.where("split = 'train'"), trees=3, depth=3)
    st = unique_by(R.states(spark, sf), "state_id").limit(50)
    full = MD.model_search(st.withColumn("hour", F.lit(0.0)), m).select("state_id", "best_score")
    missing = MD.model_search(st.drop("hour"), m).select("state_id", "best_score")
    assert full.exceptAll(missing).count() == 0 and missing.count() == 50
    v = MD.model_search(st, m)
    assert v.where(F.col("best_rbg_0") + F.col("best_rbg_1") + F.col("best_rbg_2") != 17).count() == 0
