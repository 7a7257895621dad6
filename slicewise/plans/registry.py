"""Named queries over the parquet tables: each is ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or frames Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..operators import access_log as LG
from ..operators import allocation as AL
from ..operators import evaluation as EV
from ..operators import features as FE
from ..operators import genetic as GA
from ..operators import forest as FO
from ..operators import models as MD
from ..operators import network as NW
from ..operators import prep as PR
from ..operators import privacy as DP
from ..operators import profile as PF
from ..operators import quality as QA
from ..functions.partitioning import spread
from ..session import scratch_path, written
from ..sources import kpi_csv as KC
from ..sources import tables as TB
from ..streaming import streams as SS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def kpi(spark, sf_dir) -> DataFrame:
    return TB.kpi_from_lineitem(spark, sf_dir)


def features(spark, sf_dir, keep=("row_key",)) -> DataFrame:
    return FE.kpi_features(kpi(spark, sf_dir), keep=list(keep))


# --- F: feature engineering --------------------------------------------------------------------

@register("kpi_features")
def q_kpi_features(spark, sf_dir):
    return FE.kpi_features(kpi(spark, sf_dir))


@register("kpi_efficiency_by_policy_slice")
def q_flagship(spark, sf_dir):
    return FE.efficiency_by_policy_slice(FE.kpi_features(kpi(spark, sf_dir)))


@register("feat_temporal")
def q_feat_temporal(spark, sf_dir):
    return FE.add_temporal(kpi(spark, sf_dir)).select("row_key", "ts_ms", "hour", "minute", "day_of_week")


@register("feat_sched_code")
def q_feat_sched_code(spark, sf_dir):
    return FE.add_sched_code(kpi(spark, sf_dir)).select("row_key", "sched_policy", "sched_policy_num")


@register("feat_allocated_rbgs")
def q_feat_allocated_rbgs(spark, sf_dir):
    return (FE.add_allocated_rbgs(FE.ensure_slice_id(kpi(spark, sf_dir)))
              .select("row_key", "training_config", "slice_id", "allocated_rbgs"))


@register("feat_prb_utilization")
def q_feat_prb(spark, sf_dir):
    return (FE.add_prb_utilization(kpi(spark, sf_dir))
              .select("row_key", "sum_requested_prbs", "sum_granted_prbs", "prb_utilization"))


@register("feat_throughput_eff")
def q_feat_thr(spark, sf_dir):
    return FE.add_throughput_efficiency(kpi(spark, sf_dir)).select("row_key", "throughput_efficiency")


@register("impute_constants")
def q_impute(spark, sf_dir):
    return (FE.impute_constants(kpi(spark, sf_dir))
              .select("row_key", "tx_errors_dl_pct", "rx_errors_ul_pct", "dl_cqi", "num_ues"))


@register("feat_qos_score")
def q_feat_qos(spark, sf_dir):
    return FE.add_qos_score(kpi(spark, sf_dir)).select("row_key", "qos_score")


@register("feat_network_load")
def q_feat_load(spark, sf_dir):
    return FE.add_network_load(kpi(spark, sf_dir)).select("row_key", "network_load")


@register("feat_allocation_efficiency")
def q_feat_target(spark, sf_dir):
    return features(spark, sf_dir).select("row_key", "allocation_efficiency")


# --- Q: data quality ---------------------------------------------------------------------------


FEATURE_TABLE_COLS = P.FEATURE_COLUMNS + [P.TARGET_COLUMN]


def feature_table(spark, sf_dir):
    """The 12 features + target (the frame the quality report profiles)."""
    return FE.kpi_features(kpi(spark, sf_dir))


def events_numeric(spark, sf_dir):
    return TB.read_table(spark, sf_dir, "events").select("event_id", "user_id", "value")


@register("dq_missing")
def q_dq_missing(spark, sf_dir):
    return QA.missing_pct(kpi(spark, sf_dir))


@register("dq_outliers_iqr")
def q_dq_outliers(spark, sf_dir):
    return QA.outliers_iqr(feature_table(spark, sf_dir))


@register("dq_outliers_events")
def q_dq_outliers_events(spark, sf_dir):
    return QA.outliers_iqr(events_numeric(spark, sf_dir))


@register("dq_ranges")
def q_dq_ranges(spark, sf_dir):
    return QA.ranges(feature_table(spark, sf_dir))


@register("dq_duplicates")
def q_dq_duplicates(spark, sf_dir):
    return QA.duplicates(kpi(spark, sf_dir).select("bs_id", "slice_id", "sum_requested_prbs"))


@register("dq_duplicates_docs")
def q_dq_duplicates_docs(spark, sf_dir):
    return QA.duplicates(TB.read_table(spark, sf_dir, "documents").select("text", "lang", "source"))


@register("dq_score")
def q_dq_score(spark, sf_dir):
    return QA.quality_score(feature_table(spark, sf_dir))


@register("clean_iqr")
def q_clean_iqr(spark, sf_dir):
    return QA.clean_iqr(features(spark, sf_dir), FEATURE_TABLE_COLS)


@register("clean_zscore")
def q_clean_zscore(spark, sf_dir):
    return QA.clean_zscore(features(spark, sf_dir), FEATURE_TABLE_COLS)


@register("dq_infinite")
def q_dq_infinite(spark, sf_dir):
    return QA.infinite_check(feature_table(spark, sf_dir))


@register("dq_constant")
def q_dq_constant(spark, sf_dir):
    return QA.constant_check(feature_table(spark, sf_dir))


@register("dq_train_checks")
def q_dq_train_checks(spark, sf_dir):
    return QA.training_checks(feature_table(spark, sf_dir))


@register("dq_profile_incremental")
def q_dq_profile_incremental(spark, sf_dir):
    """Q1, Q3 from sketches per period of 28 days (a day of the test table has few rows), the last period added to a
    stored profile, and whether the quartiles' ranks in the table itself are within the stated error."""
    f = FE.kpi_features(kpi(spark, sf_dir), keep=["ts_ms"])
    path, day = scratch_path(spark, "profile"), F.floor(F.col("ts_ms") / (28 * 86_400_000))
    last = f.agg(F.max(day).alias("d")).first()["d"]
    if last is None:  # an empty table has no days
        return spark.createDataFrame([], "column string, rows long, missing_pct double, min double, max double, "
                                         "mean double, std double, quartiles_within boolean")
    PF.add_days(f.where(day < last), path, day, cols=FEATURE_TABLE_COLS)
    PF.add_days(f, path, day, only=[last], cols=FEATURE_TABLE_COLS)
    report = PF.profile_report(PF.read_profile(spark, path))
    quartiles = {r["column"]: (r["q1"], r["q3"]) for r in report.select("column", "q1", "q3").collect()}

    def within(c, i, p):
        v, n = F.lit(quartiles[c][i]), F.count(c)
        low, high = F.count(F.when(F.col(c) < v, 1)), F.count(F.when(F.col(c) <= v, 1))
        return (low <= n * (p + PF.RANK_ERROR)) & (high >= n * (p - PF.RANK_ERROR))
    exact = f.agg(*[(within(c, 0, 0.25) & within(c, 1, 0.75)).alias(c) for c in FEATURE_TABLE_COLS])
    exact = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("quartiles_within"))
                                            for c in FEATURE_TABLE_COLS])))
    return report.join(exact, "column").select("column", "rows", "missing_pct", "min", "max", "mean", "std",
                                               "quartiles_within")


@register("dq_diff_runs")
def q_dq_diff_runs(spark, sf_dir):
    return QA.diff_runs(features(spark, sf_dir), features(spark, sf_dir))


# --- A: allocation search ----------------------------------------------------------------------


def states(spark, sf_dir) -> DataFrame:
    """One network state per KPI row: its features, UE count (imputed) and load scenario."""
    return states_of(kpi(spark, sf_dir))


def states_of(raw: DataFrame) -> DataFrame:
    f = FE.kpi_features(raw, keep=["row_key", "bs_id", "exp_id", "num_ues"])
    ues = F.coalesce(F.col("num_ues").cast("double"), F.lit(P.DEFAULT_NUM_UES))
    return f.select(F.col("row_key").alias("state_id"), ues.alias("num_ues"),
                    AL.scenario_of(ues).alias("scenario"),
                    *[c for c in f.columns if c not in ("row_key", "num_ues")])


def exhaustive(spark, sf_dir) -> DataFrame:
    return AL.exhaustive_search(states(spark, sf_dir))


@register("alloc_features")
def q_alloc_features(spark, sf_dir):
    x = AL.candidate_features(states(spark, sf_dir).select("state_id", "sum_requested_prbs"))
    return (x.groupBy("slice_id", "allocated_rbgs")
             .agg(F.count(F.lit(1)).alias("n_rows"),
                  F.round(F.avg("prb_utilization"), 6).alias("avg_prb_utilization")))


@register("alloc_heuristic")
def q_alloc_heuristic(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select("row_key", AL.heuristic_score(F.col("prb_utilization"), F.col("qos_score"),
                                                  F.col("network_load")).alias("heuristic"))


@register("alloc_scores")
def q_alloc_scores(spark, sf_dir):
    x = AL.candidate_scores_long(states(spark, sf_dir).select(
        "state_id", "sum_requested_prbs", "qos_score", "network_load"))
    return (x.groupBy("rbg_0", "rbg_1", "rbg_2")
             .agg(F.count(F.lit(1)).alias("n_states"),
                  F.round(F.avg("score"), 6).alias("avg_score"),
                  F.round(F.max("score"), 6).alias("max_score")))


@register("alloc_exhaustive")
def q_alloc_exhaustive(spark, sf_dir):
    return exhaustive(spark, sf_dir).select("state_id", "best_rbg_0", "best_rbg_1", "best_rbg_2",
                                            "best_score")


@register("alloc_linear")
def q_alloc_linear(spark, sf_dir):
    st = states(spark, sf_dir)
    fn = AL.linear_scorer(F.col("qos_score"), F.col("network_load"), F.col("throughput_efficiency"))
    return AL.custom_search(st, fn).select("state_id", "best_rbg_0", "best_rbg_1", "best_rbg_2",
                                           "best_score")


@register("alloc_k_slices")
def q_alloc_k_slices(spark, sf_dir):
    """A1, A5: the best split of the groups over three and over four slices."""
    st = states(spark, sf_dir).select("state_id", "sum_requested_prbs", "qos_score", "network_load")
    parts = [AL.k_slice_search(st, slices=k).select(F.lit(k).alias("slices"), "state_id", F.concat_ws(",", "best_rbgs").alias("best_rbgs"),
                                                    F.round("best_score", 9).alias("best_score")) for k in (3, 4)]
    return parts[0].unionByName(parts[1])


@register("alloc_improvement")
def q_alloc_improvement(spark, sf_dir):
    return exhaustive(spark, sf_dir).select("state_id", "scenario", "best_score", "current_score",
                                            "improvement")


@register("alloc_improvement_summary")
def q_alloc_improvement_summary(spark, sf_dir):
    return AL.improvement_summary(exhaustive(spark, sf_dir))


@register("alloc_improvement_hist")
def q_alloc_improvement_hist(spark, sf_dir):
    return AL.improvement_histogram(exhaustive(spark, sf_dir))


@register("alloc_validate")
def q_alloc_validate(spark, sf_dir):
    return AL.validate_allocations(exhaustive(spark, sf_dir))


# --- P: training-set preparation, M5/M6/M9 metrics ---------------------------------------------


SAMPLE_N_QUERY = 10_000  # fixed-size sample of the prep_sample_n query


@register("prep_drop_null_target")
def q_prep_drop_null_target(spark, sf_dir):
    return PR.drop_null_target(features(spark, sf_dir))


@register("prep_sample_n")
def q_prep_sample_n(spark, sf_dir):
    return PR.sample_n(features(spark, sf_dir), SAMPLE_N_QUERY).select("row_key", P.TARGET_COLUMN)


@register("prep_cast_float")
def q_prep_cast_float(spark, sf_dir):
    return PR.cast_float(features(spark, sf_dir), FEATURE_TABLE_COLS)


@register("prep_impute_median")
def q_prep_impute_median(spark, sf_dir):
    return PR.impute_median(features(spark, sf_dir), P.FEATURE_COLUMNS).select("row_key", *P.FEATURE_COLUMNS)


@register("prep_impute_zero")
def q_prep_impute_zero(spark, sf_dir):
    return PR.impute_zero(features(spark, sf_dir), P.FEATURE_COLUMNS).select("row_key", *P.FEATURE_COLUMNS)


@register("prep_split")
def q_prep_split(spark, sf_dir):
    return PR.random_split(features(spark, sf_dir)).select("row_key", "split")


@register("prep_split_stratified")
def q_prep_split_stratified(spark, sf_dir):
    return PR.stratified_split(features(spark, sf_dir), "slice_id").select("row_key", "slice_id", "split")


@register("prep_standardize")
def q_prep_standardize(spark, sf_dir):
    f = PR.random_split(features(spark, sf_dir))
    return PR.standardize(f, P.FEATURE_COLUMNS, digits=6).select("row_key", "split", *P.FEATURE_COLUMNS)


@register("prep_stats")
def q_prep_stats(spark, sf_dir):
    return PR.train_stats(PR.random_split(features(spark, sf_dir)), P.FEATURE_COLUMNS)


@register("cv_folds")
def q_cv_folds(spark, sf_dir):
    return PR.kfold_assign(features(spark, sf_dir).select("row_key"), "row_key")


def scored_features(spark, sf_dir) -> DataFrame:
    """Features with a deterministic predictor (the A3 heuristic) and the random split."""
    f = PR.random_split(features(spark, sf_dir))
    return f.withColumn("heuristic", AL.heuristic_score(F.col("prb_utilization"), F.col("qos_score"),
                                                        F.col("network_load")))


@register("ml_metrics")
def q_ml_metrics(spark, sf_dir):
    return EV.regression_metrics(scored_features(spark, sf_dir), P.TARGET_COLUMN, "heuristic")


@register("ml_compare")
def q_ml_compare(spark, sf_dir):
    f = scored_features(spark, sf_dir)
    train_mean = f.where(F.col("split") == "train").agg(F.avg(P.TARGET_COLUMN)).first()[0]
    f = f.withColumn("train_mean", F.lit(train_mean).cast("double"))
    return EV.compare_models(f, P.TARGET_COLUMN, {"heuristic": "heuristic", "train_mean": "train_mean"},
                             by=["split"])


@register("ml_verdict")
def q_ml_verdict(spark, sf_dir):
    f = scored_features(spark, sf_dir).where(F.col("split") == "test")
    return EV.verdict(EV.regression_metrics(f, P.TARGET_COLUMN, "heuristic"), exhaustive(spark, sf_dir))


# --- L: access-log analytics -------------------------------------------------------------------


# The test log has a few events per client and hour, so the trailing-window queries use a
# one-day window, a limit of 2 and a threshold of 3 (the defaults stay 1 h / 100 / 10).
LOG_WINDOW_S = 86_400
LOG_LIMIT = 2
LOG_THRESHOLD = 3


def access_log(spark, sf_dir):
    return TB.access_log_from_events(spark, sf_dir)


@register("log_trailing_count")
def q_log_trailing_count(spark, sf_dir):
    return (LG.trailing_count(access_log(spark, sf_dir), window_seconds=LOG_WINDOW_S)
              .select("event_id", "client", "ts", "trailing_count"))


@register("log_rate_limit")
def q_log_rate_limit(spark, sf_dir):
    return LG.rate_limit(access_log(spark, sf_dir), limit=LOG_LIMIT, window_seconds=LOG_WINDOW_S)


@register("log_rate_limit_bucketed")
def q_log_rate_limit_bucketed(spark, sf_dir):
    """L2 with every client's time buckets decided in parallel (the hot-client path)."""
    return LG.rate_limit_bucketed(access_log(spark, sf_dir), limit=LOG_LIMIT, window_seconds=LOG_WINDOW_S)


@register("log_bruteforce")
def q_log_bruteforce(spark, sf_dir):
    return (LG.bruteforce_flags(access_log(spark, sf_dir), LOG_WINDOW_S, LOG_THRESHOLD)
              .select("event_id", "client", "ts", "failure_count", "flagged"))


@register("log_failures_by_client")
def q_log_failures(spark, sf_dir):
    return LG.failures_by_client(access_log(spark, sf_dir))


@register("log_active_requests")
def q_log_active(spark, sf_dir):
    return LG.active_requests(access_log(spark, sf_dir), LOG_WINDOW_S)


@register("log_recent")
def q_log_recent(spark, sf_dir):
    return LG.recent_events(access_log(spark, sf_dir)).select("event_id", "client", "ts", "event_type")


@register("screen_text")
def q_screen_text(spark, sf_dir):
    return (LG.screen_text(TB.screening_input(spark, sf_dir))
              .select("source", "id", "length", "status", "clean_text"))


@register("log_request_rate")
def q_log_request_rate(spark, sf_dir):
    return LG.request_rate(access_log(spark, sf_dir))


# --- M: models (rows-only checks) --------------------------------------------------------------


# Forest of the registered model queries: the size of the published run.
RUN_TREES, RUN_DEPTH = 50, 15
NN_STEPS = 60


def training_frame(spark, sf_dir) -> DataFrame:
    """Features with the hash split and train-fitted median imputation (no test leak)."""
    # the fits pass over it many times, with all cores also when the scan gives its rows to few tasks
    f = written(PR.random_split(spread(features(spark, sf_dir))), "training-rows")
    f = PR.impute_median(f, P.FEATURE_COLUMNS, fit=f.where(F.col("split") == "train"))
    return f.withColumn("is_validation", PR.split_label("row_key", seed=P.RANDOM_SEED + 1,
                                                         test_fraction=0.1) == "test")


def rf_model(spark, sf_dir, t: DataFrame | None = None):
    """A forest fitted on the training rows (of ``t``, if given), and the rows."""
    t = training_frame(spark, sf_dir) if t is None else t
    cols = ["row_key", P.TARGET_COLUMN] + P.FEATURE_COLUMNS
    return FO.fit_forest(t.where(F.col("split") == "train").select(*cols), trees=RUN_TREES, depth=RUN_DEPTH), t


def nn_model(spark, sf_dir, t: DataFrame | None = None):
    """A network fitted on the training rows (of ``t``, if given), a tenth of them for validation,
    and the rows."""
    t = training_frame(spark, sf_dir) if t is None else t
    return NW.fit_network(t.where(F.col("split") == "train"), steps=NN_STEPS), t


@register("ml_rf_fit_score")
def q_ml_rf_fit_score(spark, sf_dir):
    m, t = rf_model(spark, sf_dir)
    return MD.score(m, t.where(F.col("split") == "test")).select("row_key", P.TARGET_COLUMN, "rf_prediction")


@register("ml_gbt_fit_score")
def q_ml_gbt_fit_score(spark, sf_dir):
    t = training_frame(spark, sf_dir)
    m = MD.fit_gbt(t.where(F.col("split") == "train"), iters=20, depth=5)
    return MD.score(m, t.where(F.col("split") == "test")).select("row_key", P.TARGET_COLUMN, "gbt_prediction")


@register("ml_nn_fit_score")
def q_ml_nn_fit_score(spark, sf_dir):
    """M2: the network regressor, scored on the test rows."""
    net, t = nn_model(spark, sf_dir)
    return NW.score_network(net, t.where(F.col("split") == "test")).select("row_key", P.TARGET_COLUMN, "nn_prediction")


@register("ml_ensemble")
def q_ml_ensemble(spark, sf_dir):
    """M4: mean of the forest and the network."""
    rf, t = rf_model(spark, sf_dir)
    net, _ = nn_model(spark, sf_dir, t)
    both = NW.score_network(net, MD.score(rf, t.where(F.col("split") == "test")))
    return MD.ensemble(both, nn_col="nn_prediction").select("row_key", P.TARGET_COLUMN, "rf_prediction", "nn_prediction",
                                                            "ensemble_prediction")


@register("ml_cv")
def q_ml_cv(spark, sf_dir):
    t = training_frame(spark, sf_dir)
    folds = PR.kfold_assign(t, "row_key")
    return FO.cross_validate_forest(folds)


@register("ml_forest_roots")
def q_ml_forest_roots(spark, sf_dir):
    """M1: the first split of every tree of the forest over all rows, which SQL derives anew."""
    f = features(spark, sf_dir).select("row_key", P.TARGET_COLUMN, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in P.FEATURE_COLUMNS])
    nodes = FO.fit_forest(f, trees=RUN_TREES, depth=1).nodes
    return nodes.where("node = 1").select("tree", "feature", "bin", F.round("cut", 9).alias("cut"), F.col("weight").cast("long").alias("weight"))


@register("ml_importance")
def q_ml_importance(spark, sf_dir):
    m, _ = rf_model(spark, sf_dir)
    return MD.feature_importance(m, k=5)


@register("ml_registry_roundtrip")
def q_ml_registry(spark, sf_dir):
    """S3 + S4 + M3: save the forest with its metadata, load the latest version, score the test rows."""
    m, t = rf_model(spark, sf_dir)
    base = scratch_path(spark, "models")
    test = t.where(F.col("split") == "test")
    metrics = EV.regression_metrics(MD.score(m, test), P.TARGET_COLUMN, "rf_prediction").first().asDict()
    MD.save_model(m, base, {"features": P.FEATURE_COLUMNS, "target": P.TARGET_COLUMN, "metrics": metrics})
    loaded, meta, version = MD.load_model(base)
    return (MD.score(loaded, test).select("row_key", "rf_prediction")
              .withColumn("model_version", F.lit(version)))


@register("alloc_model")
def q_alloc_model(spark, sf_dir):
    m, _ = rf_model(spark, sf_dir)
    st = written(spread(states(spark, sf_dir)), "model-states")  # the search itself moves no row
    st = PR.impute_median(st, P.FEATURE_COLUMNS)
    return MD.model_search(st, m).select("state_id", "best_rbg_0", "best_rbg_1", "best_rbg_2", "best_score",
                                         "current_score", "improvement")


@register("report_json")
def q_report_json(spark, sf_dir):
    """Metrics and per-scenario improvement written as one JSON report, read back."""
    from ..sources import sinks as SK
    summary = AL.improvement_summary(exhaustive(spark, sf_dir))
    metrics = EV.regression_metrics(scored_features(spark, sf_dir), P.TARGET_COLUMN, "heuristic")
    path = scratch_path(spark, "report")
    SK.write_report({"heuristic_metrics": metrics, "scenario_results": summary}, path)
    return SK.read_report(spark, path)


# --- A7 / A12: genetic search --------------------------------------------------------------------


@register("alloc_genetic")
def q_alloc_genetic(spark, sf_dir):
    return GA.genetic_search(states(spark, sf_dir).select("state_id", "sum_requested_prbs", "qos_score",
                                                          "network_load"))


@register("alloc_compare")
def q_alloc_compare(spark, sf_dir):
    st = states(spark, sf_dir).select("state_id", "scenario", "sum_requested_prbs", "qos_score",
                                      "network_load")
    return GA.compare_methods(GA.genetic_search(st, keep=["scenario"], with_exhaustive=True))


# --- streaming forms -----------------------------------------------------------------------------


STREAM_FILE_ROWS = 20_000  # rows of a staged file, so the number of files grows with the table


def _stage_parquet(df: DataFrame, name: str) -> str:
    """Write a Spark-derived frame as a set of parquet files (a file-stream source)."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", STREAM_FILE_ROWS).parquet(path)
    return path


@register("stream_kpi_features")
def q_stream_kpi_features(spark, sf_dir):
    """F12 as a stream: KPI rows staged as files, read with readStream, same feature code; a
    micro-batch takes a file for every core."""
    raw = kpi(spark, sf_dir)
    src = _stage_parquet(raw, "kpi-stream-src")
    stream = SS.kpi_feature_stream(spark, src, raw.schema, keep=(),
                                   max_files_per_trigger=spark.sparkContext.defaultParallelism)
    return spark.read.parquet(SS.run_available_now(stream, "kpi-features"))


@register("stream_rate_limit")
def q_stream_rate_limit(spark, sf_dir):
    """L2 as a stream over the access log staged as files, whose rows arrive up to a day late;
    a heartbeat behind the last event lets the watermark pass all of them."""
    log = access_log(spark, sf_dir).select("event_id", "client", "ts")
    # the order of arrival; one micro-batch each: state is carried from one to the next
    late = F.pmod(F.xxhash64("event_id"), F.lit(86_400)) * F.expr("INTERVAL 1 SECOND")
    arriving = log.withColumn("seen", F.col("ts") + late)
    last = log.agg(F.max("ts").alias("ts")).select(
        F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("client"),
        (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("ts"))
    src = scratch_path(spark, "log-stream-src")
    base = scratch_path(spark, "stream-rate-limit")
    buckets = SS.limiter_buckets(log.count())
    for part in [*[arriving.where(c).drop("seen") for c in _time_slices(arriving, "seen")], last]:
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).parquet(src)
        out = SS.rate_limit_stream(stream, limit=LOG_LIMIT, window_seconds=LOG_WINDOW_S, watermark="2 days",
                                   buckets=buckets)
        path = SS.run_available_now(out, "rate-limit", base=base)
    return spark.read.parquet(path)


# --- D1, S1/S2, F13 --------------------------------------------------------------------------------


@register("dp_aggregate")
def q_dp_aggregate(spark, sf_dir):
    """D1 with a test key: up to 3 rows of a client in each of 3 event types, booked in a ledger.
    Epsilon 4, as the smaller test tables have too few clients for groups to be shown at 1."""
    ledger = DP.Ledger(spark, scratch_path(spark, "privacy-ledger"), epsilon=4.0, delta=1e-6)
    return DP.noisy_aggregate(access_log(spark, sf_dir), ["event_type"], "value", secret="test key", client_col="client",
                              id_cols=["event_id"], epsilon=4.0, delta=1e-6, clamp=(0.0, 100.0), max_rows=3, max_groups=3,
                              ledger=ledger)


def _kpi_as_raw_csv_columns(raw: DataFrame) -> DataFrame:
    inv = {v: k for k, v in P.RAW_COLUMN_NAMES.items()}
    return raw.withColumnsRenamed(inv)


@register("kpi_csv_roundtrip")
def q_kpi_csv_roundtrip(spark, sf_dir):
    """S1-style ingest at table scale: KPI rows written as CSV partitioned by policy and
    configuration, read back with the declared schema, dimensions from the paths."""
    raw = _kpi_as_raw_csv_columns(kpi(spark, sf_dir))
    path = scratch_path(spark, "kpi-csv")
    raw.write.partitionBy("sched_policy", "training_config").option("header", True).csv(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields
                       if f.name not in ("sched_policy", "training_config"))
    back = (spark.read.schema(schema + ", sched_policy string, training_config string")
                 .option("header", True).option("basePath", path).csv(path))
    return FE.kpi_features(KC.rename_raw(back))


@register("custom_source_rename")
def q_custom_source_rename(spark, sf_dir):
    """A custom CSV with ``ue_count`` / ``slice_name`` columns goes through the same features."""
    raw = kpi(spark, sf_dir).withColumnsRenamed({"num_ues": "ue_count", "slice_id": "slice_name"})
    raw = _kpi_as_raw_csv_columns(raw)
    path = scratch_path(spark, "custom-csv")
    raw.write.option("header", True).csv(path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return FE.kpi_features(KC.read_custom_csv(spark, path, schema=schema))


@register("compact_types")
def q_compact_types(spark, sf_dir):
    return FE.compact_types_report(feature_table(spark, sf_dir))


def _time_slices(df: DataFrame, ts: str, slices: int = 4) -> list:
    """Conditions splitting ``df`` into ``slices`` consecutive event-time ranges."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(us, [i / slices for i in range(1, slices)], 1000)).first()[0]
    bounds = [None] + list(cuts) + [None]
    conds = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (us > lo)
        if hi is not None:
            cond = cond & (us <= hi)
        conds.append(cond)
    return conds


@register("stream_request_rate")
def q_stream_request_rate(spark, sf_dir):
    """L8 as a stream: the log arrives in four event-time slices; after each arrival the same
    query (same checkpoint: state and watermark carry over) processes the new files.  5-minute
    windows, 10-minute watermark, update mode; the result is every window's final count."""
    log = access_log(spark, sf_dir).select("event_id", "client", "ts")
    src = scratch_path(spark, "rate-stream-src")
    base = scratch_path(spark, "stream-request-rate")
    for cond in _time_slices(log, "ts"):
        log.where(cond).write.mode("append").parquet(src)
        stream = spark.readStream.schema(log.schema).parquet(src)
        SS.run_update_mode(SS.request_rate_stream(stream), base)
    return SS.final_updates(spark, base, ["window_start"])


@register("log_request_rate_sliding")
def q_log_request_rate_sliding(spark, sf_dir):
    """L8, sliding option: 5-minute windows every minute (each request counts in 5 windows)."""
    return LG.request_rate(access_log(spark, sf_dir), minutes=5, slide_minutes=1)


@register("training_run_report")
def q_training_run_report(spark, sf_dir):
    """The whole training run on the KPI rows, as its JSON report (rows-only check)."""
    from .run import training_run
    return training_run(kpi(spark, sf_dir), scratch_path(spark, "run-report"),
                        model_path=scratch_path(spark, "run-models"), trees=RUN_TREES, depth=RUN_DEPTH)
