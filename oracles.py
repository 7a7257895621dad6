"""DuckDB oracle SQL for the registered queries (tables are pre-registered views).

Double literals are written as ``Ne0`` (a bare ``0.4`` is DECIMAL in both engines) and every
expression keeps the association order of the Spark code, so row-local results are bit-equal.
Aggregates are rounded to 6 decimals because summation order differs between engines.
"""

from __future__ import annotations

import math

# fixed values, written out here so that a wrong constant of the library shows: resource-block
# groups of slices 0, 1, 2 for tr0, tr1, ...
SLICE_TABLE = """2 13 2, 4 11 2, 6 9 2, 8 7 2, 10 5 2, 12 3 2, 14 1 2, 2 11 4, 4 9 4, 6 7 4, 8 5 4, 10 3 4,
12 1 4, 2 9 6, 4 7 6, 6 5 6, 8 3 6, 10 1 6, 2 7 8, 4 5 8, 6 3 8, 8 1 8, 2 5 10, 4 3 10, 6 1 10, 2 3 12,
4 1 12, 2 1 14"""


def _slice_values() -> str:
    rows = [f"('tr{t}', {i}, {r})" for t, row in enumerate(SLICE_TABLE.split(",")) for i, r in enumerate(row.split())]
    return ", ".join(rows)


KPI_CTE = """
kpi AS (
  SELECT
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
    epoch_ms(l_shipdate) + (l_orderkey % 1440) * 60000 AS ts_ms,
    'sched' || CAST(l_linenumber % 4 AS VARCHAR) AS sched_policy,
    'tr' || CAST(l_suppkey % 30 AS VARCHAR) AS training_config,
    CAST(l_partkey % 3 AS INTEGER) AS slice_id,
    CAST(1 + 7 * (l_orderkey % 7) AS INTEGER) AS bs_id,
    CAST(1 + l_orderkey % 4 AS INTEGER) AS exp_id,
    'user_' || CAST(l_partkey AS VARCHAR) AS imsi,
    l_extendedprice / 20000e0 AS tx_brate_dl_mbps,
    CAST(trunc(l_quantity) AS INTEGER) - 1 AS sum_requested_prbs,
    CAST(((CAST(trunc(l_quantity) AS INTEGER) - 1) * (10 - l_orderkey % 4)) // 10
         + CASE WHEN l_orderkey % 11 = 0 THEN 3 ELSE 0 END AS INTEGER) AS sum_granted_prbs,
    CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_discount * 100e0 END AS tx_errors_dl_pct,
    CASE WHEN l_orderkey % 47 = 0 THEN NULL ELSE l_tax * 100e0 END AS rx_errors_ul_pct,
    CAST(CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE 1 + l_partkey % 15 END AS INTEGER) AS dl_cqi,
    CAST(CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE 1 + l_suppkey % 42 END AS INTEGER) AS num_ues
  FROM lineitem
)"""

SLICE_CTE = f"""
slice_cfg(training_config, slice_id, rbgs) AS (VALUES {_slice_values()})"""


def clip_sql(x: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE least(greatest({x}, {lo}), {hi}) END)"


_PRB = clip_sql("CASE WHEN CAST(k.sum_requested_prbs AS DOUBLE) > 0 THEN "
                "CAST(k.sum_granted_prbs AS DOUBLE) / CAST(k.sum_requested_prbs AS DOUBLE) ELSE 0e0 END")
_THR = ("CASE WHEN CAST(k.sum_granted_prbs AS DOUBLE) > 0 THEN "
        "coalesce(k.tx_brate_dl_mbps, 0e0) / CAST(k.sum_granted_prbs AS DOUBLE) ELSE 0e0 END")
_DL = "coalesce(CAST(k.tx_errors_dl_pct AS DOUBLE), 2.5e0)"
_UL = "coalesce(CAST(k.rx_errors_ul_pct AS DOUBLE), 2.5e0)"
_CQI = "coalesce(CAST(k.dl_cqi AS DOUBLE), 10e0)"
_UES = "coalesce(CAST(k.num_ues AS DOUBLE), 5e0)"
_QOS = clip_sql(f"(0.4e0 * ((100e0 - {_DL}) / 100e0) + 0.3e0 * ((100e0 - {_UL}) / 100e0))"
                f" + 0.3e0 * ({_CQI} / 15e0)")

# Stage 1: row-local features with every intermediate kept (k.* plus the engineered columns).
FEAT_ALL_CTE = f"""
feat_all AS (
  SELECT k.*,
    CAST(hour(epoch_ms(k.ts_ms)) AS INTEGER) AS hour,
    CAST(minute(epoch_ms(k.ts_ms)) AS INTEGER) AS minute,
    CAST(isodow(epoch_ms(k.ts_ms)) - 1 AS INTEGER) AS day_of_week,
    CAST(CASE k.sched_policy WHEN 'sched0' THEN 0 WHEN 'sched1' THEN 1 WHEN 'sched2' THEN 2 END
         AS INTEGER) AS sched_policy_num,
    CAST(coalesce(c.rbgs, 0) AS INTEGER) AS allocated_rbgs,
    {_PRB} AS prb_utilization,
    {_THR} AS throughput_efficiency,
    {_QOS} AS qos_score,
    {_UES} / 42e0 AS network_load
  FROM kpi k LEFT JOIN slice_cfg c
    ON c.training_config = k.training_config AND c.slice_id = k.slice_id
)"""

FEAT_CTE = f"""
feat AS (
  SELECT row_key, slice_id, sched_policy_num, allocated_rbgs, sum_requested_prbs,
    sum_granted_prbs, prb_utilization, throughput_efficiency, qos_score, network_load,
    hour, minute, day_of_week,
    {clip_sql("(0.5e0 * throughput_efficiency + 0.3e0 * qos_score) + 0.2e0 * prb_utilization")}
      AS allocation_efficiency
  FROM feat_all
)"""

BASE = "WITH " + ",".join([KPI_CTE, SLICE_CTE, FEAT_ALL_CTE, FEAT_CTE])

FEATURES_12 = ("slice_id, sched_policy_num, allocated_rbgs, sum_requested_prbs, sum_granted_prbs, "
               "prb_utilization, throughput_efficiency, qos_score, network_load, hour, minute, "
               "day_of_week")


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["kpi_features"] = f"{BASE} SELECT {FEATURES_12}, allocation_efficiency FROM feat"
    q["kpi_efficiency_by_policy_slice"] = f"""{BASE}
      SELECT sched_policy_num, slice_id, count(*) AS n_rows,
        round(avg(allocation_efficiency), 6) AS avg_efficiency,
        round(avg(throughput_efficiency), 6) AS avg_throughput_eff,
        round(avg(prb_utilization), 6) AS avg_prb_utilization
      FROM feat GROUP BY sched_policy_num, slice_id"""
    q["feat_temporal"] = f"{BASE} SELECT row_key, ts_ms, hour, minute, day_of_week FROM feat_all"
    q["feat_sched_code"] = f"{BASE} SELECT row_key, sched_policy, sched_policy_num FROM feat_all"
    q["feat_allocated_rbgs"] = (f"{BASE} SELECT row_key, training_config, slice_id, allocated_rbgs "
                                f"FROM feat_all")
    q["feat_prb_utilization"] = (f"{BASE} SELECT row_key, sum_requested_prbs, sum_granted_prbs, "
                                 f"prb_utilization FROM feat_all")
    q["feat_throughput_eff"] = f"{BASE} SELECT row_key, throughput_efficiency FROM feat_all"
    q["impute_constants"] = f"""{BASE}
      SELECT k.row_key, {_DL} AS tx_errors_dl_pct, {_UL} AS rx_errors_ul_pct,
             {_CQI} AS dl_cqi, {_UES} AS num_ues FROM kpi k"""
    q["feat_qos_score"] = f"{BASE} SELECT row_key, qos_score FROM feat_all"
    q["feat_network_load"] = f"{BASE} SELECT row_key, network_load FROM feat_all"
    q["feat_allocation_efficiency"] = f"{BASE} SELECT row_key, allocation_efficiency FROM feat"
    q.update(quality_sql())
    q.update(alloc_sql())
    q.update(prep_sql())
    q.update(log_sql())
    q["stream_kpi_features"] = q["kpi_features"]
    q["stream_request_rate"] = q["log_request_rate"]
    q.update(misc_sql())
    q["ml_verdict"] = _verdict_sql(q.pop("_alloc_base"))
    q.update(property_sql())
    return q


def _verdict_sql(alloc_base: str) -> str:
    split = "CASE WHEN substr(md5(row_key || '|42'), 1, 4) < '3333' THEN 'test' ELSE 'train' END"
    heur = clip_sql("(0.4e0 * prb_utilization + 0.4e0 * qos_score) + 0.2e0 * (1e0 - network_load)")
    return f"""{alloc_base},
      tsc AS (SELECT *, {heur} AS heuristic FROM feat WHERE {split} = 'test'),
      m AS (SELECT {_metrics_sql('allocation_efficiency', 'heuristic')} FROM tsc),
      e AS (SELECT round(avg(best_score), 6) AS avg_efficiency,
                   round(avg(best_score - current_score), 6) AS avg_improvement FROM res),
      k AS (SELECT m.r2, m.mae, e.avg_efficiency, e.avg_improvement,
                   CAST((CASE WHEN m.r2 >= 0.7e0 THEN 1 ELSE 0 END) + (CASE WHEN m.mae <= 0.1e0 THEN 1 ELSE 0 END)
                      + (CASE WHEN e.avg_efficiency >= 0.5e0 THEN 1 ELSE 0 END)
                      + (CASE WHEN e.avg_improvement >= 0e0 THEN 1 ELSE 0 END) AS INTEGER) AS performance_score
            FROM m, e)
      SELECT r2, mae, avg_efficiency, avg_improvement, performance_score,
        CASE WHEN r2 >= 0.7e0 AND mae <= 0.1e0 THEN 'EXCELLENT' WHEN r2 >= 0.7e0 OR mae <= 0.1e0 THEN 'GOOD'
             ELSE 'NEEDS IMPROVEMENT' END AS model_verdict,
        CASE WHEN avg_efficiency >= 0.5e0 AND avg_improvement >= 0e0 THEN 'EXCELLENT' ELSE 'GOOD' END
          AS optimization_verdict,
        CASE WHEN performance_score >= 3 THEN 'EXCELLENT' WHEN performance_score >= 2 THEN 'GOOD'
             ELSE 'NEEDS IMPROVEMENT' END AS overall_status
      FROM k"""


FT_COLS = FEATURES_12.split(", ") + ["allocation_efficiency"]
KPI_COLS = ["row_key", "ts_ms", "sched_policy", "training_config", "slice_id", "bs_id", "exp_id",
            "imsi", "tx_brate_dl_mbps", "sum_requested_prbs", "sum_granted_prbs",
            "tx_errors_dl_pct", "rx_errors_ul_pct", "dl_cqi", "num_ues"]


def _outliers_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
      SELECT '{c}' AS "column", round(q1, 9) AS q1, round(q3, 9) AS q3, round(lower, 9) AS lower,
        round(upper, 9) AS upper,
        (SELECT count(*) FROM {src} WHERE CAST({c} AS DOUBLE) < lower OR CAST({c} AS DOUBLE) > upper)
          AS n_outliers,
        (CAST((SELECT count(*) FROM {src} WHERE CAST({c} AS DOUBLE) < lower
                OR CAST({c} AS DOUBLE) > upper) AS DOUBLE) / (SELECT count(*) FROM {src})) * 100e0
          AS outlier_pct
      FROM (SELECT q1, q3, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper
            FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
                         quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {src}))""")
    return " UNION ALL ".join(parts)


def _bounds_cte(src: str, cols: list[str]) -> str:
    sel = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1_{c}, "
                    f"quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3_{c}" for c in cols)
    return f"bounds AS (SELECT {sel} FROM {src})"


def quality_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    miss = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) "
        f"/ CAST(count(*) AS DOUBLE)) * 100e0 AS missing_pct FROM kpi" for c in KPI_COLS)
    q["dq_missing"] = f"{BASE} {miss}"
    q["dq_outliers_iqr"] = f"{BASE}, ft AS (SELECT * FROM feat) {_outliers_sql('ft', FT_COLS)}"
    q["dq_outliers_events"] = _outliers_sql("events", ["event_id", "user_id", "value"])
    rng = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min(CAST({c} AS DOUBLE)) AS min, max(CAST({c} AS DOUBLE)) AS max, "
        f"round(avg(CAST({c} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std "
        f"FROM feat" for c in FT_COLS)
    q["dq_ranges"] = f"{BASE} {rng}"
    q["dq_profile_incremental"] = f"{BASE} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, (CAST(count(*) - count({c}) AS DOUBLE) "
        f"/ CAST(count(*) AS DOUBLE)) * 100e0 AS missing_pct, min(CAST({c} AS DOUBLE)) AS min, "
        f"max(CAST({c} AS DOUBLE)) AS max, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS std, true AS quartiles_within FROM feat" for c in FT_COLS)
    q["dq_duplicates"] = f"""{BASE}
      SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
        round((CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) * 100e0, 6) AS duplicate_pct
      FROM (SELECT count(*) AS n FROM kpi GROUP BY bs_id, slice_id, sum_requested_prbs)"""
    q["dq_duplicates_docs"] = """
      SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates,
        round((CAST(sum(n - 1) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) * 100e0, 6) AS duplicate_pct
      FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang, source)"""
    miss_ft = " UNION ALL ".join(
        f"SELECT (CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE))"
        f" * 100e0 AS m FROM ft" for c in FT_COLS)
    grp = ", ".join(FT_COLS)
    q["dq_score"] = f"""{BASE}, ft AS (SELECT {grp} FROM feat),
      o AS ({_outliers_sql('ft', FT_COLS)}),
      m AS ({miss_ft}),
      d AS (SELECT sum(n) AS rows, sum(n - 1) AS dups FROM (SELECT count(*) AS n FROM ft GROUP BY ALL)),
      s AS (SELECT (SELECT avg(m) FROM m) AS am, (SELECT avg(outlier_pct) FROM o) AS ao,
                   (SELECT CAST(rows AS BIGINT) FROM d) AS rows, (SELECT CAST(dups AS BIGINT) FROM d) AS dups)
      SELECT rows AS total_records, round(am, 6) AS avg_missing_pct, round(ao, 6) AS avg_outlier_pct,
        dups AS duplicates, round((CAST(dups AS DOUBLE) / CAST(rows AS DOUBLE)) * 100e0, 6) AS duplicate_pct,
        round(greatest(0e0, ((100e0 - am) - ao) - (CAST(dups AS DOUBLE) / CAST(rows AS DOUBLE)) * 100e0), 6)
          AS quality_score,
        round(greatest(0e0, ((100e0 - am) - ao) - (CAST(dups AS DOUBLE) / CAST(rows AS DOUBLE)) * 100e0), 6)
          >= 70e0 AS passed
      FROM s"""
    # dq_score groups by the values; GROUP BY ALL on the feature columns
    q["dq_score"] = q["dq_score"].replace("FROM ft GROUP BY ALL", f"FROM ft GROUP BY {grp}")
    capped = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE least(greatest(CAST({c} AS DOUBLE), "
        f"b.q1_{c} - 1.5e0 * (b.q3_{c} - b.q1_{c})), b.q3_{c} + 1.5e0 * (b.q3_{c} - b.q1_{c})) END AS {c}"
        for c in FT_COLS)
    q["clean_iqr"] = f"{BASE}, {_bounds_cte('feat', FT_COLS)} SELECT f.row_key, {capped} FROM feat f, bounds b"
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_samp(CAST({c} AS DOUBLE)) AS s_{c}"
                   for c in FT_COLS)
    cond = " AND ".join(f"abs((CAST(f.{c} AS DOUBLE) - s.m_{c}) / s.s_{c}) < 1.5e0" for c in FT_COLS)
    q["clean_zscore"] = f"{BASE}, st AS (SELECT {st} FROM feat) SELECT f.* FROM feat f, st s WHERE {cond}"
    inf = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE) "
        f"AS n_infinite, count(*) FILTER (WHERE abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE) > 0 "
        f"AS has_infinite FROM feat" for c in FT_COLS)
    q["dq_infinite"] = f"{BASE} {inf}"
    const = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(var_samp(CAST({c} AS DOUBLE)), 6) AS variance, "
        f"var_samp(CAST({c} AS DOUBLE)) = 0 AS is_constant FROM feat" for c in FT_COLS)
    q["dq_constant"] = f"{BASE} {const}"
    mx = ", ".join(f"(CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) / CAST(count(*) AS DOUBLE)) * 100e0"
                   for c in FT_COLS[:-1])
    q["dq_train_checks"] = f"""{BASE}
      SELECT count(*) AS rows, round(greatest({mx}), 6) AS max_missing_pct,
        min(allocation_efficiency) AS target_min, max(allocation_efficiency) AS target_max,
        var_samp(allocation_efficiency) = 0 AS target_is_constant FROM feat"""
    q["dq_diff_runs"] = f"""{BASE}
      SELECT (SELECT count(*) FROM (SELECT * FROM feat EXCEPT ALL SELECT * FROM feat)) AS left_only,
             (SELECT count(*) FROM (SELECT * FROM feat EXCEPT ALL SELECT * FROM feat)) AS right_only,
             true AS equal"""
    return q


def _h_sql(r: str) -> str:
    prb = f"least(1e0, coalesce(CAST(sum_requested_prbs AS DOUBLE), 1e0) / CAST(greatest(1, {r}) AS DOUBLE))"
    return clip_sql(f"(0.4e0 * {prb} + 0.4e0 * qos_score) + 0.2e0 * (1e0 - network_load)")


def alloc_sql(total: int = 17) -> dict[str, str]:
    q: dict[str, str] = {}
    st = f"""{BASE},
      st AS (SELECT row_number() OVER () AS sid, row_key AS state_id, sum_requested_prbs, qos_score, network_load,
                    throughput_efficiency, coalesce(CAST(num_ues AS DOUBLE), 5e0) AS num_ues_i
             FROM feat_all),
      stx AS (SELECT *, CASE WHEN num_ues_i <= 10 THEN 'low_load' WHEN num_ues_i <= 20 THEN 'medium_load'
                             WHEN num_ues_i <= 27 THEN 'high_load' ELSE 'peak_hours' END AS scenario FROM st),
      cands AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST({total} - a - b AS INTEGER) AS c
                FROM range(1, {total - 1}) ra(a), range(1, {total}) rb(b) WHERE b < {total} - a AND {total} - a - b >= 1),
      scored AS (SELECT s.*, c.a, c.b, c.c,
                   (({_h_sql('c.a')} + {_h_sql('c.b')}) + {_h_sql('c.c')}) / 3e0 AS score
                 FROM stx s, cands c),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, a, b) AS rn
                              FROM scored) WHERE rn = 1),
      res AS (SELECT b.state_id, b.scenario, b.a AS best_rbg_0, b.b AS best_rbg_1, b.c AS best_rbg_2,
                     b.score AS best_score,
                     (({_h_sql('5')} + {_h_sql('7')}) + {_h_sql('5')}) / 3e0 AS current_score
              FROM best b)"""
    q["alloc_features"] = f"""{st},
      x AS (SELECT s.state_id, s.sum_requested_prbs, u.slice_id, u.allocated_rbgs FROM st s, cands c,
              (SELECT 0 AS slice_id UNION ALL SELECT 1 UNION ALL SELECT 2) sl(slice_id),
              LATERAL (SELECT sl.slice_id AS slice_id,
                              CAST(CASE sl.slice_id WHEN 0 THEN c.a WHEN 1 THEN c.b ELSE c.c END AS INTEGER)
                                AS allocated_rbgs) u)
      SELECT slice_id, allocated_rbgs, count(*) AS n_rows,
        round(avg(least(1e0, coalesce(CAST(sum_requested_prbs AS DOUBLE), 1e0)
                             / CAST(greatest(1, allocated_rbgs) AS DOUBLE))), 6) AS avg_prb_utilization
      FROM x GROUP BY slice_id, allocated_rbgs"""
    q["alloc_heuristic"] = f"""{BASE} SELECT row_key,
      {clip_sql("(0.4e0 * prb_utilization + 0.4e0 * qos_score) + 0.2e0 * (1e0 - network_load)")} AS heuristic
      FROM feat"""
    q["alloc_scores"] = f"""{st}
      SELECT a AS rbg_0, b AS rbg_1, c AS rbg_2, count(*) AS n_states, round(avg(score), 6) AS avg_score,
             round(max(score), 6) AS max_score FROM scored GROUP BY a, b, c"""
    q["alloc_exhaustive"] = f"{st} SELECT state_id, best_rbg_0, best_rbg_1, best_rbg_2, best_score FROM res"
    own = lambda r: f"CAST(floor({_h_sql(r)} * 1e12 + 0.5e0) AS BIGINT)"
    q["alloc_k_slices"] = f"""{st},
      k3 AS (SELECT s.sid, s.state_id, c.a, c.b, c.c, {own('c.a')} + {own('c.b')} + {own('c.c')} AS v FROM stx s, cands c),
      c4 AS (SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CAST(c AS INTEGER) AS c, CAST({total} - a - b - c AS INTEGER) AS d
             FROM range(1, {total}) ra(a), range(1, {total}) rb(b), range(1, {total}) rc(c) WHERE a + b + c < {total}),
      h AS (SELECT s.sid, s.state_id, list_transform(range(1, {total}), lambda r: CAST(floor({_h_sql('r')} * 1e12 + 0.5e0) AS BIGINT)) AS hs FROM stx s),
      k4 AS (SELECT sid, state_id, a, b, c4.c, d, hs[a] + hs[b] + hs[c4.c] + hs[d] AS v FROM h, c4)
      SELECT 3 AS slices, state_id, a || ',' || b || ',' || c AS best_rbgs, round(CAST(v AS DOUBLE) / 1e12 / 3e0, 9) AS best_score FROM
        (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY v DESC, a, b) AS rn FROM k3) WHERE rn = 1
      UNION ALL SELECT 4, state_id, a || ',' || b || ',' || c || ',' || d, round(CAST(v AS DOUBLE) / 1e12 / 4e0, 9) FROM
        (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY v DESC, a, b, c) AS rn FROM k4) WHERE rn = 1"""
    lin = "(CAST(c.a AS DOUBLE) * qos_score + CAST(c.b AS DOUBLE) * network_load) + CAST(c.c AS DOUBLE) * throughput_efficiency"
    q["alloc_linear"] = f"""{st},
      ls AS (SELECT s.sid, s.state_id, c.a, c.b, c.c, {lin} AS score FROM stx s, cands c)
      SELECT state_id, a AS best_rbg_0, b AS best_rbg_1, c AS best_rbg_2, score AS best_score FROM
        (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, a, b) AS rn FROM ls) WHERE rn = 1"""
    q["alloc_improvement"] = f"""{st}
      SELECT state_id, scenario, best_score, current_score, best_score - current_score AS improvement FROM res"""
    q["alloc_improvement_summary"] = f"""{st}
      SELECT scenario, count(*) AS steps, round(avg(best_score - current_score), 6) AS avg_improvement,
        round(max(best_score - current_score), 6) AS max_improvement,
        round(min(best_score - current_score), 6) AS min_improvement
      FROM res GROUP BY ROLLUP (scenario)"""
    q["alloc_improvement_hist"] = f"""{st}
      SELECT CAST(floor((best_score - current_score) / 0.01e0) AS BIGINT) AS bin, count(*) AS n,
        round(avg(best_score - current_score), 6) AS mean_improvement,
        round(CAST(floor((best_score - current_score) / 0.01e0) AS BIGINT) * 0.01e0, 6) AS bin_start
      FROM res GROUP BY 1"""
    q["_alloc_base"] = st
    q["alloc_validate"] = f"""{st}
      SELECT count(*) AS n_checked,
        count(*) FILTER (WHERE best_rbg_0 + best_rbg_1 + best_rbg_2 <> {total} OR best_rbg_0 < 1
                          OR best_rbg_1 < 1 OR best_rbg_2 < 1) AS n_invalid,
        count(*) FILTER (WHERE best_rbg_0 + best_rbg_1 + best_rbg_2 <> {total} OR best_rbg_0 < 1
                          OR best_rbg_1 < 1 OR best_rbg_2 < 1) = 0 AS valid
      FROM res"""
    return q


def _metrics_sql(y: str, p: str) -> str:
    e = f"(CAST({p} AS DOUBLE) - CAST({y} AS DOUBLE))"
    return (f"count(*) AS n, round(1e0 - sum({e} * {e}) / (var_pop(CAST({y} AS DOUBLE)) * CAST(count(*) AS DOUBLE)), 6) AS r2, "
            f"round(avg(abs({e})), 6) AS mae, round(sum({e} * {e}) / CAST(count(*) AS DOUBLE), 6) AS mse, "
            f"round(sqrt(sum({e} * {e}) / CAST(count(*) AS DOUBLE)), 6) AS rmse")


def prep_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    f12 = FEATURES_12
    h = "md5(row_key || '|42')"
    split = f"CASE WHEN substr({h}, 1, 4) < '3333' THEN 'test' ELSE 'train' END"
    sp = f"{BASE}, sp AS (SELECT *, {split} AS split FROM feat)"
    q["prep_drop_null_target"] = f"{BASE} SELECT * FROM feat WHERE allocation_efficiency IS NOT NULL"
    q["prep_sample_n"] = f"{BASE} SELECT row_key, allocation_efficiency FROM feat ORDER BY {h} LIMIT 10000"
    q["prep_cast_float"] = f"{BASE} SELECT row_key, " + ", ".join(
        f"CAST({c} AS FLOAT) AS {c}" for c in FT_COLS) + " FROM feat"
    med = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM feat)) AS {c}"
                    for c in FEATURES_12.split(", "))
    q["prep_impute_median"] = f"{BASE} SELECT row_key, {med} FROM feat"
    q["prep_impute_zero"] = f"{BASE} SELECT row_key, " + ", ".join(
        f"coalesce({c}, 0) AS {c}" for c in FEATURES_12.split(", ")) + " FROM feat"
    q["prep_split"] = f"{sp} SELECT row_key, split FROM sp"
    q["prep_split_stratified"] = f"""{BASE}
      SELECT row_key, slice_id, CASE WHEN rn <= floor(0.2e0 * n) THEN 'test' ELSE 'train' END AS split
      FROM (SELECT row_key, slice_id, row_number() OVER (PARTITION BY slice_id ORDER BY {h}) AS rn,
                   count(*) OVER (PARTITION BY slice_id) AS n FROM feat)"""
    cols = FEATURES_12.split(", ")
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, "
                      f"CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 THEN 1e0 ELSE stddev_pop(CAST({c} AS DOUBLE)) END AS s_{c}"
                      for c in cols)
    z = ", ".join(f"round((CAST(f.{c} AS DOUBLE) - s.m_{c}) / s.s_{c}, 6) AS {c}" for c in cols)
    q["prep_standardize"] = f"""{sp}, st AS (SELECT {stats} FROM sp WHERE split = 'train')
      SELECT f.row_key, f.split, {z} FROM sp f, st s"""
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train'), 6) AS mean, "
        f"round(stddev_samp(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train'), 6) AS std, "
        f"min(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train') AS min, "
        f"max(CAST({c} AS DOUBLE)) FILTER (WHERE split = 'train') AS max, "
        f"count(*) FILTER (WHERE split = 'train') AS train_size, "
        f"count(*) FILTER (WHERE split <> 'train') AS test_size FROM sp" for c in FT_COLS)
    q["prep_stats"] = f"{sp} {parts}"
    q["cv_folds"] = f"{BASE} SELECT row_key, CAST(ntile(5) OVER (ORDER BY row_key) AS INTEGER) AS fold FROM feat"
    heur = clip_sql("(0.4e0 * prb_utilization + 0.4e0 * qos_score) + 0.2e0 * (1e0 - network_load)")
    sc = f"{sp}, sc AS (SELECT *, {heur} AS heuristic FROM sp)"
    q["ml_metrics"] = f"{sc} SELECT {_metrics_sql('allocation_efficiency', 'heuristic')} FROM sc"
    q["ml_compare"] = f"""{sc},
      tm AS (SELECT avg(allocation_efficiency) AS train_mean FROM sc WHERE split = 'train'),
      lg AS (SELECT 'heuristic' AS model, split, allocation_efficiency AS y, heuristic AS p FROM sc
             UNION ALL SELECT 'train_mean', split, allocation_efficiency, (SELECT train_mean FROM tm) FROM sc)
      SELECT model, split, {_metrics_sql('y', 'p')} FROM lg GROUP BY model, split"""
    return q


def log_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    w = 86_400 * 1_000_000 - 1
    q["log_trailing_count"] = f"""SELECT event_id, user_id AS client, ts,
      count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
        AS trailing_count FROM events"""
    q["log_bruteforce"] = f"""SELECT event_id, client, ts, failure_count, failure_count >= 3 AS flagged FROM (
      SELECT event_id, user_id AS client, ts,
        count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN {w} PRECEDING AND CURRENT ROW)
          AS failure_count FROM events WHERE event_type = 'error')"""
    # L2: recursive per client, carrying the list of accepted times still inside the window
    keep = f"list_filter(r.acc, lambda x: e.us - x < {w + 1})"
    q["log_rate_limit"] = f"""WITH RECURSIVE ev AS (
        SELECT event_id, user_id AS client, ts, epoch_us(ts) AS us,
               row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn
        FROM events),
      r AS (
        SELECT client, rn, event_id, ts, true AS accepted, [us] AS acc FROM ev WHERE rn = 1
        UNION ALL
        SELECT e.client, e.rn, e.event_id, e.ts, len({keep}) < 2 AS accepted,
               CASE WHEN len({keep}) < 2 THEN list_append({keep}, e.us) ELSE {keep} END AS acc
        FROM r JOIN ev e ON e.client = r.client AND e.rn = r.rn + 1)
      SELECT event_id, client, ts, accepted FROM r"""
    q["log_rate_limit_bucketed"] = q["log_rate_limit"]
    q["stream_rate_limit"] = q["log_rate_limit"]
    # Three rows of a client in each of three groups, epsilon 4 over three statistics, delta 1e-6
    def lap(salt: str, b: str) -> str:
        u = (f"((CAST(('0x' || substr(sha256('8:test key|{salt}|' || g), 1, 13)) AS BIGINT) + 0.5e0)"
             f" / 4503599627370496e0 - 0.5e0)")
        return f"((-({b})) * sign({u}) * ln(1e0 - 2e0 * abs({u})))"
    q["dp_aggregate"] = f"""WITH r AS (
        SELECT *, coalesce(length(event_type) || ':' || event_type, '-') AS g,
               coalesce(length(CAST(user_id AS VARCHAR)) || ':' || user_id, '-') AS c FROM events),
      some_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY c, g ORDER BY
            sha256('8:test key|row|' || length(CAST(event_id AS VARCHAR)) || ':' || event_id), event_id) AS n FROM r) WHERE n <= 3),
      some_groups AS (SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY
            sha256('8:test key|group|' || c || g), g) AS k FROM some_rows) WHERE k <= 3),
      t AS (SELECT event_type, g, count(*) AS n, count(DISTINCT c) AS clients,
                   sum(least(greatest(coalesce(value, 0e0), 0e0), 100e0)) AS s
            FROM some_groups GROUP BY event_type, g)
      SELECT event_type,
        round(CAST(n AS DOUBLE) + {lap('count', '9e0 / (4e0 / 3e0)')}, 6) AS noisy_count,
        round(round(s, 6) + {lap('sum', '900e0 / (4e0 / 3e0)')}, 6) AS noisy_sum
      FROM t WHERE clients + {lap('clients', '3e0 / (4e0 / 3e0)')} >= 1e0 + 3e0 / (4e0 / 3e0) * ln(3e0 / 2e-6)"""
    q["log_failures_by_client"] = """SELECT user_id AS client, count(*) AS failures FROM events
      WHERE event_type = 'error' GROUP BY user_id"""
    q["log_active_requests"] = f"""SELECT user_id AS client, count(*) AS active_requests FROM events,
      (SELECT max(epoch_us(ts)) AS now FROM events) n
      WHERE n.now - epoch_us(ts) < {w + 1} AND epoch_us(ts) <= n.now GROUP BY user_id"""
    q["log_recent"] = """SELECT event_id, user_id AS client, ts, event_type FROM events
      ORDER BY ts DESC, event_id DESC LIMIT 50"""
    cls = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
           r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
    danger = " OR ".join(f"contains(lower(text), '{p}')" for p in (
        "<script", "javascript:", "data:", "vbscript:", "onload=", "onerror="))
    q["screen_text"] = f"""WITH s AS (
        SELECT 'pages' AS source, page_id AS id, html AS text FROM pages
        UNION ALL SELECT 'documents', doc_id, text FROM documents),
      st AS (SELECT source, id, text, CAST(length(text) AS INTEGER) AS length,
        CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN length(text) > 1000 THEN 'too_long'
             WHEN {danger} THEN 'dangerous' ELSE 'accepted' END AS status FROM s)
      SELECT source, id, length, status,
        CASE WHEN status = 'accepted' THEN regexp_replace(text, '^{cls}+|{cls}+$', '', 'g')
             WHEN status = 'empty' THEN text END AS clean_text FROM st"""
    q["log_request_rate_sliding"] = """SELECT time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(k) AS window_start,
      count(*) AS requests, CAST(count(*) AS DOUBLE) / 300e0 AS rate_per_s
      FROM events, range(0, 5) r(k) GROUP BY 1"""
    q["log_request_rate"] = """SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, count(*) AS requests,
      CAST(count(*) AS DOUBLE) / 300e0 AS rate_per_s FROM events GROUP BY 1"""
    return q


def misc_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    base = f"{BASE} SELECT {FEATURES_12}, allocation_efficiency FROM feat"
    q["kpi_csv_roundtrip"] = base
    q["custom_source_rename"] = base
    ints = ["slice_id", "sched_policy_num", "allocated_rbgs", "sum_requested_prbs", "sum_granted_prbs",
            "hour", "minute", "day_of_week"]
    parts = []
    for c in FT_COLS:
        if c in ints:
            parts.append(f"""SELECT '{c}' AS "column", 'int' AS old_type,
              CASE WHEN min({c}) IS NULL THEN 'tinyint'
                   WHEN min({c}) >= -128 AND max({c}) <= 127 THEN 'tinyint'
                   WHEN min({c}) >= -32768 AND max({c}) <= 32767 THEN 'smallint'
                   ELSE 'int' END AS new_type FROM feat""")
        else:
            parts.append(f"SELECT '{c}' AS \"column\", 'double' AS old_type, 'float' AS new_type")
    q["compact_types"] = f"{BASE} " + " UNION ALL ".join(parts)
    return q


def forest_roots_sql(trees: int = 50, bins: int = 64, rows: int = 100_000, steps: int = 2**20) -> str:
    """The best first split of every tree: cuts, bins, weights and gains by their definitions."""
    prime = 2**31 - 1
    poisson = [int(prime * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(9)]
    weight = " + ".join(f"(u >= {p})::BIGINT" for p in poisson)
    from slicewise.params import FEATURE_COLUMNS as columns
    values = ", ".join(f"({i}, coalesce(CAST({c} AS DOUBLE), 0e0))" for i, c in enumerate(columns))
    hexed = lambda x: f"('0x' || substr(md5({x}), 1, 8))::BIGINT"
    return f"""{BASE},
      r AS (SELECT row_key, {hexed("row_key || '|42'")} % {prime} AS h, CAST(allocation_efficiency AS DOUBLE) AS y, f.*
            FROM feat, LATERAL (SELECT * FROM (VALUES {values}) v(feature, x)) f WHERE allocation_efficiency IS NOT NULL),
      k AS (SELECT count(*) / {len(columns)} AS n, min(y) AS low, (max(y) - min(y)) / {steps} AS step FROM r),
      s AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i,
                   count(*) OVER (PARTITION BY feature) AS c, max(x) OVER (PARTITION BY feature) AS top
            FROM r, k WHERE h < floor(least(1e0, {rows}e0 / n) * {prime})),
      cut AS (SELECT DISTINCT feature, x AS cut FROM s, range(1, {bins}) g(j) WHERE i = (j * c) // {bins} AND x < top),
      cl AS (SELECT feature, list_sort(list(cut)) AS cuts FROM cut GROUP BY feature),
      b AS (SELECT r.feature, h, CAST(round_even((y - low) / step, 0) AS BIGINT) AS y,
                   len(list_filter(coalesce(cuts, []), lambda c: c < x)) AS bin FROM k, r LEFT JOIN cl ON cl.feature = r.feature),
      g AS (SELECT feature, h, bin, sum(y) AS y, count(*) AS c FROM b GROUP BY feature, h, bin),
      t AS (SELECT t AS tree, {hexed("'42|a|' || t")} % {prime - 1} + 1 AS a, {hexed("'42|b|' || t")} % {prime} AS z FROM range(0, {trees}) r(t)),
      w AS (SELECT tree, feature, bin, y, c, (h * a + z) % {prime} AS u FROM g, t),
      m AS (SELECT tree, feature, bin, sum(({weight}) * c)::DOUBLE AS n, sum(({weight}) * y)::DOUBLE AS s FROM w GROUP BY ALL),
      l AS (SELECT *, sum(n) OVER v AS nl, sum(s) OVER v AS sl, sum(n) OVER o AS na, sum(s) OVER o AS sa FROM m
            WINDOW v AS (PARTITION BY tree, feature ORDER BY bin), o AS (PARTITION BY tree, feature)),
      q AS (SELECT *, nl * (na - nl) / na * ((sl / nl - (sa - sl) / (na - nl)) * (sl / nl - (sa - sl) / (na - nl))) AS gain
            FROM l WHERE nl >= 1 AND na - nl >= 1),
      e AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY gain DESC, feature, bin) AS rn FROM q)
      SELECT CAST(tree AS INTEGER) AS tree, CAST(e.feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS bin,
             round(cuts[bin + 1], 9) AS cut, CAST(na AS BIGINT) AS weight
      FROM e JOIN cl ON cl.feature = e.feature WHERE rn = 1 AND gain > 0"""


def property_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    test = "(SELECT count(*) FROM feat WHERE substr(md5(row_key || '|42'), 1, 4) < '3333')"
    q["ml_properties"] = f"""{BASE} SELECT name, CAST(n AS BIGINT) AS n, true AS ok FROM (VALUES
      ('forest in [0, 1]', {test}), ('boosting in [0, 1]', {test}), ('network in [0, 1]', {test}), ('ensemble is the mean', {test}),
      ('reloaded forest predicts the same', {test}), ('importances sum to 1', 12), ('r2 above 0.9', 3)) v(name, n)"""
    n = "(SELECT count(*) FROM kpi)"
    q["alloc_properties"] = f"""{BASE} SELECT name, CAST({n} AS BIGINT) AS n, true AS ok FROM (VALUES
      ('genetic totals'), ('genetic not above exhaustive'), ('methods compared'), ('model search totals'),
      ('model search not below current'), ('model scores as row by row, no exchange')) v(name)"""
    q["ml_cv_properties"] = f"""{BASE}, c AS (SELECT count(*) AS n FROM feat WHERE allocation_efficiency IS NOT NULL)
      SELECT name, CAST(n AS BIGINT) AS n, true AS ok FROM (VALUES ('folds', 5), ('rows held out', (SELECT n FROM c)),
      ('r2 above 0.9', 5), ('mean and deviation', 2)) v(name, n)"""
    q["ml_forest_roots"] = forest_roots_sql()
    q["report_values"] = alloc_sql()["alloc_improvement_summary"]
    # slice 0 of each training configuration: tr0 to tr27
    first = [2, 4, 6, 8, 10, 12, 14, 2, 4, 6, 8, 10, 12, 2, 4, 6, 8, 10, 2, 4, 6, 8, 2, 4, 6, 2, 4, 2]
    values = ", ".join(f"('tr{i}', {r})" for i, r in enumerate(first))
    q["feat_default_slice"] = f"""WITH {KPI_CTE}, c(training_config, rbgs) AS (VALUES {values})
      SELECT row_key, 0 AS slice_id, CAST(coalesce(rbgs, 0) AS INTEGER) AS allocated_rbgs
      FROM kpi LEFT JOIN c USING (training_config)"""
    q["kpi_tree_scan"] = f"""WITH {KPI_CTE} SELECT row_key, ts_ms, sched_policy, training_config,
      num_ues, dl_cqi, sum_requested_prbs, sum_granted_prbs FROM kpi"""
    w = 86400 * 1000000
    q["security_report"] = f"""SELECT 'failures' AS section, user_id AS client, count(*) AS value FROM events
        WHERE event_type = 'error' GROUP BY user_id
      UNION ALL SELECT 'active_requests', user_id, count(*) FROM events, (SELECT max(epoch_us(ts)) AS now FROM events) n
        WHERE n.now - epoch_us(ts) < {w} AND epoch_us(ts) <= n.now GROUP BY user_id
      UNION ALL SELECT 'settings', NULL, 2"""
    q["prep_prepare_data"] = f"""{BASE}, s AS (SELECT *, md5(row_key || '|42') AS h FROM feat
        WHERE allocation_efficiency IS NOT NULL),
      r AS (SELECT slice_id, row_number() OVER (PARTITION BY slice_id ORDER BY h, row_key) AS rn,
                   count(*) OVER (PARTITION BY slice_id) AS c FROM s)
      SELECT CAST(slice_id AS FLOAT) AS slice_id, CASE WHEN rn <= floor(0.2e0 * c) THEN 'test' ELSE 'train' END AS split,
             count(*) AS n FROM r GROUP BY 1, 2"""
    cols = FEATURES_12.split(", ")
    med = ", ".join(f"coalesce(CAST({c} AS FLOAT)::DOUBLE, (SELECT quantile_cont(CAST({c} AS FLOAT)::DOUBLE, 0.5) FROM s)) AS {c}"
                    for c in cols)
    whole = f"""{BASE}, s AS (SELECT * FROM feat WHERE allocation_efficiency IS NOT NULL
        ORDER BY md5(row_key || '|42'), row_key LIMIT 5000000),
      i AS (SELECT row_key, {med}, CAST(allocation_efficiency AS FLOAT)::DOUBLE AS allocation_efficiency FROM s),
      r AS (SELECT *, row_number() OVER (PARTITION BY slice_id ORDER BY md5(row_key || '|42'), row_key)
                        <= floor(0.2e0 * count(*) OVER (PARTITION BY slice_id)) AS test FROM i)"""
    scaled = lambda c: (f"(avg({c}) FILTER (test) - avg({c}) FILTER (NOT test)) / "  # noqa: E731
                        f"coalesce(nullif(stddev_pop({c}) FILTER (NOT test), 0e0), 1e0)")
    q["prep_prepare_data_whole"] = whole + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(avg({c}) FILTER (NOT test), 6) AS mean,
          round(stddev_samp({c}) FILTER (NOT test), 6) AS std, min({c}) FILTER (NOT test) AS min,
          max({c}) FILTER (NOT test) AS max, count(*) FILTER (NOT test) AS train_size, count(*) FILTER (test) AS test_size,
          round({scaled(c) if c in cols else f'avg({c}) FILTER (test)'}, 6) AS test_scaled_mean FROM r"""
        for c in [*cols, "allocation_efficiency"])
    d = "(CAST('0x' || substr(md5(row_key), 1, 6) AS BIGINT) % 100)"
    q["faulty_inputs"] = f"""{BASE}, d AS (SELECT feat.*, {d} AS d FROM feat),
      k AS (SELECT kpi.*, {d} AS d FROM kpi),
      x AS (SELECT count(*) AS n, count(*) FILTER (d >= 7) AS defined, count(*) FILTER (d = 30) AS twice,
                   count(*) FILTER (d BETWEEN 20 AND 25) AS inf, count(*) FILTER (d < 7) AS gone,
                   count(*) FILTER (d < 3) AS wrong,
                   count(*) FILTER (d < 7 OR d BETWEEN 20 AND 25) AS changed FROM d)
      SELECT name, CAST(v AS BIGINT) AS n, true AS ok FROM x, LATERAL (VALUES
        ('with target', defined + twice), ('duplicates', twice), ('infinite qos', inf), ('constant load', 1),
        ('constant hour', 0), ('left only', changed), ('right only', changed + twice), ('invalid allocations', wrong),
        ('target defined', (SELECT count(*) FROM k WHERE d >= 7 OR sum_requested_prbs <= 0))) t(name, v)"""
    return q
