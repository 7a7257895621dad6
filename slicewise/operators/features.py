"""Feature engineering on KPI rows: every step is a row-local projection.

The whole chain (``kpi_features``) is one scan, one broadcast hash join against the 84-row slice
table, and one whole-stage-codegen projection: no shuffle.  The same code runs on a batch
DataFrame and on a streaming one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import clip, dlit, nan_to_null


def slice_config_table(spark: SparkSession, configs: dict | None = None) -> DataFrame:
    """``(training_config, slice_id, rbgs)``: one row per configuration and slice (84 rows)."""
    configs = configs or P.SLICE_CONFIGS
    rows = [F.struct(F.lit(cfg).alias("training_config"), F.lit(i).alias("slice_id"),
                     F.lit(int(r)).alias("rbgs"))
            for cfg, rbgs in configs.items() for i, r in enumerate(rbgs)]
    # a JVM-side local table (no Python round trip)
    return spark.range(1).select(F.inline(F.array(*rows)))


def add_temporal(df: DataFrame, ts_col: str = "ts_ms") -> DataFrame:
    """``hour``, ``minute``, ``day_of_week`` (Monday = 0) from epoch milliseconds (UTC)."""
    ts = F.timestamp_millis(F.col(ts_col).cast("long"))
    return df.withColumns({
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day_of_week": F.weekday(ts),
    })


def add_sched_code(df: DataFrame) -> DataFrame:
    """``sched0/1/2`` -> 0/1/2, any other policy -> null."""
    c = F.col("sched_policy")
    expr = F.lit(None).cast("int")
    for name, code in reversed(list(P.SCHED_POLICY_CODES.items())):
        expr = F.when(c == name, F.lit(code)).otherwise(expr)
    return df.withColumn("sched_policy_num", expr.cast("int"))


def ensure_slice_id(df: DataFrame) -> DataFrame:
    """a frame without ``slice_id`` gets slice 0."""
    if "slice_id" in df.columns:
        return df
    return df.withColumn("slice_id", F.lit(0).cast("int"))


def add_allocated_rbgs(df: DataFrame, configs: dict | None = None) -> DataFrame:
    """``(training_config, slice_id)`` -> resource-block groups; a miss gives 0.

    The lookup table is a fixed 84-row dimension, so it is broadcast: the KPI side is never
    shuffled.  (A plain ``when`` chain would also work but grows with the table.)
    """
    spark = df.sparkSession
    dim = F.broadcast(slice_config_table(spark, configs).withColumnRenamed("rbgs", "_rbgs"))
    out = df.join(dim, on=["training_config", "slice_id"], how="left")
    return out.withColumn("allocated_rbgs", F.coalesce(F.col("_rbgs"), F.lit(0)).cast("int")).drop("_rbgs")


def add_prb_utilization(df: DataFrame) -> DataFrame:
    """granted / requested when requested > 0, else 0; clipped to [0, 1], null stays null."""
    req, gr = F.col("sum_requested_prbs").cast("double"), F.col("sum_granted_prbs").cast("double")
    raw = F.when(req > 0, gr / req).otherwise(dlit(0.0))
    return df.withColumn("prb_utilization", clip(raw, 0.0, 1.0))


def add_throughput_efficiency(df: DataFrame) -> DataFrame:
    """throughput per granted PRB (missing throughput = 0); not clipped."""
    gr = F.col("sum_granted_prbs").cast("double")
    br = F.coalesce(F.col("tx_brate_dl_mbps").cast("double"), dlit(0.0))
    return df.withColumn("throughput_efficiency", F.when(gr > 0, br / gr).otherwise(dlit(0.0)))


def _col_or_default(df: DataFrame, name: str, default: float):
    """An absent optional column counts as its documented default (not as all-null)."""
    if name in df.columns:
        return F.coalesce(F.col(name).cast("double"), dlit(default))
    return dlit(default)


def impute_constants(df: DataFrame) -> DataFrame:
    """constant imputation of the quality and load inputs (absent column = default)."""
    return df.withColumns({
        "tx_errors_dl_pct": _col_or_default(df, "tx_errors_dl_pct", P.DEFAULT_DL_ERRORS_PCT),
        "rx_errors_ul_pct": _col_or_default(df, "rx_errors_ul_pct", P.DEFAULT_UL_ERRORS_PCT),
        "dl_cqi": _col_or_default(df, "dl_cqi", P.DEFAULT_DL_CQI),
        "num_ues": _col_or_default(df, "num_ues", P.DEFAULT_NUM_UES),
    })


def add_qos_score(df: DataFrame) -> DataFrame:
    """F8: ``0.4*(100-dl)/100 + 0.3*(100-ul)/100 + 0.3*cqi/15`` clipped to [0, 1]."""
    dl = _col_or_default(df, "tx_errors_dl_pct", P.DEFAULT_DL_ERRORS_PCT)
    ul = _col_or_default(df, "rx_errors_ul_pct", P.DEFAULT_UL_ERRORS_PCT)
    cqi = _col_or_default(df, "dl_cqi", P.DEFAULT_DL_CQI)
    dl_s = (dlit(100.0) - dl) / dlit(100.0)
    ul_s = (dlit(100.0) - ul) / dlit(100.0)
    cqi_s = cqi / dlit(P.MAX_CQI)
    raw = (dlit(0.4) * dl_s + dlit(0.3) * ul_s) + dlit(0.3) * cqi_s
    return df.withColumn("qos_score", clip(raw, 0.0, 1.0))


def add_network_load(df: DataFrame) -> DataFrame:
    """``num_ues / 42`` (missing = 5 UEs)."""
    return df.withColumn("network_load",
                         _col_or_default(df, "num_ues", P.DEFAULT_NUM_UES) / dlit(P.MAX_UES))


def add_allocation_efficiency(df: DataFrame) -> DataFrame:
    """target ``0.5*throughput + 0.3*qos + 0.2*prb`` clipped to [0, 1]."""
    raw = ((dlit(0.5) * F.col("throughput_efficiency") + dlit(0.3) * F.col("qos_score"))
           + dlit(0.2) * F.col("prb_utilization"))
    return df.withColumn(P.TARGET_COLUMN, clip(raw, 0.0, 1.0))


def select_features(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """the twelve features and the target; rows with a null target are dropped."""
    cols = list(keep or []) + P.FEATURE_COLUMNS + [P.TARGET_COLUMN]
    return df.select(*cols).dropna(subset=[P.TARGET_COLUMN])


def target_defined(df: DataFrame) -> F.Column:
    """Exactly when the chain's target is non-null, written on the raw columns.

    ``qos_score``, ``network_load`` and ``throughput_efficiency`` are never null (their inputs
    are imputed or guarded), so the target is null only where ``prb_utilization`` is: requested
    PRBs > 0 with granted PRBs missing.  Filtering on this instead of ``dropna(target)`` keeps
    the optimizer from pushing the whole target expression below the projection and evaluating
    it twice per row.
    """
    req, gr = F.col("sum_requested_prbs").cast("double"), F.col("sum_granted_prbs").cast("double")
    return ~F.coalesce((req > 0) & gr.isNull(), F.lit(False))


def kpi_features(raw: DataFrame, keep: list[str] | None = None, configs: dict | None = None) -> DataFrame:
    """the whole feature chain F1-F11 on raw KPI rows (batch or stream); NaN counts as
    missing, whatever the source."""
    cols = list(keep or []) + P.FEATURE_COLUMNS + [P.TARGET_COLUMN]
    floating = [f.name for f in raw.schema.fields if f.dataType.typeName() in ("double", "float")]
    raw = raw.withColumns({c: nan_to_null(F.col(c)) for c in floating})
    return (raw.where(target_defined(raw))
               .transform(add_temporal)
               .transform(add_sched_code)
               .transform(ensure_slice_id)
               .transform(lambda d: add_allocated_rbgs(d, configs))
               .transform(add_prb_utilization)
               .transform(add_throughput_efficiency)
               .transform(add_qos_score)
               .transform(add_network_load)
               .transform(add_allocation_efficiency)
               .select(*cols))


def efficiency_by_policy_slice(features: DataFrame) -> DataFrame:
    """Mean target per scheduling-policy code and slice (flagship report)."""
    return (features.groupBy("sched_policy_num", "slice_id")
                    .agg(F.count(F.lit(1)).alias("n_rows"),
                         F.round(F.avg(P.TARGET_COLUMN), 6).alias("avg_efficiency"),
                         F.round(F.avg("throughput_efficiency"), 6).alias("avg_throughput_eff"),
                         F.round(F.avg("prb_utilization"), 6).alias("avg_prb_utilization")))


def compact_types(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """narrow integer columns to the smallest type that fits, doubles to float.

    One aggregation pass (min/max of every integral column) decides the types; returns the
    recast frame and a report ``(column, old_type, new_type)``.
    """
    from pyspark.sql import types as T
    int_types = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, int_types)]
    report_rows = []
    if ints:
        aggs = []
        for c in ints:
            aggs += [F.min(c).alias(f"mn_{c}"), F.max(c).alias(f"mx_{c}")]
        stats = df.agg(*aggs).first().asDict()
    for f in df.schema.fields:
        old = f.dataType.simpleString()
        if f.name in ints:
            mn, mx = stats[f"mn_{f.name}"], stats[f"mx_{f.name}"]
            new = _smallest_int_type(mn, mx)
        elif isinstance(f.dataType, T.DoubleType):
            new = "float"
        else:
            new = old
        report_rows.append((f.name, old, new))
    out = df.select(*[F.col(c).cast(t).alias(c) if t != o else F.col(c)
                      for (c, o, t) in report_rows])
    report = df.sparkSession.createDataFrame(report_rows, "column string, old_type string, new_type string")
    return out, report


def _smallest_int_type(mn, mx) -> str:
    if mn is None:
        return "tinyint"
    for name, lo, hi in (("tinyint", -2**7, 2**7 - 1), ("smallint", -2**15, 2**15 - 1),
                         ("int", -2**31, 2**31 - 1)):
        if lo <= mn and mx <= hi:
            return name
    return "bigint"


def compact_types_report(df: DataFrame) -> DataFrame:
    """F13 as a distributed report: one aggregation, no driver round trip.

    Produces ``(column, old_type, new_type)`` where the integer decision is made by Spark
    from the column's min/max; used when the recast frame itself is not needed.
    """
    from pyspark.sql import types as T
    int_types = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    parts = []
    for f in df.schema.fields:
        old = f.dataType.simpleString()
        if isinstance(f.dataType, int_types):
            mn, mx = F.min(f.name), F.max(f.name)
            new = (F.when(mn.isNull(), "tinyint")
                    .when((mn >= -2**7) & (mx <= 2**7 - 1), "tinyint")
                    .when((mn >= -2**15) & (mx <= 2**15 - 1), "smallint")
                    .when((mn >= -2**31) & (mx <= 2**31 - 1), "int")
                    .otherwise("bigint"))
        elif isinstance(f.dataType, T.DoubleType):
            new = F.lit("float")
        else:
            new = F.lit(old)
        parts.append(F.struct(F.lit(f.name).alias("column"), F.lit(old).alias("old_type"),
                              new.alias("new_type")))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))
