"""Incremental data quality profile (Q1-Q5): one row of mergeable sketches per day and column.

A day's rows are read once, when the day is added.  A report reads the sketches only: counts and
moments merge exactly, quantiles come from KLL sketches, distinct values from HLL sketches.  Adding
a day again replaces its rows, so a rerun after a failure counts nothing twice.

The row of column ``*`` stands for whole rows: its distinct count gives the duplicates of Q4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import dlit, round6
from .quality import missing, numeric_columns

KLL_K = 2000        # items kept per level of a quantile sketch
RANK_ERROR = 0.005  # of a quantile of merged sketches: twice the 99 % bound 2.296 / KLL_K ** 0.9021
GRID = 1000         # ranks asked of a sketch for the share of outliers
HLL_BITS = 14       # registers of a distinct sketch as a power of two
DISTINCT_ERROR = 0.03  # relative: more than three standard errors 1.04 / sqrt(2 ** HLL_BITS)
ROW = "*"

SKETCH_SCHEMA = ("column string, rows long, n long, mean double, m2 double, min double, max double, "
                 "quantiles binary, distinct binary, day long")


def _row_hash(df: DataFrame) -> Column:
    """A hash of all columns in which a null is told from an absent value."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])
    return F.xxhash64(nulls, *[F.col(c) for c in df.columns])


def sketch_days(df: DataFrame, day: Column, cols: list[str] | None = None) -> DataFrame:
    """``column, rows, n, mean, m2, min, max, quantiles, distinct, day``: one row per day and column
    of ``cols`` (default: all numeric ones) and one per day for whole rows.

    ``day`` is a whole number of any period; rows without one belong to day -1.  ``n`` counts values that are neither null
    nor NaN.  One aggregation with partial sketches per task, so a day may hold any share of the rows.
    """
    cols = cols or numeric_columns(df)
    d = df.select("*", F.coalesce(day.cast("long"), F.lit(-1)).alias("_day"))
    aggs = [F.count(F.lit(1)).alias("_rows"), F.hll_sketch_agg(_row_hash(df), HLL_BITS).alias("_distinct")]
    for i, c in enumerate(cols):
        x = F.when(~missing(df, c), F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.var_pop(x).alias(f"var{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 F.kll_sketch_agg_double(x, KLL_K).alias(f"q{i}"),
                 F.hll_sketch_agg(F.xxhash64(x), HLL_BITS).alias(f"d{i}")]
    null, none = F.lit(None).cast("double"), F.lit(None).cast("binary")
    names = [f.split(" ")[0] for f in SKETCH_SCHEMA.split(", ")]

    def entry(*values):
        return F.struct(*[v.alias(n) for v, n in zip((*values, F.col("_day")), names)])
    parts = [entry(F.lit(c), F.col("_rows"), F.col(f"n{i}"), F.col(f"mean{i}"), F.col(f"var{i}") * F.col(f"n{i}"),
                   F.col(f"min{i}"), F.col(f"max{i}"), F.when(F.col(f"n{i}") > 0, F.col(f"q{i}")),
                   F.when(F.col(f"n{i}") > 0, F.col(f"d{i}"))) for i, c in enumerate(cols)]
    parts.append(entry(F.lit(ROW), F.col("_rows"), F.col("_rows"), null, null, null, null, none, F.col("_distinct")))
    return d.groupBy("_day").agg(*aggs).select(F.inline(F.array(*parts)))


def add_days(df: DataFrame, path: str, day: Column, only: list[int] | None = None,
             cols: list[str] | None = None) -> None:
    """Sketch the days of ``df`` (those of ``only``, a filter that reaches the scan) and put them in the profile
    at ``path`` in place of what it holds for them; other days stay untouched."""
    if only is not None:
        df = df.where(day.isin(only))
    (sketch_days(df, day, cols).write.partitionBy("day").mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCH_SCHEMA).parquet(path)


def profile_report(sketches: DataFrame, threshold: float = P.IQR_THRESHOLD) -> DataFrame:
    """Q1-Q3 out of sketches: ``column, rows, n, missing_pct, min, max, mean, std, distinct, q1, q3, lower,
    upper, outlier_pct`` per column.

    Rows, ``n``, ``missing_pct``, ``min``, ``max`` are exact, mean and sample deviation are rounded to 6 decimals.
    ``q1`` and ``q3`` are values of the column whose rank is within ``RANK_ERROR`` of a quarter and three quarters;
    the outlier share is read from the sketch with that error and one of 1 / ``GRID``, per end.  Columns without any value
    have null statistics, an empty profile gives no rows.
    """
    s = sketches.where(F.col("column") != ROW)
    total = s.groupBy(F.col("column").alias("_c")).agg((F.sum(F.col("n") * F.col("mean")) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias("_mean"))
    # one row per column of the profiled table
    s = s.join(F.broadcast(total), F.col("column") == F.col("_c"))
    off = F.col("mean") - F.col("_mean")
    g = s.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.first("_mean").alias("mean"), F.sum(F.col("m2") + F.col("n") * off * off).alias("m2"),
        F.kll_merge_agg_double("quantiles").alias("k"), F.hll_union_agg("distinct").alias("d"))
    some = F.col("n") > 0
    q = g.withColumns({"q1": F.when(some, F.kll_sketch_get_quantile_double("k", F.lit(0.25))),
                       "q3": F.when(some, F.kll_sketch_get_quantile_double("k", F.lit(0.75))),
                       "grid": F.when(some, F.kll_sketch_get_quantile_double(
                           "k", F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])))})
    iqr = F.col("q3") - F.col("q1")
    q = q.withColumns({"lower": F.col("q1") - dlit(threshold) * iqr, "upper": F.col("q3") + dlit(threshold) * iqr})
    # the share of quantiles at even ranks that lie beyond a bound (a sketch's rank of a computed value cannot be asked)
    out = F.size(F.filter("grid", lambda v: (v < F.col("lower")) | (v > F.col("upper")))) / dlit(GRID)
    rows = F.col("rows").cast("double")
    return q.select(
        "column", "rows", "n", ((F.col("rows") - F.col("n")).cast("double") / rows * dlit(100.0)).alias("missing_pct"),
        "min", "max", round6(F.col("mean")).alias("mean"),
        round6(F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))).alias("std"),
        F.when(some, F.hll_sketch_estimate("d")).otherwise(F.lit(0)).alias("distinct"), "q1", "q3", "lower", "upper",
        F.when(some, out * F.col("n") / rows * dlit(100.0)).otherwise(dlit(0.0)).alias("outlier_pct"))


def profile_score(sketches: DataFrame, threshold: float = P.QUALITY_THRESHOLD) -> DataFrame:
    """Q4-Q6 out of sketches: ``total_records, avg_missing_pct, avg_outlier_pct, duplicate_pct, quality_score,
    passed`` over the numeric columns.

    The duplicate share comes from the distinct sketch of whole rows and is off by at most ``DISTINCT_ERROR``
    of all rows (with the certainty of three standard errors); ``quality_score`` of ``quality`` is the exact form.
    """
    c = profile_report(sketches).agg(F.avg("missing_pct").alias("m"), F.avg("outlier_pct").alias("o")).first()
    one = sketches.where(F.col("column") == ROW).agg(F.sum("rows").alias("total_records"),
                                                     F.hll_union_agg("distinct").alias("d"))
    rows = F.col("total_records").cast("double")
    dup = F.greatest(dlit(0.0), (rows - F.hll_sketch_estimate("d")) / rows * dlit(100.0))
    one = one.select("total_records", F.lit(c["m"]).cast("double").alias("avg_missing_pct"),
                     F.lit(c["o"]).cast("double").alias("avg_outlier_pct"), dup.alias("duplicate_pct"))
    score = F.greatest(dlit(0.0), dlit(100.0) - F.col("avg_missing_pct") - F.col("avg_outlier_pct") - F.col("duplicate_pct"))
    return one.select("*", round6(score).alias("quality_score"), (score >= dlit(threshold)).alias("passed"))
