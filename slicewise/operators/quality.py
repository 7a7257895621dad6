"""Data quality: profiling, scoring and cleaning (Q1-Q12).

Statistics of all columns come from one aggregation pass each (the reference walks the frame
once per column per statistic).  Quantiles are exact (``exact_quantiles``) without a global
sort; the cleaning steps apply the bounds as literals, so they stay map-only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.columns import clip, dlit, round6
from ..functions.order_stats import exact_quantiles
from ..session import written

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def _long(df_one_row: DataFrame, cols: list[str], fields: list[str]) -> DataFrame:
    """Unpivot a one-row frame holding ``{field}__{col}`` columns into one row per column."""
    parts = [F.struct(F.lit(c).alias("column"),
                      *[F.col(f"{f}__{c}").alias(f) for f in fields]) for c in cols]
    return df_one_row.select(F.inline(F.array(*parts)))


def missing(df: DataFrame, c: str):
    """Null, or NaN in a floating column."""
    is_float = isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
    return F.col(c).isNull() | F.isnan(c) if is_float else F.col(c).isNull()


def missing_pct(df: DataFrame) -> DataFrame:
    """Q1: ``(column, missing_pct)`` = nulls / rows * 100 for every column (one pass)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(F.when(missing(df, c), 1)).alias(f"nulls__{c}") for c in cols]
    one = df.agg(*aggs)
    one = one.select(*[((F.col(f"nulls__{c}").cast("double") / F.col("rows").cast("double"))
                        * dlit(100.0)).alias(f"missing_pct__{c}") for c in cols])
    return _long(one, cols, ["missing_pct"])


def iqr_bounds(df: DataFrame, cols: list[str] | None = None, threshold: float = P.IQR_THRESHOLD,
               extra: list | None = None, extra_out: dict | None = None
               ) -> dict[str, tuple[float | None, float | None, float | None, float | None]]:
    """Exact Q1, Q3 (linear interpolation) and ``Q1 - t*IQR``, ``Q3 + t*IQR`` per column.

    ``extra`` aggregates are computed in a pass of their own (values in ``extra_out``).
    """
    cols = cols or numeric_columns(df)
    qs = exact_quantiles(df, cols, [0.25, 0.75], extra=extra, extra_out=extra_out)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            out[c] = (None, None, None, None)
            continue
        iqr = q3 - q1
        out[c] = (q1, q3, q1 - threshold * iqr, q3 + threshold * iqr)
    return out


def _outlier_aggs(cols: list[str], b: dict) -> list:
    aggs = []
    for c in cols:
        _, _, lo, hi = b[c]
        x = F.col(c).cast("double")
        cond = (x < dlit(lo)) | (x > dlit(hi)) if lo is not None else F.lit(False)
        aggs.append(F.count(F.when(cond, 1)).alias(f"n_outliers__{c}"))
    return aggs


def outliers_iqr(df: DataFrame, cols: list[str] | None = None,
                 threshold: float = P.IQR_THRESHOLD) -> DataFrame:
    """Q2: ``(column, q1, q3, lower, upper, n_outliers, outlier_pct)``; denominator = all rows.

    Counts use the exact bounds; the reported bounds are rounded to 9 decimals (SQL engines
    interpolate quantiles with different last-bit rounding).
    """
    cols = cols or numeric_columns(df)
    b = iqr_bounds(df, cols, threshold)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *_outlier_aggs(cols, b))

    def bound(c, i, name):
        v = b[c][i]
        return (F.round(dlit(v), 9) if v is not None else F.lit(None).cast("double")).alias(f"{name}__{c}")
    one = one.select(*[e for c in cols for e in (
        bound(c, 0, "q1"), bound(c, 1, "q3"), bound(c, 2, "lower"), bound(c, 3, "upper"),
        F.col(f"n_outliers__{c}"),
        ((F.col(f"n_outliers__{c}").cast("double") / F.col("rows").cast("double")) * dlit(100.0))
        .alias(f"outlier_pct__{c}"))])
    return _long(one, cols, ["q1", "q3", "lower", "upper", "n_outliers", "outlier_pct"])


def ranges(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q3: ``(column, min, max, mean, std)``; sample std; one pass over all columns."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"),
                 round6(F.avg(x)).alias(f"mean__{c}"), round6(F.stddev_samp(x)).alias(f"std__{c}")]
    return _long(df.agg(*aggs), cols, ["min", "max", "mean", "std"])


def row_key_columns(df: DataFrame, cols: list[str]) -> list:
    """Grouping columns that stand for whole rows: values as they are, strings and binaries by
    their SHA-256, so that wide text rows shuffle as 32 bytes a column; null stays null."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [(F.unhex(F.sha2(F.col(c).cast("binary"), 256)) if isinstance(kinds[c], (T.StringType, T.BinaryType))
             else F.col(c)).alias(f"_k{i}") for i, c in enumerate(cols)]


def duplicates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q4: ``(rows, duplicates, duplicate_pct)``: rows beyond the first of each identical row.

    Grouping is on the values themselves (texts by digest), with map-side partial counts, so a
    row repeated a billion times costs one partial count per task.
    """
    cols = cols or df.columns
    g = df.groupBy(*row_key_columns(df, cols)).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicates")).select(
        F.coalesce(F.col("rows"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.col("duplicates"), F.lit(0)).cast("long").alias("duplicates"),
        F.round((F.coalesce(F.col("duplicates"), F.lit(0)).cast("double")
                 / F.col("rows").cast("double")) * dlit(100.0), 6).alias("duplicate_pct"))


def quality_score(df: DataFrame, threshold: float = P.QUALITY_THRESHOLD) -> DataFrame:
    """Q5 + Q6: ``max(0, 100 - avg missing% - avg outlier% - duplicate%)`` and the gate.

    One pass counts rows and nulls, two find the quantiles, one counts outliers against the exact
    bounds, one the duplicates.  The result is one row built from these small aggregates.
    """
    num = numeric_columns(df)
    cols = df.columns
    got: dict = {}
    extra = [F.count(F.lit(1))] + [F.count(F.when(missing(df, c), 1)) for c in cols]
    b = iqr_bounds(df, num, extra=extra, extra_out=got)
    rows = got[0]
    am = sum((got[j + 1] / rows) * 100.0 for j in range(len(cols))) / len(cols) if rows else None
    oc = df.agg(*_outlier_aggs(num, b)).first() if num else None
    ao = (sum((oc[f"n_outliers__{c}"] / rows) * 100.0 for c in num) / len(num)
          if (num and rows) else None)
    dup = duplicates(df).first()
    one = df.sparkSession.createDataFrame(
        [(dup["rows"], dup["duplicates"], dup["duplicate_pct"], am, ao)],
        "rows long, duplicates long, duplicate_pct double, avg_missing_pct double, avg_outlier_pct double")
    score = F.greatest(dlit(0.0), ((dlit(100.0) - F.col("avg_missing_pct")) - F.col("avg_outlier_pct"))
                       - F.col("duplicate_pct"))
    return one.select(
        F.col("rows").alias("total_records"),
        round6(F.col("avg_missing_pct")).alias("avg_missing_pct"),
        round6(F.col("avg_outlier_pct")).alias("avg_outlier_pct"),
        F.col("duplicates"),
        round6(F.col("duplicate_pct")).alias("duplicate_pct"),
        round6(score).alias("quality_score"),
        (round6(score) >= dlit(threshold)).alias("passed"))


def clean_iqr(df: DataFrame, cols: list[str] | None = None,
              threshold: float = P.IQR_THRESHOLD) -> DataFrame:
    """Q7: cap each numeric column to its IQR bounds (from the input); row count unchanged."""
    cols = cols or numeric_columns(df)
    b = iqr_bounds(df, cols, threshold)
    repl = {}
    for c in cols:
        _, _, lo, hi = b[c]
        if lo is None:
            continue
        repl[c] = clip(F.col(c).cast("double"), lo, hi)
    return df.withColumns(repl)


def clean_zscore(df: DataFrame, cols: list[str] | None = None,
                 threshold: float = P.IQR_THRESHOLD, skip_constant: bool = False) -> DataFrame:
    """Q8: keep rows with ``|x - mean| / std < threshold`` in every numeric column.

    Statistics come from the input (sample std).  A null value, or a zero std, drops the row
    unless ``skip_constant`` leaves constant columns out of the test.
    """
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_samp(x).alias(f"s_{c}")]
    st = df.agg(*aggs).first()
    cond = F.lit(True)
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if s is None or m is None or s == 0:
            if skip_constant and s == 0:
                continue
            return df.where(F.lit(False))
        z = F.abs((F.col(c).cast("double") - dlit(m)) / dlit(s))
        cond = cond & F.coalesce(z < dlit(threshold), F.lit(False))
    return df.where(cond)


def infinite_check(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q9: ``(column, n_infinite, has_infinite)``."""
    cols = cols or numeric_columns(df)
    inf = float("inf")
    aggs = [F.count(F.when(F.abs(F.col(c).cast("double")) == dlit(inf), 1)).alias(f"n_infinite__{c}")
            for c in cols]
    one = df.agg(*aggs).select(*[e for c in cols for e in (
        F.col(f"n_infinite__{c}"), (F.col(f"n_infinite__{c}") > 0).alias(f"has_infinite__{c}"))])
    return _long(one, cols, ["n_infinite", "has_infinite"])


def constant_check(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Q10: ``(column, variance, is_constant)``; sample variance 0 means constant, also where merging
    the tasks' means leaves a last bit of it."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.var_samp(x).alias(f"v__{c}"), (F.min(x) == F.max(x)).alias(f"one__{c}")]
    one = df.agg(*aggs).select(*[e for c in cols for e in (
        round6(F.col(f"v__{c}")).alias(f"variance__{c}"),
        ((F.col(f"v__{c}") == 0) | (F.col(f"v__{c}").isNotNull() & ~F.isnan(f"v__{c}") & F.col(f"one__{c}")))
        .alias(f"is_constant__{c}"))])
    return _long(one, cols, ["variance", "is_constant"])


def training_checks(features: DataFrame, feature_cols: list[str] = P.FEATURE_COLUMNS,
                    target: str = P.TARGET_COLUMN) -> DataFrame:
    """Q10 (target) + Q11: max missing % over the features, target range and variance."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(F.when(F.col(c).isNull(), 1)).alias(f"n_{c}") for c in feature_cols]
    aggs += [F.min(target).alias("target_min"), F.max(target).alias("target_max"),
             F.var_samp(target).alias("target_var")]
    one = features.agg(*aggs)
    mx = F.greatest(*[(F.col(f"n_{c}").cast("double") / F.col("rows").cast("double")) * dlit(100.0)
                      for c in feature_cols])
    return one.select(F.col("rows"), round6(mx).alias("max_missing_pct"),
                      F.col("target_min"), F.col("target_max"),
                      (F.col("target_var") == 0).alias("target_is_constant"))


BUCKETS = 1024  # children of a node of the fingerprint tree; two levels


def _fingerprints(both: DataFrame, cols: list[str]) -> DataFrame:
    """``_side`` with two 64-bit hashes of the row, ``_f0`` and ``_f1``, and its bucket ``_b0`` and leaf ``_b1``.
    A null is told from an absent value, equal values of the grouping (0 and -0, any NaN) hash alike."""
    # nulls as flags of their own; no texts of them, whose types the planner would check in every copy of the hash
    f = both.select("*", *[F.xxhash64(F.lit(i), *[F.col(c).isNull() for c in cols], *[F.col(c) for c in cols]).alias(f"_f{i}") for i in range(2)])
    bucket = lambda x: F.coalesce(F.pmod(x, F.lit(BUCKETS)), F.lit(0))  # noqa: E731  never null, also for the planner
    return f.select("*", bucket(F.col("_f0")).alias("_b0"), bucket(F.shiftright("_f0", 10)).alias("_b1"))


def _unequal(f: DataFrame, *keys: str) -> DataFrame:
    """The buckets whose left and right rows have other counts or other sums of fingerprints.

    Sums are kept of 16-bit parts, so they cannot overflow below 2^47 rows of a bucket and task order is
    of no matter.
    """
    parts = [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(0xFFFF)) for h in ("_f0", "_f1") for by in (0, 16, 32, 48)]
    aggs = [F.sum("_side").alias("_n"), *[F.sum(F.col("_side") * x).alias(f"_s{i}") for i, x in enumerate(parts)]]
    same = F.col("_n") == 0
    for i in range(len(parts)):
        same = same & (F.col(f"_s{i}") == 0)
    return f.groupBy(*keys).agg(*aggs).where(~same).select(*keys)


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q12: run-to-run equality as multisets: rows only in the left or right frame.

    A tree of fingerprints: left and right rows are summed with signs into ``BUCKETS`` buckets of 128-bit row
    hashes, the unequal buckets again into ``BUCKETS`` leaves each, and only rows of unequal leaves are
    grouped by value, left ones counting +1 and right ones -1.  Equal runs shuffle ``BUCKETS`` small rows a task
    and no row of theirs.  The inputs are read once if equal, else three times.  Runs that differ pass as equal only
    if all sums of 128 bits meet by chance; columns are matched by name, texts compared by SHA-256.
    """
    cols = a.columns
    left, right = F.sum(F.greatest("_v", F.lit(0))), F.sum(F.greatest(-F.col("_v"), F.lit(0)))
    both = (a.select(*cols, F.lit(1).cast("long").alias("_side"))
            .unionByName(b.select(*cols, F.lit(-1).cast("long").alias("_side"))))
    keyed = both.select(*row_key_columns(both, cols), "_side")
    keys = [c for c in keyed.columns if c != "_side"]
    f = _fingerprints(keyed, keys)
    buckets = [r["_b0"] for r in _unequal(f, "_b0").collect()]  # at most BUCKETS
    rest = f.where(F.lit(False))
    if buckets:
        # A filter on a hash would be planned once per subset of the renamed columns it is made of.  So rows of equal
        # buckets are one leaf each instead, and the leaves, which runs that differ much have many of, are a table.
        marks = bytearray(BUCKETS)
        for b in buckets:
            marks[b] = 1
        marked = F.substr(F.lit(marks), (F.col("_b0") + 1).cast("int"), F.lit(1)) == F.lit(bytearray([1]))
        leaves = written(_unequal(f.withColumn("_b1", F.when(marked, F.col("_b1"))), "_b0", "_b1"), "unequal-leaves")
        rest = f.join(leaves, ["_b0", "_b1"], "left_semi")
    g = rest.groupBy(*keys).agg(F.sum("_side").alias("_v"))
    return g.agg(F.coalesce(left, F.lit(0)).alias("left_only"), F.coalesce(right, F.lit(0)).alias("right_only")).withColumn(
        "equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))
