"""Training-set preparation (P1-P9) and k-fold assignment.

Randomness is a seeded md5 of the row key, never ``rand()``/``randomSplit``: the result does not
depend on partitioning or retries, and both Spark and SQL engines reproduce it.  Fixed-size
samples and stratified splits find their cut by counts per hash prefix and rank only the rows of
that prefix; contiguous folds use a range-partitioned global index.  No window sees every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import dlit, seeded_hash_hex
from ..functions.order_stats import exact_quantiles
from ..session import checkpoint_dir, written


def check_columns(df: DataFrame, features: list[str], target: str) -> None:
    """Missing feature or target columns are an error naming them (no job runs)."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError("these feature columns are not in the table: " + ", ".join(missing))
    if target not in df.columns:
        raise ValueError(f"the table has no column {target} to learn")


def validate_for_training(df: DataFrame, features: list[str] = P.FEATURE_COLUMNS,
                          target: str = P.TARGET_COLUMN) -> dict:
    """Q9-Q11 as preconditions: missing columns and a constant target are errors; infinite or
    constant features are returned as warnings.  One aggregation pass."""
    check_columns(df, features, target)
    inf = float("inf")
    aggs = [F.var_samp(F.col(target).cast("double")).alias("_tv")]
    for c in features:
        x = F.col(c).cast("double")
        aggs += [F.count(F.when(F.abs(x) == F.lit(inf), 1)).alias(f"_i_{c}"), F.var_samp(x).alias(f"_v_{c}")]
    r = df.agg(*aggs).first()
    if r["_tv"] is None or r["_tv"] == 0:
        raise ValueError(f"{target} is constant (or has too few values): nothing to learn")
    return {"infinite": [c for c in features if r[f"_i_{c}"] > 0],
            "constant": [c for c in features if r[f"_v_{c}"] == 0]}


def drop_null_target(df: DataFrame, target: str = P.TARGET_COLUMN) -> DataFrame:
    """Remove rows whose target is null."""
    return df.dropna(subset=[target])


PREFIX_DIGITS = 4  # hex digits of the hash a cut is looked for in (65,536 values)


def _with_rank_test(df: DataFrame, stratum: str | None, key: str, seed: int, wanted) -> DataFrame:
    """Add ``_hit``: the row is among the ``wanted(n)`` smallest of its stratum (of ``n`` rows) in
    the order of the seeded key hash, then the key; equal keys fill up to the exact number.

    Counts per (stratum, hash prefix) and their running sum find the prefix in which each
    stratum's cut lies; rows with smaller prefixes are in, larger ones out, and only the rows of
    that one prefix are ranked.  Any number of strata of any size, nothing on the driver.
    """
    prefix = F.substring(seeded_hash_hex(F.col(key), seed), 1, PREFIX_DIGITS)
    of = F.col(stratum) if stratum else F.lit(0)
    d = df.withColumns({"_p": F.coalesce(prefix, F.lit("")), "_s": of})
    per = d.groupBy("_s", "_p").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    per = (per.withColumn("_upto", F.sum("_n").over(run))
           .withColumn("_k", wanted(F.sum("_n").over(Window.partitionBy("_s"))).cast("long")))
    cut = (per.where((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_n") < F.col("_k")))
           .select(F.col("_s").alias("_cs"), F.col("_p").alias("_cp"),
                   (F.col("_k") - F.col("_upto") + F.col("_n")).alias("_need")))
    # a stratum without a cut wants no row, or more than it has (then its last prefix is the cut)
    last = (per.groupBy("_s").agg(F.max("_p").alias("_lp"), F.max("_k").alias("_k"), F.sum("_n").alias("_all"))
            .where(F.col("_k") > F.col("_all"))
            .select(F.col("_s").alias("_cs"), F.col("_lp").alias("_cp"), F.col("_all").alias("_need")))
    cut = cut.unionByName(last)
    # a stratum's cut goes to each of its prefixes, so that a large stratum is joined in many parts
    every = per.select(F.col("_s").alias("_ps"), F.col("_p").alias("_pp"))
    every = every.join(cut, F.col("_ps").eqNullSafe(F.col("_cs")), "left").drop("_cs")
    j = d.join(every, F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("_p") == F.col("_pp")), "left").drop("_ps", "_pp")
    at = F.coalesce(F.col("_p") == F.col("_cp"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_s").orderBy(seeded_hash_hex(F.col(key), seed), F.col(key)))
    inside = j.where(at).withColumn("_hit", rank <= F.col("_need"))
    outside = j.where(~at).withColumn("_hit", F.coalesce(F.col("_p") < F.col("_cp"), F.lit(False)))
    return inside.unionByName(outside).drop("_p", "_s", "_cp", "_need")


def sample_n(df: DataFrame, n: int, key: str = "row_key", seed: int = P.RANDOM_SEED) -> DataFrame:
    """Exactly ``n`` rows without replacement, those with the smallest seeded hashes of the
    key (all rows if there are fewer); keys may repeat."""
    return _with_rank_test(df, None, key, seed, lambda _: F.lit(int(max(n, 0)))).where("_hit").drop("_hit")


def split_label(key: str = "row_key", seed: int = P.RANDOM_SEED, test_fraction: float = 0.2) -> Column:
    """``'test'`` for a seeded-hash share of ``test_fraction`` (16-bit resolution), else train."""
    place = F.conv(F.substring(seeded_hash_hex(F.col(key), seed), 1, 4), 16, 10).cast("int")
    return F.when(place < int(round(test_fraction * 65536)), "test").otherwise("train")


def random_split(df: DataFrame, key: str = "row_key", seed: int = P.RANDOM_SEED,
                 test_fraction: float = P.VALIDATION_SPLIT) -> DataFrame:
    """Add ``split`` in {train, test}; map-only, repartition-proof."""
    return df.withColumn("split", split_label(key, seed, test_fraction))


def stratified_split(df: DataFrame, stratum: str, key: str = "row_key", seed: int = P.RANDOM_SEED,
                     test_fraction: float = P.VALIDATION_SPLIT) -> DataFrame:
    """Per stratum (null is one), the ``floor(f * n_s)`` rows with the smallest seeded hash of
    the key are ``test``; keys may repeat and strata may be as many as rows."""
    d = _with_rank_test(df, stratum, key, seed, lambda n: F.floor(F.lit(test_fraction) * n))
    return d.withColumn("split", F.when(F.col("_hit"), "test").otherwise("train")).drop("_hit")


def impute_median(df: DataFrame, cols: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the exact (interpolated) median of each column.

    ``fit`` is the frame the medians come from (default: ``df`` itself, as the reference does
    before splitting; pass the training rows to avoid the leak).
    """
    med = exact_quantiles(fit if fit is not None else df, cols, [0.5])
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), dlit(med[c][0]))
                           for c in cols if med[c][0] is not None})


def impute_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: the real pipeline's ``fillna(0)``."""
    return df.fillna(0, subset=cols)


def cast_float(df: DataFrame, cols: list[str]) -> DataFrame:
    """Features and target as float32."""
    return df.withColumns({c: F.col(c).cast("float") for c in cols})


def standardize(df: DataFrame, cols: list[str], split_col: str = "split", fit_value: str = "train",
                digits: int | None = None) -> DataFrame:
    """``(x - mean) / std`` with statistics of the training rows; population std, 0 -> 1."""
    fit = df.where(F.col(split_col) == fit_value) if split_col else df
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    st = fit.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        if m is None:
            continue
        s = 1.0 if (s is None or s == 0) else s
        z = (F.col(c).cast("double") - dlit(m)) / dlit(s)
        out[c] = F.round(z, digits) if digits is not None else z
    return df.withColumns(out)


def train_stats(df: DataFrame, features: list[str], target: str = P.TARGET_COLUMN,
                split_col: str = "split") -> DataFrame:
    """Per column of the training rows ``mean, std (sample), min, max`` plus split sizes."""
    cols = features + [target]
    tr = F.col(split_col) == "train"
    aggs = [F.count(F.when(tr, 1)).alias("train_size"), F.count(F.when(~tr, 1)).alias("test_size")]
    for c in cols:
        x = F.when(tr, F.col(c).cast("double"))
        aggs += [F.round(F.avg(x), 6).alias(f"mean__{c}"), F.round(F.stddev_samp(x), 6).alias(f"std__{c}"),
                 F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    one = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"mean__{c}").alias("mean"),
                      F.col(f"std__{c}").alias("std"), F.col(f"min__{c}").alias("min"),
                      F.col(f"max__{c}").alias("max"), F.col("train_size"), F.col("test_size"))
             for c in cols]
    return one.select(F.inline(F.array(*parts)))


def global_index(df: DataFrame, order_col: str, partitions: int | None = None) -> DataFrame:
    """0-based position ``_rank`` of every row in ``order_col`` order, computed distributedly.

    Range-partition and sort within partitions, checkpoint (fixes the partitioning and cuts the
    lineage in the shared checkpoint folder), count rows per partition, and join each partition's
    offset (one row per partition).  ``order_col`` must be unique.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    srt = df.repartitionByRange(n, order_col).sortWithinPartitions(order_col).checkpoint(eager=True)
    pid = F.spark_partition_id()
    pos = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33)
    with_pos = srt.withColumn("_pid", pid).withColumn("_pos", pos)
    sizes = with_pos.groupBy("_pid").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_pid").alias("_opid"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    return (with_pos.join(F.broadcast(offsets), F.col("_pid") == F.col("_opid"))
            .withColumn("_rank", F.col("_off") + F.col("_pos")).drop("_pid", "_pos", "_opid", "_off"))


def kfold_assign(df: DataFrame, order_col: str, k: int = P.CV_FOLDS) -> DataFrame:
    """M7 folds: contiguous folds in ``order_col`` order with ``ntile(k)`` sizes (1-based)."""
    n = df.count()
    idx = global_index(df, order_col)
    q, rem = divmod(n, k)
    r = F.col("_rank")
    big = (q + 1) * rem
    fold = (F.when(r < big, F.floor(r / (q + 1)) + 1)
             .otherwise(rem + F.floor((r - big) / max(q, 1)) + 1))
    return idx.withColumn("fold", fold.cast("int")).drop("_rank")


def prepare_data(df: DataFrame, features: list[str] = P.FEATURE_COLUMNS, target: str = P.TARGET_COLUMN,
                 key: str = "row_key", sample_size: int = P.SAMPLE_SIZE, impute: str = "median",
                 stratum: str | None = None, test_fraction: float = P.VALIDATION_SPLIT,
                 seed: int = P.RANDOM_SEED, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """P1 to P9 as one chain: rows with a target, at most ``sample_size`` of them, float columns,
    imputation (``median`` or ``zero``), training checks, split (per ``stratum`` when given),
    standardisation with the training rows' statistics.  Returns the prepared rows with ``split``
    and the statistics of the training rows before scaling.
    """
    check_columns(df, features, target)
    keep = [key, *([stratum] if stratum and stratum not in features else []), *features, target]
    d = sample_n(drop_null_target(df, target).select(*keep), sample_size, key, seed)
    d = written(cast_float(d, [*features, target]), "prepared-sample")  # read by every step below
    d = impute_median(d, features) if impute == "median" else impute_zero(d, features)
    validate_for_training(d, features, target)
    d = (stratified_split(d, stratum, key, seed, test_fraction) if stratum
         else random_split(d, key, seed, test_fraction))
    d = written(d, "prepared-split")
    stats = train_stats(d, features, target)
    return (standardize(d, features) if scale else d), stats
