"""A client holding a third of the log must still be exact and be spread over several tasks."""
import contextlib

from pyspark.sql import functions as F

from slicewise.operators import access_log as LG
from slicewise.plans import registry as R


@contextlib.contextmanager
def _no_coalescing(spark):
    """AQE would merge the tiny test shuffles into one partition; look at the plan's own split."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def _hot_log(spark, sf):
    log = R.access_log(spark, sf)
    return log.withColumn("client", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("client")))


def test_trailing_count_hot_client_spread_and_exact(spark, sf):
    log = _hot_log(spark, sf)
    w = 6 * 3600
    with _no_coalescing(spark):
        # materialise first: a filter on the client would otherwise be pushed below the exchange
        out = (LG.trailing_count(log, window_seconds=w, bucket_factor=1)
                 .withColumn("_pid", F.spark_partition_id()).cache())
        out.count()
    hot = out.where("client = 0")
    assert hot.select("_pid").distinct().count() > 1
    pdf = log.where("client = 0").select("event_id", "ts").toPandas()
    us = pdf.ts.astype("int64").to_numpy() // 1000
    want = {e: int(((us > t - w * 1_000_000) & (us <= t)).sum()) for e, t in zip(pdf.event_id, us)}
    got = {r.event_id: r.trailing_count for r in hot.select("event_id", "trailing_count").collect()}
    assert got == want


def test_rate_limit_hot_client_spread_and_exact(spark, sf):
    log = _hot_log(spark, sf)
    w = 6 * 3600
    short = LG.rate_limit(log, limit=2, window_seconds=w, bucket_factor=1)
    long = LG.rate_limit(log, limit=2, window_seconds=w, bucket_factor=10_000)  # one bucket each
    assert short.exceptAll(long).count() == 0 and long.exceptAll(short).count() == 0
    # the per-bucket pass handles the hot client in several partitions
    b_us = w * 1_000_000
    with _no_coalescing(spark):
        x = (log.select("client", F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"))
                .withColumn("_b", F.floor(F.col("_us") / b_us)).repartition("client", "_b")
                .withColumn("p", F.spark_partition_id()).cache())
        x.count()
    assert x.where("client = 0").select("p").distinct().count() > 1


def test_grouped_reports_with_a_hot_key(spark, sf):
    from slicewise.operators import quality as QA
    log = _hot_log(spark, sf)
    pdf = log.toPandas()
    got = {r.client: r.failures for r in LG.failures_by_client(log).collect()}
    want = pdf[pdf.failed].groupby("client").size().to_dict()
    assert got == want
    # one row repeated for a third of the table
    rows = log.select(F.when(F.col("event_id") % 3 == 0, F.lit("hot")).otherwise(F.col("details")).alias("d"),
                      F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("client")).alias("c"))
    r = QA.duplicates(rows).first()
    p = rows.toPandas()
    assert r.rows == len(p) and r.duplicates == int(p.duplicated().sum())
