"""Partitioning helpers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over at least ``min_partitions`` (default: the cluster's cores) when it
    has fewer partitions, for CPU-heavy row-local work after a scan of few large files.

    The number of partitions is estimated from the plan (input size by the size of a scan's
    splits), so nothing is run to find out, and a plan that already shuffles stays as it is.  On a
    cluster reading large input this is a no-op, so it never adds a shuffle at scale.
    """
    if df.isStreaming:  # a stream's partitioning is set per micro-batch by its source
        return df
    spark = df.sparkSession
    want = min_partitions or spark.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes"))
    shuffles = any(w in plan.toString() for w in ("Aggregate", "Repartition", "Sort ", "Window", "Join Inner"))
    if shuffles or int(str(plan.stats().sizeInBytes())) >= want * split:
        return df
    return df.repartition(want)


@contextmanager
def cached(df: DataFrame, spread_out: bool = True):
    """Persist ``df`` (memory, spilling to disk) for an operator that makes several passes.

    Only the columns the operator needs should be passed in.  Lost executors recompute their
    blocks from lineage, so the cache is an accelerator, never the only copy.
    """
    d = spread(df) if spread_out else df
    d = d.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield d
    finally:
        d.unpersist()
