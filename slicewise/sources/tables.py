"""Readers for the parquet tables and the KPI view derived from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def kpi_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-UE KPI rows derived from ``lineitem`` (one KPI row per line item).

    The mapping gives every raw KPI column its role: timestamps over many hours and days, a
    fourth scheduling policy without a code, training configurations outside the slice table,
    requested PRBs of 0, granted above requested, and nulls in the four quality/load columns.
    Map-only: one scan, no shuffle.
    """
    li = read_table(spark, sf_dir, "lineitem")
    ok, ln, pk, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    req = (F.col("l_quantity").cast("int") - 1)
    granted = (F.expr("(cast(l_quantity as int) - 1) * (10 - l_orderkey % 4) div 10")
               + F.when(ok % 11 == 0, 3).otherwise(0))
    return li.select(
        F.concat_ws("-", ok, ln, pk, sk).alias("row_key"),
        (F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (ok % 1440) * 60000).alias("ts_ms"),
        F.concat(F.lit("sched"), (ln % 4).cast("string")).alias("sched_policy"),
        F.concat(F.lit("tr"), (sk % 30).cast("string")).alias("training_config"),
        (pk % 3).cast("int").alias("slice_id"),
        (1 + 7 * (ok % 7)).cast("int").alias("bs_id"),
        (1 + ok % 4).cast("int").alias("exp_id"),
        F.concat(F.lit("user_"), pk.cast("string")).alias("imsi"),
        (F.col("l_extendedprice") / 20000.0).alias("tx_brate_dl_mbps"),
        req.cast("int").alias("sum_requested_prbs"),
        granted.cast("int").alias("sum_granted_prbs"),
        F.when(ok % 50 == 0, F.lit(None)).otherwise(F.col("l_discount") * 100.0)
         .cast("double").alias("tx_errors_dl_pct"),
        F.when(ok % 47 == 0, F.lit(None)).otherwise(F.col("l_tax") * 100.0)
         .cast("double").alias("rx_errors_ul_pct"),
        F.when(pk % 43 == 0, F.lit(None)).otherwise(1 + pk % 15).cast("int").alias("dl_cqi"),
        F.when(sk % 41 == 0, F.lit(None)).otherwise(1 + sk % 42).cast("int").alias("num_ues"),
    )


def access_log_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``access_log(event_id, client, ts, event_type, failed, details)`` from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id"),
        F.col("user_id").alias("client"),
        F.col("ts"),
        F.col("event_type"),
        (F.col("event_type") == "error").alias("failed"),
        F.col("value"),
        F.col("props").alias("details"),
    )


def screening_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source, id, text)``: raw web pages and documents, the inputs of text screening."""
    pages = read_table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    docs = read_table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text"))
    return pages.unionByName(docs)
