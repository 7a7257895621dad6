"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewise.session import apply_required_conf, checkpoint_dir, scratch_path

# White space of the word definition: space and U+0009..U+000D, nothing else.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_REGEX = r"[\x20\x09-\x0D]+"

# Python stages take batches of this many rows, so that a worker holds a few MB of text at once.
ARROW_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Settings of the session for these operators; Python workers can import the package."""
    apply_required_conf(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string")


def words(c: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null or empty."""
    return F.array_remove(F.split(text_or_empty(c), SPACE_REGEX), "")


def without_space(c: str | Column) -> Column:
    """The text without any character of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text_or_empty(c), SPACE_CHARS, "")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared checkpoint folder and read it back: it cuts the
    lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


__all__ = ["ARROW_ROWS", "SPACE_CHARS", "SPACE_REGEX", "checkpoint_dir", "prepare", "saved",
           "scratch_path", "table", "text_or_empty", "words", "without_space"]
