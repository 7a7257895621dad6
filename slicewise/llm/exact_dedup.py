"""Exact deduplication: 128-bit content hash, one stable row per group, byte comparison.

Texts are equal when they agree after deleting white space.  Rows meet by the MD5 of that
normalised text; the grouping key also holds the text itself, so equality inside a hash group is
decided by bytes and a collision makes two groups.  Partial aggregation merges the copies of a
partition before the shuffle, so a group with a third of all rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import text_or_empty, without_space


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_fn=content_hash) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the most code points, then the smallest id, stays.  A null text counts as empty;
    a null id loses against any other id of the same length; of rows repeated with the same id
    and text exactly one stays.  Other columns are ignored.  No rows give no rows.
    """
    norm = without_space(text_col)
    base = docs.select(F.col(id_col).alias("id"), norm.alias("norm"),
                       F.length(text_or_empty(text_col)).cast("long").alias("n"))
    base = base.withColumn("h", hash_fn(F.col("norm")))
    first = F.struct((-F.col("n")).alias("neg_n"), F.col("id").isNull().alias("no_id"), "id")
    groups = (base.groupBy("h", "norm")
              .agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("first"))
              .select(F.col("h").alias("gh"), F.sha2("norm", 256).alias("gs"), "group_size",
                      F.col("first.id").alias("keep_id"), (-F.col("first.neg_n")).alias("keep_n")))
    # rows that agree in all of these are one row with a count, so a repeated row stays once
    rows = (base.select("id", "h", F.sha2("norm", 256).alias("sha"), "n")
            .groupBy("id", "h", "sha", "n").agg(F.count(F.lit(1)).alias("copies")))
    out = rows.join(groups, (rows.h == groups.gh) & (rows.sha == groups.gs))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
         & (F.col("copy") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      hash_fn=content_hash) -> DataFrame:
    """The rows that stay, with all their columns (whatever their names).

    Same rules as :func:`exact_groups`; of fully repeated rows one stays.
    """
    decided = exact_groups(docs, id_col, text_col, hash_fn)
    counts = (decided.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies"),
                                                           F.max("kept").alias("any_kept"))
              .where("any_kept").select(F.col("doc_id").alias("k_id"),
                                        F.col("text_sha256").alias("k_sha"), "copies"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                         F.col(id_col).alias("id"), F.sha2(without_space(text_col), 256).alias("sha"),
                         F.length(text_or_empty(text_col)).alias("n"))
    hit = packed.join(counts, packed.id.eqNullSafe(counts.k_id) & (packed.sha == counts.k_sha))
    once = hit.where("copies = 1").select("row.*")
    # an id repeated with equal text: the longest original, then the smallest text, once
    more = (hit.where("copies > 1").groupBy("id", "sha")
            .agg(F.min_by("row", F.struct(-F.col("n"), F.col(f"row.{text_col}"))).alias("row"))
            .select("row.*"))
    return once.unionByName(more)
