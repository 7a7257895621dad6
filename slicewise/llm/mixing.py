"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source expects ``target / source size`` copies.  Inside the source the
expected copies are summed up in a fixed order, one random offset per source is added, and a
document is emitted once for each integer that its step of the running sum crosses.  The order
goes by size band first, so the words taken stay close to the target.

The running sum is a rank times a constant, and the rank is found in three levels: counts per
(source, band, hash bucket) give the bucket's start, counts per cell (size and further hash digits)
the cell's start in its bucket, and a row number inside the cell the rest.  A source of one size alone
has 65,536 cells, so no task sees more than a small share of a source, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import text_or_empty, words

WEIGHTS = (5, 2, 1)  # repeated over the sources in code-point order, null last
MAX_COPIES = 3
SEED = 42


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_COPIES) -> DataFrame:
    """``source, source_size`` -> plus ``target``: shares of the total by weight, no source above
    ``cap`` times its size, what is cut off shared again by weight.

    The final shares are ``min(cap * size, level * weight)``; the level is read off the sources
    sorted by ``cap * size / weight``, the first one that stays below its cap at the level left
    after all before it.  One row per source passes through one task, nothing larger.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = sizes.withColumn("i", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                          (F.col("i") % len(weights) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    everything = Window.partitionBy(F.lit(1))
    before = (Window.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), "i")
              .rowsBetween(Window.unboundedPreceding, -1))
    w = (w.withColumn("left", F.sum("source_size").over(everything)
                      - F.coalesce(F.sum("most").over(before), F.lit(0)))
         .withColumn("weight_left", F.sum("weight").over(everything)
                     - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.col("weight_left"))
         .withColumn("level", F.min(F.when(F.col("most") >= F.col("level") * F.col("weight"),
                                           F.struct(F.col("most") / F.col("weight"), "i", "level")))
                     .over(everything)["level"]))
    return w.select("source", "source_size",
                    F.least(F.col("most").cast("double"),
                            F.col("level") * F.col("weight")).alias("target"))


def size_band(size: Column) -> Column:
    """Bit length and leading four bits of a size, as a string that sorts like the size."""
    b = F.bin(size)
    return F.concat(F.lpad(F.length(b).cast("string"), 2, "0"), F.substring(b, 1, 4))


CELL = ["source_key", "band", "bucket", "size", "fine"]


def with_cell(d: DataFrame) -> DataFrame:
    """``source, size, key`` and others, plus the columns of the row's cell; rows sorted by cell, key,
    id and text are in the order of the running sum."""
    return d.withColumns({"source_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
                          "band": size_band(F.col("size")), "bucket": F.substring("key", 1, 1),
                          "fine": F.substring("key", 2, 3)})


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights=WEIGHTS, cap: int = MAX_COPIES,
                seed: int = SEED, payload: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, copies`` (and ``row``, the
    whole input row, when ``payload``).

    Texts of any length are only counted and hashed, in the JVM.  A null text has size 0; null is a source of its own; a source without words has target 0 and
    gives no copies.  The order inside a source hangs on size, id and text alone, so reruns agree;
    repeated rows are told apart by their rank only.
    """
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{seed}")))
    cols = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            F.size(words(text_col)).cast("long").alias("size"), key.alias("key"),
            F.md5(text_or_empty(text_col)).alias("tie")]
    if payload:
        cols.append(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = with_cell(docs.select(*cols))
    part = CELL[:3]
    counts = d.groupBy("source", *CELL).agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.groupBy("source", *part).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offset = F.conv(F.substring(F.md5(F.concat("source_key", F.lit(f"|{seed}"))), 1, 12), 16, 10).cast("double")
    starts = (buckets.withColumn("start", before(Window.partitionBy("source_key").orderBy("band", "bucket")))
              .join(source_targets(sizes, weights, cap).withColumnRenamed("source", "t_source"),
                    F.col("source").eqNullSafe(F.col("t_source")))
              .select(*part, "start", "source_size", "target", (offset / F.lit(float(1 << 48))).alias("offset")))
    starts = (counts.withColumn("inside", before(Window.partitionBy(*part).orderBy("size", "fine")))
              .select(*CELL, "inside").join(starts, part)
              .select(*CELL, (F.col("start") + F.col("inside")).alias("start"), "source_size", "target", "offset"))
    # ranks and starts meet on the same columns: one exchange of the rows serves both
    rank = Window.partitionBy(*CELL).orderBy("key", F.col("doc_id"), "tie")
    d = d.withColumn("rank", F.row_number().over(rank)).join(starts, CELL)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = lambda k: F.floor(F.col("rate") * k + F.col("offset"))
    d = (d.withColumn("rate", rate).withColumn("pos", F.col("start") + F.col("rank"))
         .withColumn("copies", upto(F.col("pos")) - upto(F.col("pos") - 1)))
    return d.select("doc_id", "size", "source_size", "target", "copies", *(["row"] if payload else []))


def mix(docs: DataFrame, **kw) -> DataFrame:
    """The mixed documents: each input row as often as it is taken, with all its columns."""
    d = with_copies(docs, payload=True, **kw)
    return (d.where("copies > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
            .select("row.*"))
