"""Divergence of the sources of a language by their terms.

A CountVectorizer per language (``minDF`` documents, the largest vocabulary an integer can number)
gives every document its exact sparse vector.  Sums of the vectors per (language, source) keep only
entries that occur.  Two sources are compared on the entries they have: terms that neither has
share one value, terms of one side are summed by their count, and only shared terms meet in a join.

All arithmetic is in whole numbers: ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))`` for a term of
a group with ``N`` kept occurrences, ``V`` kept terms in the language, and
``f = floor((p - q)^2 / (p + q))``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import prepare, saved, scratch_path, text_or_empty

MIN_DF = 10
TOP_TERMS = 10
LARGEST_VOCABULARY = 2**31 - 1
SCALE = 1_000_000_000

# Byte by byte: A-Z to lower case, other ASCII that is no letter to a space, UTF-8 above unchanged.
_BYTES = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                   for b in range(256)], np.uint8)


def term_lists(text: pa.Array) -> pa.Array:
    """Terms ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of each text with A-Z in lower case, and one
    empty string per text (no text has the empty term): a language without a kept term has a
    vocabulary all the same."""
    raw = text.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    data = _BYTES[data[offsets[0]:offsets[-1]]]
    plain = pa.Array.from_buffers(pa.large_string(), len(raw), [
        None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data.tobytes())])
    parts = pc.ascii_split_whitespace(plain)
    start, flat = np.asarray(parts.offsets), parts.flatten()
    some = np.asarray(pc.binary_length(flat)) > 0
    count = np.concatenate([[0], np.cumsum(some)])[start - start[0]]
    kept = flat.filter(pa.array(some))
    # the empty string after the terms of each text
    n = len(raw)
    take = np.full(len(kept) + n, -1, np.int64)
    owner = np.repeat(np.arange(n), np.diff(count))
    take[np.arange(len(kept)) + owner] = np.arange(len(kept))
    values = pc.fill_null(kept.take(pa.array(take, mask=take < 0)), "").cast(pa.string())
    return pa.ListArray.from_arrays(pa.array(count + np.arange(n + 1), pa.int32()), values)


def with_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, terms`` of a table ``lang, source, text`` without nulls."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), term_lists(b.column(2))],
                                             ["lang", "source", "terms"])

    return docs.select("lang", "source", "text").mapInArrow(split, "lang string, source string, terms array<string>")


def term_counts(docs: DataFrame, min_df: int = MIN_DF) -> DataFrame:
    """``lang, source, term, c``: the documents' sparse vectors summed up entry by entry, for every
    language with at least ``min_df`` of them.

    One CountVectorizer per language, one after the other; models and sums are written to the shared
    folder, the vectors go from the model to the sums within a task.  A fitted model holds its
    language's vocabulary, as Spark's model does.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("lang").count().where(F.col("count") >= min_df).collect()
    root = scratch_path(spark, "div-counts")
    langs = sorted(r["lang"] for r in sizes)
    for i, lang in enumerate(langs):
        terms = with_terms(docs.where(F.col("lang") == lang))
        counter = CountVectorizer(inputCol="terms", outputCol="vec", minDF=float(min_df), vocabSize=LARGEST_VOCABULARY)
        model = counter.fit(terms)
        model.write().overwrite().save(f"{root}/model{i}")
        words = spark.read.parquet(f"{root}/model{i}/data").select(F.posexplode("vocabulary").alias("idx", "term"))
        sums = group_sums(model.transform(terms)).join(words, "idx").where("term <> ''")
        sums.select(F.lit(lang).alias("lang"), "source", "term", "c").write.parquet(f"{root}/sums{i}")
    counts = spark.createDataFrame([], "lang string, source string, term string, c long")
    return spark.read.schema(counts.schema).parquet(*[f"{root}/sums{i}" for i in range(len(langs))]) if langs else counts


HELD_ENTRIES = 4_000_000  # entries of vectors that a task adds up at a time


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors ``source, vec`` that a task meets, per source and entry."""
    number: dict = {}
    keys, values, held = [], [], 0

    def added() -> tuple[np.ndarray, np.ndarray]:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(inverse, np.concatenate(values), len(key))

    def rows(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        source = pa.array(list(number), pa.string()).take(pa.array(key >> 32))
        return pa.RecordBatch.from_arrays([source, pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(value.astype(np.int64))],
                                          ["source", "idx", "c"])

    for b in batches:
        group = np.array([number.setdefault(k, len(number)) for k in b.column(0).to_pylist()], np.int64)
        _, _, index, value = b.column(1).flatten()  # a sparse vector: kind, size, indices, values
        off = np.asarray(index.offsets).astype(np.int64)
        v_off = np.asarray(value.offsets)
        keys.append(np.repeat(group << 32, np.diff(off)) | np.asarray(index.values)[off[0]:off[-1]])
        values.append(np.asarray(value.values)[v_off[0]:v_off[-1]])
        held += len(keys[-1])
        if held > HELD_ENTRIES:
            key, value = added()
            if len(key) > HELD_ENTRIES // 2:
                yield rows(key, value)
                keys, values, held, number = [], [], 0, {}
            else:
                keys, values, held = [key], [value], len(key)
    if keys:
        yield rows(*added())


def group_sums(vectors: DataFrame) -> DataFrame:
    """Sum of the vectors (``source, vec``) per source, entry by entry: ``source, idx, c``."""
    return (vectors.select("source", "vec").mapInArrow(partial_sums, "source string, idx int, c long")
            .groupBy("source", "idx").agg(F.sum("c").alias("c")))


LONG_COUNT = 2**63 // SCALE - 3  # counts up to here stay below 2^63 when scaled


def _p(count: str, n: str, v: str) -> Column:
    return F.expr(f"1 + if({count} <= {LONG_COUNT}, (bigint({SCALE}) * ({count} + 2)) div ({n} + 2 * {v}), "
                  f"(cast({SCALE} as decimal(38,0)) * ({count} + 2)) div cast({n} + 2 * {v} as decimal(38,0)))")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def divergence(docs: DataFrame, min_df: int = MIN_DF, top: int = TOP_TERMS, text_col: str = "text",
               lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every language and source that occur.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the sum of ``f`` over
    all kept terms of the language.  Part ``term``: ``item`` is a kept term that the source has
    with a larger ``p`` than the whole language, ``value`` its ``f``; the first ``top`` of them.
    Ranks go from 1 by value descending, then by item in UTF-8 order.

    A null text, language or source is the empty string; an empty text has no terms but its group
    occurs; repeated rows count each; a very long text is one vector like any other; a language
    with fewer than ``min_df`` documents keeps no term and its pairs have value 0; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    base = docs.select(text_or_empty(docs[lang_col]).alias("lang"), text_or_empty(docs[source_col]).alias("source"),
                       text_or_empty(docs[text_col]).alias("text"))
    counts = term_counts(base, min_df)
    whole = saved(counts.groupBy("lang", "term").agg(F.sum("c").alias("lc")), "div-lang")
    of_lang = whole.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lc").alias("ln"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = (base.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left")
              .join(of_lang, "lang", "left").fillna(0, ["n", "v", "ln"])
              # without a kept term nothing is summed and p0 is not used
              .withColumn("p0", F.when(F.col("v") > 0, _p("0", "n", "v")).otherwise(F.lit(1))))
    groups = saved(groups.withColumn("g", F.monotonically_increasing_id()), "div-groups")

    scored = (counts.join(whole, ["term", "lang"]).join(groups, ["lang", "source"])
              .withColumns({"p": _p("c", "n", "v"), "q": _p("lc", "ln", "v")})
              .where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                     F.expr(_f("p", "q")).alias("value")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    side = groups.select("lang", "source", "p0", "v")
    a = side.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    b = side.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    # terms of one side against the value of an absent term on the other
    by_count = (counts.groupBy("lang", "source", "c").agg(F.count(F.lit(1)).alias("k"))
                .join(groups, ["lang", "source"])
                .select("lang", F.col("source").alias("x"), F.col("p0").alias("x0"), "k", _p("c", "n", "v").alias("p")))
    other = side.select("lang", F.col("source").alias("y"), F.col("p0").alias("y0"))
    alone = (by_count.join(other, "lang").where("x <> y")
             .select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
                     F.expr(f"k * ({_f('p', 'y0')} - {_f('x0', 'y0')})").alias("d")))
    # what that leaves out for terms of both sides, groups by number
    entry = counts.join(groups, ["lang", "source"]).select("term", "lang", "g", "p0", _p("c", "n", "v").alias("p"))
    left = entry.select("term", "lang", F.col("g").alias("ga"), F.col("p0").alias("a0"), F.col("p").alias("ap"))
    right = entry.select("term", "lang", F.col("g").alias("gb"), F.col("p0").alias("b0"), F.col("p").alias("bp"))
    both = (left.join(right, ["term", "lang"]).where("ga < gb")
            .select("ga", "gb", F.expr(f"{_f('ap', 'bp')} - {_f('ap', 'b0')} - {_f('a0', 'bp')} + {_f('a0', 'b0')}").alias("d"))
            .groupBy("ga", "gb").agg(F.sum("d").alias("d")))
    x = groups.select("lang", F.col("g").alias("ga"), F.col("source").alias("x"))
    y = groups.select(F.col("g").alias("gb"), F.col("source").alias("y"))
    both = both.join(x, "ga").join(y, "gb").select("lang", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "d")
    change = (alone.groupBy("lang", "a", "b").agg(F.sum("d").alias("d")).unionByName(both)
              .groupBy("lang", "a", "b").agg(F.sum("d").alias("d")))
    pairs = (a.join(b, "lang").where("a < b").join(change, ["lang", "a", "b"], "left")
             .select("lang", "a", "b", F.expr(f"v * ({_f('a0', 'b0')}) + coalesce(d, 0)").alias("value")))
    pairs = saved(pairs, "div-pairs")
    pairs = (pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
             .unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn(
        "rank", F.row_number().over(order))
    return pairs.unionByName(terms)
