"""Exact order statistics without a global sort and without one task holding a whole column.

``exact_quantiles`` gives linear-interpolation quantiles (pandas default, DuckDB
``quantile_cont``) of several columns at once:

1. tasks sort blocks of rows and keep ``accuracy`` evenly spaced values of each, reduced to as many
   per task; merged per column they give the number of values and brackets around every quantile
   (a block or a task adds at most its rows / ``accuracy`` to a rank's error; the brackets leave that);
2. tasks count the values below each bracket and at its ends, and give those between them with ties
   collapsed to ``(value, count)``.  A rank that falls on an end is found by the counts alone, so
   a value repeated any number of times is only counted;
3. for the other ranks, from these few values: a bracket is cut into ``SLICES`` equal slices, a
   running count over the slices finds the one that holds a rank, and a running count inside that
   slice finds the value.

The steps are the same for every size and end after a fixed number of jobs.  Values are compared as
whole numbers of the same order (``_ordered``), with NaN above every number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .partitioning import cached, spread

SLICES = 4096
BLOCK_ROWS = 200_000  # rows a task sorts at a time
_LOWEST, _HIGHEST = -2**63, 2**63 - 1


def _ordered(column: pa.Array) -> np.ndarray:
    """The column's values without nulls as whole numbers of the same order; 0 and -0 are equal, NaN
    is above all."""
    x = column.drop_null().to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(x), np.nan, x).view(np.int64)
    return bits ^ ((bits >> 63) & _HIGHEST)


def _value(key: int) -> float:
    """The double that :func:`_ordered` turned into ``key``."""
    k = np.int64(key)
    return float((k ^ ((k >> np.int64(63)) & np.int64(_HIGHEST))).view(np.float64))


def _thinned(keys: np.ndarray, weight: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``points`` of the sorted weighted values, each with the weight of those up to it."""
    if len(keys) <= points:
        return keys, weight
    upto = np.cumsum(weight)
    at = np.unique(np.searchsorted(upto, (np.arange(1, points + 1) * upto[-1]) // points, side="left"))
    return keys[at], np.diff(upto[at], prepend=0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held, rows = [*held, b], rows + b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, n = np.unique(keys, return_counts=True)
    return keys, n.astype(np.int64)


def _column(t: pa.Table, i: int) -> pa.Array:
    c = t.column(i)
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _brackets(d: DataFrame, probs: list[float], accuracy: int) -> tuple[dict, dict]:
    """Number of values per column, and the merged brackets of its quantiles as keys."""
    names = d.columns

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        return _thinned(keys[order], weight[order], accuracy)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for block in _blocks(batches):
            for i in range(len(names)):
                keys = _ordered(_column(block, i))
                if len(keys):
                    held.setdefault(i, []).append(_thinned(*_sorted_counts(keys), accuracy))
                    if len(held[i]) > 16:  # the error of a merge is of the rows merged
                        held[i] = [merged(held[i])]
        for i, parts in held.items():
            keys, weight = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i), pa.int32()), pa.array(keys), pa.array(weight, pa.int64())],
                                             ["c", "x", "w"])

    # a task of 200,000 rows thins once, of 16 times as many twice, and so on
    margin = 8.0 / accuracy

    def cut(key: tuple, t: pa.Table) -> pa.Table:
        keys, weight = (t.column(c).to_numpy() for c in ("x", "w"))
        order = np.argsort(keys, kind="stable")
        keys, upto = keys[order], np.cumsum(weight[order])
        n = int(upto[-1])

        def at(p: float) -> int:
            if p <= 0 or p >= 1:  # the thinned values need not hold the least and the greatest one
                return _LOWEST if p <= 0 else _HIGHEST
            return int(keys[min(int(np.searchsorted(upto, p * n, side="left")), len(keys) - 1)])
        spans = _merged([(at(p - margin), at(p + margin)) for p in probs])
        return pa.table({"c": t.column("c").slice(0, 1), "n": [n], "lo": [[a for a, _ in spans]], "hi": [[b for _, b in spans]]})

    rows = (d.mapInArrow(sketch, "c int, x long, w long").groupBy("c")
            .applyInArrow(cut, "c int, n long, lo array<long>, hi array<long>").collect())
    return {names[r["c"]]: r["n"] for r in rows}, {names[r["c"]]: list(zip(r["lo"], r["hi"])) for r in rows}


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000,
                    extra: list | None = None, extra_out: dict | None = None
                    ) -> dict[str, list[float | None]]:
    """Exact quantiles of ``cols`` (nulls ignored); None for a column without values.

    ``extra`` are aggregates over ``df`` that the caller wants as well (values in ``extra_out``).
    """
    extra = list(extra or [])
    if extra:
        row = df.agg(*[e.alias(f"x{j}") for j, e in enumerate(extra)]).first()
        if extra_out is not None:
            extra_out.update({j: row[f"x{j}"] for j in range(len(extra))})
    if not cols:
        return {}
    names = [f"v{i}" for i in range(len(cols))]
    d = spread(df.select(*[F.col(c).cast("double").alias(n) for n, c in zip(names, cols)]))
    counts, brackets = _brackets(d, probs, accuracy)
    ranks = {n: sorted({f((counts[n] - 1) * p) for p in probs for f in (math.floor, math.ceil)})
             for n in brackets}
    values = {}
    if brackets:
        values = _values_of_ranks(d, brackets, ranks)
        missed = {n for n in brackets if any((n, k) not in values for k in ranks[n])}
        if missed:  # beyond the error that the brackets leave: the whole column is the bracket
            whole = {n: [(_LOWEST, _HIGHEST)] for n in missed}
            values.update(_values_of_ranks(d, whole, {n: ranks[n] for n in missed}))
    out = {}
    for n, c in zip(names, cols):
        qs = []
        for p in probs:
            if not counts.get(n):
                qs.append(None)
                continue
            h = (counts[n] - 1) * p
            a, b = values[n, math.floor(h)], values[n, math.ceil(h)]
            qs.append(a if a == b or h == math.floor(h) else a + (b - a) * (h - math.floor(h)))
        out[c] = qs
    return out


def _merged(spans: list) -> list:
    out: list = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def _values_of_ranks(d: DataFrame, brackets: dict, ranks: dict) -> dict:
    """``{(column, k): value}`` for the 0-based ranks that lie inside the column's brackets."""
    bands = [(i, n, lo, hi) for i, (n, lo, hi) in enumerate(
        (n, lo, hi) for n, spans in brackets.items() for lo, hi in spans)]
    place = {n: j for j, n in enumerate(brackets)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(bands), 3), np.int64)  # below, at the lower end, at the upper end
        for block in _blocks(batches):
            columns = [_ordered(_column(block, j)) for j in range(len(place))]
            for i, n, lo, hi in bands:
                x = columns[place[n]]
                total[i] += ((x < lo).sum(), (x == lo).sum(), (x == hi).sum() if hi > lo else 0)
                keys, times = _sorted_counts(x[(x > lo) & (x < hi)])
                if len(keys):
                    part = (keys.astype(np.float64) - float(lo)) / (float(hi) - float(lo)) * (SLICES - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i), pa.int32()), pa.array(np.floor(part).astype(np.int64)),
                                                      pa.array(keys), pa.array(times)], ["band", "slice", "x", "n"])
        for j in range(3):  # the counts have slices of their own
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(bands)), pa.int32()), pa.array(np.full(len(bands), j - 3)),
                                              pa.array(np.zeros(len(bands), np.int64)), pa.array(total[:, j])], ["band", "slice", "x", "n"])

    hist = (d.select(*brackets).mapInArrow(count, "band int, slice long, x long, n long")
            .groupBy("band", "slice", "x").agg(F.sum("n").alias("n")))
    with cached(hist, spread_out=False) as hist:
        return _ranked(hist, bands, ranks)


def _ranked(hist: DataFrame, bands: list, ranks: dict) -> dict:
    """Values of the ranks from the counts of each bracket and of the values between its ends."""
    spark = hist.sparkSession
    inner = F.col("slice") >= 0
    sizes = {r["band"]: r for r in hist.groupBy("band").agg(
        *[F.sum(F.when(F.col("slice") == j - 3, F.col("n")).otherwise(0)).alias(c) for j, c in enumerate("blh")],
        F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("m")).collect()}
    found, want = {}, []
    for i, n, lo, hi in bands:
        below, at_lo, between, at_hi = (sizes[i][c] for c in "blmh")
        for k in ranks[n]:
            r = k - below
            if 0 <= r < at_lo:
                found[n, k] = _value(lo)
            elif 0 <= r - at_lo < between:
                want.append((i, int(k), int(r - at_lo)))
            elif 0 <= r - at_lo - between < at_hi:
                found[n, k] = _value(hi)
    if not want:
        return found
    hist = hist.where(inner)
    wanted = F.broadcast(spark.createDataFrame(want, "w_band int, k long, r long"))
    run = Window.partitionBy("band").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    slices = (hist.groupBy("band", "slice").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(run))
              .join(wanted, (F.col("band") == F.col("w_band")) & (F.col("r") < F.col("upto"))
                    & (F.col("r") >= F.col("upto") - F.col("n")))
              .select(F.col("band").alias("s_band"), F.col("slice").alias("s_slice"), "k",
                      (F.col("r") - F.col("upto") + F.col("n")).alias("r")))
    inside = Window.partitionBy("band", "k").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    hit = (hist.join(F.broadcast(slices), (F.col("band") == F.col("s_band")) & (F.col("slice") == F.col("s_slice")))
           .withColumn("upto", F.sum("n").over(inside))
           .where((F.col("r") < F.col("upto")) & (F.col("r") >= F.col("upto") - F.col("n"))))
    name = {i: n for i, n, _, _ in bands}
    found.update({(name[r["band"]], r["k"]): _value(r["x"]) for r in hit.select("band", "k", "x").collect()})
    return found
