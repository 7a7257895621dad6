"""Resource-block allocation search over a table of network states.

The reference answers one state per call; here a ``states`` DataFrame (one row per state, a
unique ``state_id``) is searched at once.  The candidate set for ``T`` resource-block groups over
three slices is fixed by ``T`` alone ((T-1)(T-2)/2 candidates, 120 for T = 17), so it never
becomes data: the search is a row-local projection over ``states``:

1. per state and slice, an array of the slice's score at every feasible RBG count (``T-2``);
2. the mean slice score of every candidate as one ``array<double>`` (``scores``);
3. ``array_max`` + ``array_position`` give the best candidate, first in enumeration order on ties.

No join, no shuffle, whole-stage code generation end to end; the work is linear in the number of
states and spreads over the scan's partitions.  Scorers that need a model (A8) produce the
per-(slice, RBG) scores with a model transform instead (see ``models.py``).
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions.columns import clip, dlit, schema_with
from ..functions.partitioning import spread


# --- A1: candidates -----------------------------------------------------------------------------

def candidate_list(total: int = P.TOTAL_RBGS) -> list[tuple[int, int, int]]:
    """All splits of ``total`` into three parts of at least 1, ordered by the first, then the
    second part: every pair of cut points between the groups."""
    return [(x, y - x, total - y) for x, y in combinations(range(1, total), 2)]


def candidates(spark: SparkSession, total: int = P.TOTAL_RBGS) -> DataFrame:
    """A1 as a DataFrame ``(cand_id, rbg_0, rbg_1, rbg_2)`` built with ``explode(sequence)``."""
    t = F.lit(total)
    base = spark.range(1).select(F.explode(F.sequence(F.lit(1), t - 2)).alias("rbg_0"))
    base = base.select("rbg_0", F.explode(F.sequence(F.lit(1), t - 1 - F.col("rbg_0"))).alias("rbg_1"))
    base = base.where(t - F.col("rbg_0") - F.col("rbg_1") >= 1)
    base = base.withColumn("rbg_2", t - F.col("rbg_0") - F.col("rbg_1"))
    idx = (F.col("rbg_0") - 1) * (2 * total - 2 - F.col("rbg_0")) / 2 + (F.col("rbg_1") - 1)
    return base.select(idx.cast("int").alias("cand_id"), *[F.col(f"rbg_{i}").cast("int") for i in range(3)])


def candidate_structs(total: int = P.TOTAL_RBGS):
    """The candidates as a literal ``array<struct<cand_id, rbg_0, rbg_1, rbg_2>>``."""
    return F.array(*[F.struct(F.lit(i).alias("cand_id"), F.lit(a).alias("rbg_0"),
                              F.lit(b).alias("rbg_1"), F.lit(c).alias("rbg_2"))
                     for i, (a, b, c) in enumerate(candidate_list(total))])


# --- A2 / A3: slice features and the heuristic scorer -----------------------------------------

def slice_prb_utilization(req: Column, rbgs: int | Column) -> Column:
    """PRB utilisation of a slice given ``rbgs`` groups: ``min(1, coalesce(req, 1) / max(1, rbgs))``."""
    r = F.greatest(F.lit(1), rbgs if isinstance(rbgs, Column) else F.lit(int(rbgs)))
    return F.least(dlit(1.0), F.coalesce(req.cast("double"), dlit(1.0)) / r.cast("double"))


def heuristic_score(prb: Column, qos: Column, load: Column) -> Column:
    """A3: ``0.4*prb + 0.4*qos + 0.2*(1 - load)`` clipped to [0, 1] (features read by name)."""
    return clip((dlit(0.4) * prb + dlit(0.4) * qos) + dlit(0.2) * (dlit(1.0) - load), 0.0, 1.0)


SliceScorer = Callable[[int, int], Column]  # (slice_id, rbgs) -> score column of a state row


def heuristic_slice_scorer(req: str = "sum_requested_prbs", qos: str = "qos_score",
                           load: str = "network_load") -> SliceScorer:
    def score(slice_id: int, rbgs: int) -> Column:
        return heuristic_score(slice_prb_utilization(F.col(req), rbgs), F.col(qos), F.col(load))
    return score


def candidate_features(states: DataFrame, total: int = P.TOTAL_RBGS) -> DataFrame:
    """A2 long form: ``state x candidate x slice`` rows with ``slice_id``, ``allocated_rbgs`` and
    the slice ``prb_utilization``.

    The candidates are fixed by ``T`` (120 for T = 17) and enter as a literal array that each
    state row explodes (a generator, no join).  Use it to feed a row model; the search itself
    uses the wide form.  States of few partitions are dealt out to all cores first.
    """
    x = spread(states).select("*", F.inline(candidate_structs(total)))
    x = x.select("*", F.posexplode(F.array("rbg_0", "rbg_1", "rbg_2")).alias("slice_id_", "allocated_rbgs_"))
    x = x.drop(*[c for c in ("slice_id", "allocated_rbgs", "prb_utilization") if c in states.columns])
    return (x.withColumnRenamed("slice_id_", "slice_id")
             .withColumnRenamed("allocated_rbgs_", "allocated_rbgs")
             .withColumn("prb_utilization",
                         slice_prb_utilization(F.col("sum_requested_prbs"), F.col("allocated_rbgs"))))


# --- A4 / A5: wide scoring and exhaustive best -------------------------------------------------

def _slice_arr(s: int) -> str:
    return f"_sa_{s}"


def _slice_item(s: int, r: int) -> Column:
    """Score of slice ``s`` at ``r`` groups (``r`` = 1 .. T-2) from the per-slice array."""
    return F.col(_slice_arr(s)).getItem(r - 1)


def add_slice_scores(states: DataFrame, scorer: SliceScorer, total: int = P.TOTAL_RBGS,
                     n_slices: int = P.NUM_SLICES) -> DataFrame:
    """Per slice ``s`` an array of its score at ``r = 1 .. T-2`` groups.

    Kept as arrays (not 45 scalar columns) so that the optimizer does not inline the scorer
    into each of the candidate expressions: every slice score is computed once per state.
    """
    return states.withColumns({_slice_arr(s): F.array(*[scorer(s, r) for r in range(1, total - 1)])
                               for s in range(n_slices)})


def add_candidate_scores(states: DataFrame, scorer: SliceScorer | None = None,
                         total: int = P.TOTAL_RBGS, out: str = "scores") -> DataFrame:
    """A4 wide form: ``scores[i]`` = mean slice score of candidate ``i`` (enumeration order)."""
    scorer = scorer or heuristic_slice_scorer()
    df = add_slice_scores(states, scorer, total)
    cands = candidate_list(total)
    arr = F.array(*[((_slice_item(0, a) + _slice_item(1, b)) + _slice_item(2, c)) / dlit(3.0)
                    for a, b, c in cands])
    return df.withColumn(out, arr)


def candidate_scores_long(states: DataFrame, total: int = P.TOTAL_RBGS,
                          req: str = "sum_requested_prbs", qos: str = "qos_score",
                          load: str = "network_load") -> DataFrame:
    """A4 long form for reports: one ``(state, candidate)`` row with its heuristic score.

    Each state row explodes the literal candidate array (a generator, no join), and a following
    aggregation by candidate is partial (map-side) first, so only ``#candidates x #tasks``
    partial rows are shuffled.
    """
    def h(r):
        return heuristic_score(slice_prb_utilization(F.col(req), F.col(r)), F.col(qos), F.col(load))
    x = spread(states).select("*", F.inline(candidate_structs(total)))
    return x.withColumn("score", ((h("rbg_0") + h("rbg_1")) + h("rbg_2")) / dlit(3.0))


def add_allocation_scores(states: DataFrame, score_fn: Callable[[int, int, int], Column],
                          total: int = P.TOTAL_RBGS, out: str = "scores") -> DataFrame:
    """A4 for any allocation evaluator ``(a, b, c) -> Column`` (A6 custom scorer)."""
    return states.withColumn(out, F.array(*[score_fn(a, b, c) for a, b, c in candidate_list(total)]))


def _cand_literals(total: int) -> Column:
    return F.array(*[F.array(F.lit(a), F.lit(b), F.lit(c)) for a, b, c in candidate_list(total)])


def best_from_scores(df: DataFrame, total: int = P.TOTAL_RBGS, scores: str = "scores",
                     current: list[int] | None = None) -> DataFrame:
    """A5: best candidate per row: ``best_rbg_0..2``, ``best_score``; no candidate -> current, 0.

    ``array_position`` returns the first index holding the maximum, i.e. the first candidate
    in enumeration order on ties (numpy ``argmax``).
    """
    current = current or P.CURRENT_ALLOCATION
    if not candidate_list(total):
        return df.withColumns({"best_rbg_0": F.lit(current[0]), "best_rbg_1": F.lit(current[1]),
                               "best_rbg_2": F.lit(current[2]), "best_score": dlit(0.0)})
    mx = F.array_max(F.col(scores))
    pos = F.array_position(F.col(scores), mx)
    best = F.element_at(_cand_literals(total), pos.cast("int"))
    return df.withColumns({
        "best_rbg_0": best.getItem(0).cast("int"),
        "best_rbg_1": best.getItem(1).cast("int"),
        "best_rbg_2": best.getItem(2).cast("int"),
        "best_score": mx,
    })


def exhaustive_search(states: DataFrame, scorer: SliceScorer | None = None,
                      total: int = P.TOTAL_RBGS, current: list[int] | None = None,
                      keep_scores: bool = False, spread_rows: bool = True) -> DataFrame:
    """A5 end to end: per state the best allocation, its score and the current one's.
    ``spread_rows``: deal a table of few partitions out to all cores first."""
    scorer = scorer or heuristic_slice_scorer()
    current = current or P.CURRENT_ALLOCATION
    df = add_candidate_scores(spread(states) if spread_rows else states, scorer, total)
    df = best_from_scores(df, total, current=current)
    cur = ((_slice_item(0, current[0]) + _slice_item(1, current[1]))
           + _slice_item(2, current[2])) / dlit(3.0) if all(
        1 <= r <= total - 2 for r in current) else _current_score(scorer, current)
    df = df.withColumn("current_score", cur)
    df = df.withColumn("improvement", F.col("best_score") - F.col("current_score"))
    drop = [c for c in df.columns if c.startswith("_sa_")]
    if not keep_scores:
        drop.append("scores")
    return df.drop(*drop)


def _current_score(scorer: SliceScorer, current: list[int]) -> Column:
    return ((scorer(0, current[0]) + scorer(1, current[1])) + scorer(2, current[2])) / dlit(3.0)


SCORE_STEPS = 10**12  # slice scores are compared in these steps, so that their sums are exact


def best_splits(scores: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups ``[state, slice]`` and sum of the best split of ``total`` groups, from whole-number
    scores ``[state, slice, groups - 1]``.

    From the last slice to the first, the best sum of it and the later ones at every number of
    groups left: ``slices * total^2`` steps for all splits.  Then the groups are read off from the
    first slice on, each time the fewest that reach the best, so of equal splits the first wins.
    """
    n, slices, most = scores.shape
    if not slices * 1 <= total <= slices * most:
        return np.zeros((n, slices), np.int32), np.full(n, -2**62)
    by = np.ascontiguousarray(scores.transpose(1, 2, 0))  # states side by side
    best: list[dict] = [{} for _ in range(slices)] + [{0: np.zeros(n, scores.dtype)}]  # groups left -> best sum
    for s in range(slices - 1, -1, -1):
        later, before = slices - 1 - s, s
        for left in range(later + 1, total + 1) if s else [total]:  # each slice has a group at least, ``most`` at most
            if not total - before * most <= left <= total - before:
                continue
            for r in range(1, min(most, left - later) + 1):
                rest = best[s + 1].get(left - r)
                if rest is None:
                    continue
                here = best[s].get(left)
                if here is None:
                    best[s][left] = rest + by[s, r - 1]
                else:
                    np.maximum(here, rest + by[s, r - 1], out=here)
    rest = np.full(n, total)
    groups = np.zeros((n, slices), np.int32)
    for s in range(slices):
        # sums by groups left, rows of what cannot be below all
        table = np.full((total + 1, n), -2**62, scores.dtype)
        for left, value in best[s].items():
            table[left] = value
        later = np.full((total + 1, n), -2**62, scores.dtype)
        for left, value in best[s + 1].items():
            later[left] = value
        rows = np.arange(n)
        want = table[rest, rows]
        found = np.zeros(n, bool)
        for r in range(1, most + 1):  # the fewest groups are found first
            left = rest - r
            sums = later[np.maximum(left, 0), rows]
            hit = ~found & (left >= 0) & (sums > -2**62) & (sums + by[s, r - 1] == want)
            groups[hit, s] = r
            found |= hit
        rest = rest - groups[:, s]
    return groups, best[0][total]


def k_slice_search(states: DataFrame, scorer: SliceScorer | None = None, total: int = P.TOTAL_RBGS,
                   slices: int = P.NUM_SLICES) -> DataFrame:
    """A5 for any number of slices: ``states`` with ``best_rbgs`` (groups of each slice) and
    ``best_score``, the mean slice score.

    A max-plus program (:func:`best_splits`) over the slice scores of a state, which are columns as
    for three slices; row-local, no join and no shuffle.  Of equal splits the first in the order of
    :func:`candidate_list` wins.  Fewer groups than slices, or a score that is null, give nulls.
    """
    scorer = scorer or heuristic_slice_scorer()
    most = total - slices + 1
    names = states.columns
    schema = schema_with(states.schema, best_rbgs="array<int>", best_score="double")
    if most < 1:
        return states.withColumns({"best_rbgs": F.lit(None).cast("array<int>"), "best_score": F.lit(None).cast("double")})
    wide = spread(states).withColumns({f"_s{s}": F.array(*[F.floor(scorer(s, r) * dlit(float(SCORE_STEPS)) + dlit(0.5)).cast("long")
                                                           for r in range(1, most + 1)]) for s in range(slices)})
    wide = wide.withColumn("_ok", ~F.exists(F.flatten(F.array(*[f"_s{s}" for s in range(slices)])), lambda x: x.isNull()))

    def search(batches):
        for b in batches:
            scores = np.stack([b.column(f"_s{s}").flatten().fill_null(0).to_numpy().reshape(-1, most) for s in range(slices)], 1)
            groups, best = best_splits(scores, total)
            bad = ~np.asarray(b.column("_ok").to_numpy(zero_copy_only=False), bool)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(groups.ravel()), slices).cast(pa.list_(pa.int32()))
            lists = pc.if_else(pa.array(bad), pa.nulls(len(bad), lists.type), lists)
            mean = pa.array(best / float(SCORE_STEPS) / slices, mask=bad)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names))] + [lists, mean], [*names, "best_rbgs", "best_score"])

    return wide.mapInArrow(search, schema)


def linear_scorer(w0: Column | float, w1: Column | float, w2: Column | float
                  ) -> Callable[[int, int, int], Column]:
    """A6 example evaluator: ``a*w0 + b*w1 + c*w2`` (weights may be state columns)."""
    def as_col(w):
        return w if isinstance(w, Column) else dlit(w)
    ws = [as_col(w) for w in (w0, w1, w2)]

    def score(a: int, b: int, c: int) -> Column:
        return (dlit(a) * ws[0] + dlit(b) * ws[1]) + dlit(c) * ws[2]
    return score


def custom_search(states: DataFrame, score_fn: Callable[[int, int, int], Column],
                  total: int = P.TOTAL_RBGS) -> DataFrame:
    """Exhaustive search with any allocation evaluator."""
    return best_from_scores(add_allocation_scores(states, score_fn, total), total).drop("scores")


# --- A9-A13: what-if reports ---------------------------------------------------------------------

def improvement_summary(results: DataFrame, by: str = "scenario") -> DataFrame:
    """A10: steps, avg/max/min improvement per scenario plus the total row (``rollup``)."""
    return (results.rollup(by)
                   .agg(F.count(F.lit(1)).alias("steps"),
                        F.round(F.avg("improvement"), 6).alias("avg_improvement"),
                        F.round(F.max("improvement"), 6).alias("max_improvement"),
                        F.round(F.min("improvement"), 6).alias("min_improvement")))


def improvement_histogram(results: DataFrame, width: float = 0.01) -> DataFrame:
    """Improvement distribution in bins of ``width`` with count and mean."""
    b = F.floor(F.col("improvement") / dlit(width)).cast("long")
    return (results.groupBy(b.alias("bin"))
                   .agg(F.count(F.lit(1)).alias("n"),
                        F.round(F.avg("improvement"), 6).alias("mean_improvement"))
                   .withColumn("bin_start", F.round(F.col("bin") * dlit(width), 6)))


def validate_allocations(results: DataFrame, total: int = P.TOTAL_RBGS,
                         cols: tuple[str, str, str] = ("best_rbg_0", "best_rbg_1", "best_rbg_2")
                         ) -> DataFrame:
    """Every allocation must sum to ``T`` with each part >= 1."""
    a, b, c = (F.col(x) for x in cols)
    bad = ((a + b + c) != total) | (a < 1) | (b < 1) | (c < 1) | a.isNull() | b.isNull() | c.isNull()
    return results.agg(F.count(F.lit(1)).alias("n_checked"),
                       F.count(F.when(bad, 1)).alias("n_invalid")).withColumn(
        "valid", F.col("n_invalid") == 0)


def assert_valid(results: DataFrame, total: int = P.TOTAL_RBGS) -> DataFrame:
    """A13 as a guard inside a plan: fails the job on the first invalid allocation."""
    s = F.col("best_rbg_0") + F.col("best_rbg_1") + F.col("best_rbg_2")
    ok = (s == total) & (F.least("best_rbg_0", "best_rbg_1", "best_rbg_2") >= 1)
    # the check wraps an output column, so the optimizer neither prunes it (as it would an
    # unused column) nor pushes it below the search (as it would a filter); assert_true
    # returns null when the condition holds
    check = F.assert_true(ok, F.lit("allocation does not sum to T"))
    return results.withColumn("best_score", F.when(check.isNull(), F.col("best_score")))


def scenario_of(num_ues: Column) -> Column:
    """Load scenario of a state from its UE count (ours; the reference cycles fixed scenarios)."""
    return (F.when(num_ues <= 10, "low_load").when(num_ues <= 20, "medium_load")
             .when(num_ues <= 27, "high_load").otherwise("peak_hours"))
