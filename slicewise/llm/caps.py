"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector is in it when its cosine with the direction reaches a bound.
The directions are a structured random product code: after a random rotation the coordinates are
cut into blocks, each block has its own random code words, and every combination of one word per
block is a direction.  A vector is list-decoded, block by block, to all directions above the bound
without looking at the others.  Vectors of one label that share a direction meet in a task and are
verified in double precision.

The number of directions follows the number of vectors, so a filter holds as many at any size; the
bound follows from it by the share of the sphere that a cap covers.  Nothing is left out: a filter
with many vectors is cut into blocks and every two blocks meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import prepare, saved
from slicewise.llm.graph import components

THRESHOLD = 0.98
CODES = 3        # independent product codes
HITS = 16        # directions that a vector reaches in each code, in the mean
BLOCKS = 2       # blocks of a code
BLOCK_ROWS = 1024  # vectors of a filter that meet at a time; a larger one is cut into blocks
_SEED = 20240611


def cap_bound(share: float, dim: int) -> float:
    """Cosine above which lies ``share`` of the unit sphere in ``dim`` dimensions."""
    if dim == 1:
        return 1.0 if share < 0.5 else -1.0
    angle = np.linspace(0.0, np.pi, 400_001)
    area = np.cumsum(np.sin(angle) ** (dim - 2))
    return float(np.cos(angle[np.searchsorted(area, min(share, 1.0) * area[-1])]))


class ProductCode:
    """One random product code for vectors of ``dim`` dimensions, about ``size`` directions."""

    def __init__(self, dim: int, size: int, which: int, hits: float = HITS):
        rng = np.random.default_rng([_SEED, dim, which])
        self.width = 1 << (dim - 1).bit_length()  # padded, for the rotation
        self.signs = rng.choice([-1.0, 1.0], (2, self.width))
        blocks = min(BLOCKS, max(1, self.width // 2))
        self.cuts = [self.width * i // blocks for i in range(blocks + 1)]
        # no finer than the angle of linked vectors can tell apart (matters in few dimensions)
        size = max(2, min(size, 16 * 5 ** min(dim - 1, 40)))
        words = int(np.ceil(size ** (1 / blocks)))
        self.words = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            w = rng.standard_normal((words, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(blocks))
        self.size = words**blocks
        self.bound = cap_bound(hits / self.size, self.width)

    def rotated(self, x: np.ndarray) -> np.ndarray:
        """Random signs and a Hadamard transform, twice."""
        y = np.zeros((len(x), self.width))
        y[:, :x.shape[1]] = x
        for sign in self.signs:
            y, step = y * sign, 1
            while step < self.width:
                pair = y.reshape(len(y), -1, 2, step)
                y = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(len(y), -1)
                step *= 2
            y /= np.sqrt(self.width)
        return y

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``row, direction`` of all directions whose cosine with a unit vector reaches the bound:
        a prefix of words goes on only if the best words of the other blocks could lift it."""
        y = self.rotated(unit)
        score = [y[:, a:b] @ w.T for a, b, w in zip(self.cuts, self.cuts[1:], self.words)]
        best = np.array([s.max(1) for s in score])
        row, code, total = np.arange(len(unit)), np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i, s in enumerate(score):
            need = self.bound - best[i + 1:].sum(0)
            at, word = np.nonzero(total[:, None] + s[row] >= need[row][:, None])
            total, code, row = total[at] + s[row[at], word], code[at] * s.shape[1] + word, row[at]
        return row, code


def unit_rows(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(rows, unit vectors)`` for each length of vector in a list column."""
    off = np.asarray(col.offsets).astype(np.int64)
    flat = np.asarray(col.values)
    size, out = np.diff(off), []
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[off[rows][:, None] + np.arange(d)].astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
        out.append((rows, x / np.linalg.norm(x, axis=1, keepdims=True)))
    return out


def directions(vectors: DataFrame, size: int, hits: float = HITS, codes: int = CODES) -> DataFrame:
    """``g, caps``: the sorted directions of every vector of ``g, vec`` over all codes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for b in batches:
            rows, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, unit in unit_rows(b.column(1)):
                for c in range(codes):
                    code = made.setdefault((unit.shape[1], c), None) or ProductCode(unit.shape[1], size, c, hits)
                    made[unit.shape[1], c] = code
                    row, key = code.decode(unit)
                    rows.append(at[row])
                    keys.append(key * codes + c)
            row, key = np.concatenate(rows), np.concatenate(keys)
            order = np.lexsort((key, row))
            off = np.searchsorted(row[order], np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(key[order]))], ["g", "caps"])

    return vectors.select("g", "vec").mapInArrow(decode, "g long, caps array<long>")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of sorted rows, and where each group starts (end included)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        start = np.flatnonzero(new)
        if len(start) > 1:
            yield t.slice(0, start[-1]).combine_chunks(), start
        held = t.slice(start[-1]) if len(start) else t
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.array([0, held.num_rows])


def _met_before(early: list[np.ndarray]) -> np.ndarray:
    """Which pairs of rows share one of the given directions."""
    n = len(early)
    row = np.repeat(np.arange(n), [len(e) for e in early])
    _, key, count = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count > 1)
    column = np.full(len(count), -1)
    column[twice] = np.arange(len(twice))
    key = column[key]
    shared = np.zeros((n, n), bool)
    for a in range(0, len(twice), 4096):
        m = np.zeros((n, min(4096, len(twice) - a)), np.float32)
        here = (key >= a) & (key < a + m.shape[1])
        m[row[here], key[here] - a] = 1
        shared |= (m @ m.T) > 0
    return shared


def _parts(linked: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches by links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """Rows of one cell (two blocks of a filter, or one with itself) meet; ``g, n, peer``: the rows
    linked with ``g`` in this cell, and edges of a forest over the links.  A pair counts in the
    first direction that it shares, so once."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, start in _groups(batches, ["label", "dim", "cap", "i", "j"]):
            g, copies = t.column("g").to_numpy(), t.column("copies").to_numpy()
            own, within = t.column("own").to_numpy(), t.column("i").to_numpy() == t.column("j").to_numpy()
            early = t.column("early").combine_chunks()
            e_off, e_flat = np.asarray(early.offsets), np.asarray(early.values)
            unit = {}
            for rows, x in unit_rows(t.column("vec").combine_chunks()):
                place = np.zeros(t.num_rows, np.int64)
                place[rows] = np.arange(len(rows))
                unit[x.shape[1]] = x, place
            dim = t.column("dim").to_numpy()[start[:-1]]
            out_g, out_n, out_peer = [], [], []
            size, start = np.diff(start), start[:-1]
            for s, d in np.unique(np.stack([size, dim], 1)[size > 1], axis=0):
                of_size = start[(size == s) & (dim == d)]
                x_all, place = unit[int(d)]
                step = max(1, 4_000_000 // int(s * s))
                for a in range(0, len(of_size), step):
                    at = of_size[a:a + step][:, None] + np.arange(s)
                    x = x_all[place[at]]
                    near = np.matmul(x, x.transpose(0, 2, 1)) >= threshold
                    near &= within[at][:, :, None] | (own[at][:, :, None] != own[at][:, None, :])
                    near[:, np.arange(s), np.arange(s)] = False
                    for k in np.flatnonzero(near.any((1, 2))):
                        near_k = near[k] | near[k].T
                        some = np.flatnonzero(near_k.any(1))
                        rows = at[k][some]
                        link = near_k[np.ix_(some, some)]
                        link &= ~_met_before([e_flat[e_off[r]:e_off[r + 1]] for r in rows])
                        n = link.astype(np.int64) @ copies[rows]
                        label = _parts(link)
                        out_g += [g[rows][n > 0], g[rows][label != np.arange(len(rows))]]
                        out_n += [n[n > 0], np.zeros(int((label != np.arange(len(rows))).sum()), np.int64)]
                        out_peer += [np.full(int((n > 0).sum()), -1), g[rows][label[label != np.arange(len(rows))]]]
            if out_g:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_g, out_n, out_peer)],
                                                 ["g", "n", "peer"])

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "label", "dim", "cap", "i", "j").sortWithinPartitions("label", "dim", "cap", "i", "j")
    return cells.mapInArrow(compare, "g long, n long, peer long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, hits: float = HITS, codes: int = CODES) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row.

    ``n_links``: other rows of the same label whose cosine is found to be ``threshold`` or more;
    ``component_id``: the smallest id reachable by links, itself included; ``kept``: whether that
    is the row's own.  Every link is verified in double precision; the expected share of links
    that are found depends on ``hits`` and ``codes`` (README has measured recall).

    A vector that is null, empty or zero, or holds a null or non-finite component, links with
    nothing, nor does a row with a null label or vectors of different lengths.  Equal vectors and
    repeated rows link with each other; a null id stays null and does not lead a component that
    has another id.  An empty table gives no rows; other columns are ignored.  There are no texts;
    a very long vector is a row like any other.
    """
    spark = vectors.sparkSession
    prepare(spark)
    vec = F.col("vec")
    sound = (F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(vectors[id_col].alias("id"), vectors[label_col].cast("string").alias("label"),
                          vectors[vec_col].cast("array<double>").alias("vec"))
    rows = rows.withColumn("sound", F.coalesce(F.col("label").isNotNull() & sound, F.lit(False)))
    # 128 bits stand for (label, vector) where rows are matched with their group
    key = [F.xxhash64("label", "vec").alias("k1"), F.xxhash64(F.lit(_SEED), "vec", "label").alias("k2")]
    alike = (rows.where("sound").groupBy(*key, "label", "vec")
             .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first")))
    alike = saved(alike.select(F.monotonically_increasing_id().alias("g"), "k1", "k2", "label", F.size("vec").alias("dim"),
                               "vec", "copies", "first"), "cap-vectors")
    size = max(64, alike.count())
    caps = saved(directions(alike, size, hits, codes), "cap-directions")
    entry = caps.join(alike.select("g", "label", "dim"), "g").select(
        "g", "label", "dim", "caps", F.posexplode("caps").alias("place", "cap"))
    # directions that one vector alone has go before any vector is sent
    crowd = (entry.groupBy("label", "dim", "cap").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
             .select("label", "dim", "cap", F.ceil(F.col("c") / BLOCK_ROWS).cast("int").alias("blocks")))
    cells = (entry.withColumn("early", F.expr("slice(caps, 1, place)")).drop("caps", "place")
             .join(crowd, ["label", "dim", "cap"])
             .join(alike.select("g", "vec", "copies"), "g")
             .withColumn("mine", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("label", "dim", "cap", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                     F.col("mine").alias("own"), "g", "copies", "early", "vec"))
    links = saved(verified(cells, threshold), "cap-links")
    count = links.where("peer < 0").groupBy("g").agg(F.sum("n").alias("n"))
    part = saved(components(links.where("peer >= 0").select(F.col("g").alias("a"), F.col("peer").alias("b"))), "cap-parts")
    part = part.select(F.col("node").alias("g"), F.col("label").alias("part"))
    least = part.join(alike.select("g", "first"), "g").groupBy("part").agg(F.min("first").alias("least"))
    of_group = (alike.select("g", "k1", "k2", "copies", "first").join(count, "g", "left")
                .join(part.join(least, "part"), "g", "left")
                .select("k1", "k2", F.coalesce("least", "first").alias("least"),
                        (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")))
    sound_rows = rows.where("sound").select("id", *key).join(of_group, ["k1", "k2"]).select("id", "links", "least")
    out = sound_rows.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("least")))
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("least").alias("component_id"),
                      F.col("id").eqNullSafe(F.col("least")).alias("kept"))
