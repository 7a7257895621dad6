"""Language-model scoring with Brown's class-based bigrams.

``p(word | previous) = p(class | previous class) * p(word | class)``.  Classes come from exchange
clustering of the whole known vocabulary: words move to the class that raises the class-bigram
likelihood most, judged in tasks against the statistics of the round before; every word has a turn
each ``SHARES`` rounds, a round that does not raise the likelihood is taken back, and rounds go on
until a full cycle moves nothing or gains less than ``TOLERANCE``.  When rounds were taken back in a
cycle that gains no more, fewer words move at a time before that counts as the end.

The ``CORE_WORDS`` most frequent words are exchanged first, with the others in provisional classes;
then every other word is put into its best class and all words take turns.  Bigrams lie in a
distributed table dealt by word; a round broadcasts one byte a word, its class.  Counts of the
``HEAD_WORDS`` most frequent words are broadcast (a bound set by the parameter); all other words of
the texts meet the full table of counts and classes in a join, aggregated per document before it.
With ``cluster_words`` only that many words are clustered, others belong to a class by their ending.

Smoothing: class transitions are interpolated with the class's own share; a discount from every
known word goes to unknown words, which count as one event per ending class.  Where the known words
have learned classes, the discounted part of their bigrams is what is known of the unknown ones.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from slicewise.llm.common import prepare, saved, text_or_empty
from slicewise.llm.hashing import mix

CORE_WORDS = 2048
HEAD_WORDS = 1 << 17
CLASSES = 48
SHARES = 3             # one word in so many may move in a round, each in its turn
MOST_SHARES = 24       # ... at most, when rounds are taken back
TOLERANCE = 5e-3       # a cycle of turns that gains less likelihood a bigram (nats) is the last
PACK = 1_500_000       # bigram entries in a packed row
DISCOUNT = 0.5
PRIOR = 2.0            # weight of a class's own share in a transition
FLUSH = 200_000        # entries of a task's counter before they are sent on

END = b"\n"            # cannot be a word
ENDINGS = 5            # letter, full stop, comma, digit, other


def _ending_table() -> np.ndarray:
    t = np.full(256, 4)
    t[ord("a"):ord("z") + 1], t[ord(".")], t[ord(",")], t[ord("0"):ord("9") + 1] = 0, 1, 2, 3
    return t


_ENDING = _ending_table()


def ending_column(word: Column) -> Column:
    """The ending class of a word (binary column), as :func:`_ending_table`."""
    last = F.conv(F.hex(F.substring(word, -1, 1)), 16, 10).cast("int")
    return (F.when(last.between(97, 122), 0).when(last == 46, 1).when(last == 44, 2)
            .when(last.between(48, 57), 3).otherwise(4))


def is_held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def tokens(col: pa.Array) -> list[list[bytes]]:
    """Lower-cased (A-Z only) words and the end of each text; a null text is empty."""
    return [[*(x or b"").lower().split(), END] for x in col.cast(pa.binary()).to_pylist()]


@dataclass
class Model:
    n: int                    # training tokens
    v: int                    # distinct ones
    counts: DataFrame         # word, c, klass (null: by ending): the words outside the head
    head: dict                # word -> number
    head_count: np.ndarray    # by head number
    head_class: np.ndarray
    log_emit: np.ndarray      # by head number, log10 p(word | class)
    log_trans: np.ndarray     # log10 p(class | previous class)
    mass: np.ndarray          # what the emissions of the words outside the head are shares of, by class
    ending_n: np.ndarray      # tokens and distinct words of each ending class
    ending_v: np.ndarray
    likelihood: list          # class-bigram log likelihood by round

    @property
    def end_class(self) -> int:
        return len(self.log_trans) - 1


def count_words(train: DataFrame) -> DataFrame:
    """``word binary, c`` over whole training texts (column ``text``), ends included."""

    def run(batches):
        def send(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())],
                                              ["word", "c"])
        c: Counter = Counter()
        for b in batches:
            for t in tokens(b.column(0)):
                c.update(t)
            if len(c) > FLUSH:
                yield send(c)
                c = Counter()
        if c:
            yield send(c)

    return train.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def most_frequent(words: DataFrame, most: int) -> Column:
    """Whether a word is among the ``most`` first by (count, key), descending, found by running
    counts over frequency bins, the counts of the crossing bin, and prefixes of the keys of the
    crossing count; words with equal count and key are in or out together."""
    inside, left, at = F.lit(False), most, F.lit(True)
    for c in (F.col("bin"), F.col("c"), F.shiftright("key", 47), F.col("key")):
        cut = None
        per = words.where(at).groupBy(c.alias("x")).count()
        # the highest values that can matter: no more than fit, and the crossing one
        for r in per.orderBy(F.desc("x")).limit(left + 1).collect():
            if r["count"] > left:
                cut = r["x"]
                break
            left -= r["count"]
        if cut is None:
            return inside | at
        inside, at = inside | (at & (c > F.lit(cut))), at & (c == F.lit(cut))
    return inside


def count_pairs(train: DataFrame, units: dict, tail: bool) -> DataFrame:
    """``l, r, n`` over neighbouring units: the words of ``units``, the end (also before the first
    word), and other words as :func:`tail_key` (``tail``) or as their ending."""
    shared = train.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        held: list = []

        def merged():
            keys = np.concatenate([k for k, _ in held])
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            at = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            return keys[at], np.add.reduceat(n, at)

        def send(keys, n):
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(n)], ["l", "r", "n"])

        size, last = 0, ENDINGS
        for b in batches:
            flat = [w for t in tokens(b.column(0)) for w in t]
            u = _keys(flat, shared.value) if tail else _unit_numbers(flat, shared.value, 0)
            held.append((np.stack([np.r_[last, u[:-1]], u], 1), np.ones(len(u), np.int64)))
            size += len(u)
            if size > 10 * FLUSH:
                yield send(*merged())
                held, size = [], 0
        if held:
            yield send(*merged())

    return (train.select("text").mapInArrow(run, "l long, r long, n long").groupBy("l", "r")
            .agg(F.sum("n").alias("n")))


def tail_key(word: Column) -> Column:
    """A negative number from the word's hash, as :func:`_keys`."""
    return F.bitwise_not(F.shiftrightunsigned(F.xxhash64(word), 1))


def _keys(flat: list[bytes], known: dict) -> np.ndarray:
    get = known.get
    u = np.fromiter((get(w, -1) for w in flat), np.int64, count=len(flat))
    other = np.flatnonzero(u < 0)
    h = np.fromiter((xxh64_intdigest(flat[i], 42) for i in other.tolist()), np.uint64, count=len(other))
    u[other] = ~(h >> np.uint64(1)).astype(np.int64)
    return u


def number_tail(tail: DataFrame, first: int) -> tuple[DataFrame, np.ndarray]:
    """``key, id``: the different keys of ``tail`` numbered from ``first``; and the ending by number."""
    at = tail.groupBy("key").agg(F.min("ending").alias("ending"))
    at = saved(at.withColumn("mid", F.monotonically_increasing_id()), "brown-tail")
    part = F.shiftright("mid", 33)
    sizes = {r["p"]: r["count"] for r in at.groupBy(part.alias("p")).count().collect()}
    offset, n = [], 0
    for i in range(max(sizes, default=0) + 1):
        offset.append(n)
        n += sizes.get(i, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offset]), (part + 1).cast("int"))
    at = at.withColumn("id", F.lit(first) + start + F.col("mid") - F.shiftleft(part, 33))

    def run(batches):
        for b in batches:
            yield _blobs(b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int8))

    ending = np.zeros(n, np.int64)
    for row in at.select("id", "ending").mapInArrow(run, "ids binary, c binary").collect():
        ending[np.frombuffer(row["ids"], np.int64) - first] = np.frombuffer(row["c"], np.int8)
    return at.select("key", "id"), ending


def _blobs(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["ids", "c"])


def pack(pairs: DataFrame, n: int, core: int) -> DataFrame:
    """The neighbours of every unit, both sides, dealt by the unit (by the neighbour for units
    under ``core``, which have many) and packed: one row per partition.  ``n`` pairs."""
    sides = [F.struct(F.col(u).alias("u"), F.lit(i).alias("side"), F.col(o).alias("o"), "n") for i, u, o in ((0, "r", "l"), (1, "l", "r"))]
    d = pairs.select(F.inline(F.array(*sides)))
    d = d.repartition(max(1, -(-2 * n // PACK)), F.when(F.col("u") < core, F.col("o")).otherwise(F.col("u")))

    def run(batches):
        got = [[c.to_numpy() for c in b.columns] for b in batches]
        if got:
            u, side, o, n = (np.concatenate(x) for x in zip(*got))
            ids, at = np.unique(u, return_inverse=True)
            out = (ids, at.astype(np.uint32), side.astype(np.int8), *(x.astype(np.min_scalar_type(x.max())) for x in (o, n)))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in out], PACKED)

    return saved(d.mapInArrow(run, ", ".join(f"{x} binary" for x in PACKED)), "brown-packed")


PACKED = ["ids", "at", "side", "o", "n"]


def _unpacked(batches):
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            size = len(row[2])
            types = (np.int64, np.uint32, np.int8, *(f"u{len(x) // size}" for x in row[3:]))
            *out, n = [np.frombuffer(x, t) for x, t in zip(row, types)]
            yield *out, n.astype(np.int64)


def _unit_numbers(flat: list[bytes], known: dict, base: int) -> np.ndarray:
    """Number of each word: from ``known``, else ``base`` plus its ending."""
    get = known.get
    u = np.fromiter((get(w, -1) for w in flat), np.int64, count=len(flat))
    other = np.flatnonzero(u < 0)
    if len(other):
        u[other] = base + _ENDING[np.fromiter((flat[i][-1] for i in other.tolist()), np.int64, count=len(other))]
    return u


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)


class Exchange:
    """Exchange clustering over packed bigrams.  Units: ``0..ENDINGS`` are the endings and the end,
    classes of their own; then words, the first of them (under ``core``) judged on the driver from
    their summed profiles, all others in tasks."""

    def __init__(self, pairs: DataFrame, saved_pairs: DataFrame, cls: np.ndarray, core: int, classes: int):
        self.spark = pairs.sparkSession
        self.core, self.classes, self.k = core, classes, classes + ENDINGS + 1
        self.own = {r["l"]: r["n"] for r in saved_pairs.where((F.col("l") == F.col("r")) & F.col("l").between(0, core - 1)).collect()}
        self.packed = pack(pairs, saved_pairs.count(), core)
        self.likelihood: list = []
        self.cls = cls

    def take(self, cls: np.ndarray) -> None:
        """Make ``cls`` the assignment: class bigrams, profiles of the core, likelihood."""
        self.cls = cls
        self.big, self.profile = self._statistics(cls)
        b = self.big
        self.like = float(_xlogx(b).sum() - _xlogx(b.sum(1)).sum() - _xlogx(b.sum(0)).sum())
        self.likelihood.append(self.like)

    def _statistics(self, cls):
        k, core = self.k, self.core
        shared = self.spark.sparkContext.broadcast(cls)

        def run(batches):
            cls, got = shared.value, np.zeros((k + 2 * core) * k, np.int64)
            for ids, at, side, o, n in _unpacked(batches):
                u, c = ids[at], cls[o].astype(np.int64)
                m = side == 0
                got += np.bincount(c[m] * k + cls[u[m]], weights=n[m], minlength=len(got)).astype(np.int64)
                m = u < core
                got += np.bincount((k + u[m] * 2 + side[m]) * k + c[m], weights=n[m], minlength=len(got)).astype(np.int64)
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["key", "n"])

        rows = self.packed.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
        got = np.zeros((k + 2 * core) * k)
        for r in rows:
            got[r["key"]] = r["n"]
        shared.unpersist()
        return got[:k * k].reshape(k, k), got[k * k:].reshape(core, 2, k)

    def core_pairs(self, ending: np.ndarray) -> DataFrame:
        """``l, r, n`` of the core alone, the other words as their endings: at most ``core ** 2`` rows."""
        core = self.core
        shared = self.spark.sparkContext.broadcast(ending.astype(np.int8))

        def run(batches):
            for ids, at, side, o, n in _unpacked(batches):
                m = side == 0
                u, o = ids[at[m]], o[m].astype(np.int64)
                u, o = (np.where(x < core, x, shared.value[x]) for x in (u, o))
                key, n = _summed(o * core + u, n[m])
                yield pa.RecordBatch.from_arrays([pa.array(key // core), pa.array(key % core), pa.array(n)], ["l", "r", "n"])

        return saved(self.packed.mapInArrow(run, "l long, r long, n long").groupBy("l", "r").agg(F.sum("n").alias("n")),
                     "brown-core")

    def moves(self, r: int, core: bool = True, tail: bool = True, shares: int = SHARES) -> np.ndarray:
        """The assignment after the words of the ``core`` or the ``tail`` whose turn is ``r`` have moved."""
        new = self.cls.copy()
        if core:
            ids = np.arange(ENDINGS + 1, self.core)
            for u in ids[_turn(ids, r, shares)]:
                new[u] = _best_class(int(self.cls[u]), *self.profile[u], self.own.get(u, 0), self.big, self.classes)
        if not tail or len(new) == self.core:
            return new
        shared = self.spark.sparkContext.broadcast((self.cls, self.big))
        first, classes, k = self.core, self.classes, self.k

        def run(batches):
            cls, big = shared.value
            for ids, at, side, o, n in _unpacked(batches):
                mine = (ids >= first) & _turn(ids, r, shares)
                if not mine.any():
                    continue
                m = mine[at]
                key = ((np.cumsum(mine) - 1)[at[m]] * 2 + side[m]) * k + cls[o[m]]
                ids = ids[mine]
                c = _best_classes(cls[ids].astype(np.int64), *_summed(key, n[m]), big, classes)
                w = c != cls[ids]
                yield _blobs(ids[w], c[w].astype(cls.dtype))

        for row in self.packed.mapInArrow(run, "ids binary, c binary").collect():
            new[np.frombuffer(row["ids"], np.int64)] = np.frombuffer(row["c"], new.dtype)
        shared.unpersist()
        return new

    def insert(self, cls: np.ndarray) -> None:
        """From ``cls``, put the words outside the core from their provisional classes into learned ones."""
        self.take(cls)
        for r in range(SHARES):
            self.take(self.moves(r, core=False))
        self.likelihood = [self.like]

    def cycles(self, rounds: int | None) -> None:
        """From the classes given, cycles of turns until one moves nothing or gains too little (or ``rounds`` are over)."""
        if not self.likelihood:
            self.take(self.cls)
        done, cycle, shares = 0, 0, SHARES
        while rounds is None or done < rounds:
            start, undone, moved = self.like, False, False
            for turn in range(cycle * shares, (cycle + 1) * shares):
                before = self.cls, self.big, self.profile, self.like
                new = self.moves(turn, shares=shares)
                if (new != self.cls).any():
                    moved = True
                    self.take(new)
                    if self.like <= before[3]:  # too many moves at once
                        self.cls, self.big, self.profile, self.like = before
                        undone = True
                done += 1
                if done == rounds:
                    return
            if not moved:
                return
            if self.like - start <= TOLERANCE * self.big.sum():
                if not undone or shares >= MOST_SHARES:
                    return
                shares *= 2
            cycle += 1

    def unknown(self, ending: np.ndarray) -> np.ndarray:
        """``big`` where ``DISCOUNT`` of each word's bigrams, in their shares, belong to the unknown
        words of its ending (``ending`` by unit)."""
        shared = self.spark.sparkContext.broadcast((self.cls, ending.astype(np.int8)))
        first, classes, k = self.core, self.classes, self.k

        def parts(side, u, c, x, cls, ending):
            """Discounted counts: after a class and off the word's class, after a class, before one."""
            e, m = classes + ending[u].astype(np.int64), side == 0
            add = lambda key, w: np.bincount(key, weights=w, minlength=k * k)
            return np.stack([add(c[m] * k + cls[u[m]], x[m]), add(c[m] * k + e[m], x[m]), add(e[~m] * k + c[~m], x[~m])])

        def run(batches):
            cls, ending = shared.value
            got = np.zeros((3, k * k))
            for ids, at, side, o, n in _unpacked(batches):
                total = np.bincount(at, weights=n * (side == 0), minlength=len(ids))
                m = ids[at] >= first
                got += parts(side[m], ids[at[m]], cls[o[m]].astype(np.int64), DISCOUNT * n[m] / total[at[m]], cls, ending)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(got.size)), pa.array(got.ravel())], ["key", "x"])

        got = np.zeros(3 * k * k)
        for r in self.packed.mapInArrow(run, "key long, x double").groupBy("key").agg(F.sum("x").alias("x")).collect():
            got[r["key"]] = r["x"]
        u, side, c = np.nonzero(self.profile[ENDINGS + 1:])
        u += ENDINGS + 1
        x = DISCOUNT * self.profile[u, side, c] / np.maximum(self.profile.sum(2)[u, 0], 1)
        off, to, after = (got.reshape(3, k * k) + parts(side, u, c, x, self.cls, ending)).reshape(3, k, k)
        return np.maximum(self.big - off + to, 0) + after


def _turn(ids: np.ndarray, r: int, shares: int = SHARES) -> np.ndarray:
    """Whether it is a unit's turn; each has one in every cycle of ``shares`` rounds, in each cycle
    with other units."""
    salt = np.uint64(r // shares * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(ids.astype(np.uint64) ^ salt) % np.uint64(shares)).astype(np.int64) == r % shares


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], np.add.reduceat(n, at)


def _best_classes(a: np.ndarray, key: np.ndarray, x: np.ndarray, big: np.ndarray, classes: int) -> np.ndarray:
    """The best class of each of many units (now in ``a``) against ``big``, from their profiles:
    ``x`` by ``key = (unit * 2 + side) * k + class``, sorted.  A unit is taken out of its class only
    to judge staying there."""
    k = len(big)
    table = np.concatenate([big[:, :classes], big[:classes].T])  # by side and class of the neighbour
    flat, margin = _xlogx(table), (big.sum(0)[:classes], big.sum(1)[:classes])
    unit, cell, side = key // (2 * k), key % (2 * k), key // k % 2
    out = a.copy()
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    z = 0
    while z < len(first):
        to = max(z + 1, int(np.searchsorted(first, first[z] + 50_000)))
        i, j = first[z], first[to] if to < len(first) else len(unit)
        us, cs, xs, ss = unit[i:j] - unit[i], cell[i:j], x[i:j], side[i:j]
        own = a[unit[first[z:to]]]
        stay = np.where(own < classes, own, 0)
        most = int(xs.max()) + 1
        kinds, inv = np.unique(cs * most + xs, return_inverse=True)
        kc, kx = np.divmod(kinds, most)
        rows = _xlogx(table[kc] + kx[:, None]) - flat[kc]
        gain = np.add.reduceat(rows[inv], first[z:to] - i)
        now = table[cs, stay[us]]
        back = np.bincount(us, weights=_xlogx(now) - _xlogx(np.maximum(now - xs, 0)), minlength=to - z)
        for s in (0, 1):
            t = np.bincount(us[ss == s], weights=xs[ss == s], minlength=to - z)
            gain -= _xlogx(margin[s] + t[:, None]) - _xlogx(margin[s])
            back -= _xlogx(margin[s][stay]) - _xlogx(np.maximum(margin[s][stay] - t, 0))
        at = np.flatnonzero(own < classes)
        gain[at, own[at]] = back[at] + 1e-9
        out[unit[first[z:to]]] = np.argmax(gain, 1)
        z = to
    return out


def _best_class(a: int, before: np.ndarray, after: np.ndarray, own: float, big: np.ndarray, classes: int) -> int:
    """The class in which a unit (now in ``a``) gives the highest likelihood: its counts with the
    classes before and after it and, among them, with itself."""
    k = len(big)
    # take the unit out of its class
    m = big.copy()
    m[a, :] -= after
    m[:, a] -= before
    m[a, a] += own
    before, after = before.copy(), after.copy()
    before[a] -= own
    after[a] -= own
    rows_sum, cols_sum = m.sum(1), m.sum(0)
    nb, na = before.sum() + own, after.sum() + own
    # gain of putting it into class b: its row, its column, the diagonal cell, the margins
    row = _xlogx(m + after[None, :]) - _xlogx(m)
    col = _xlogx(m + before[:, None]) - _xlogx(m)
    d = np.arange(k)
    diag = m[d, d]
    both = _xlogx(diag + after + before + own) - _xlogx(diag)
    gain = (row.sum(1) - row[d, d] + col.sum(0) - col[d, d] + both
            - (_xlogx(rows_sum + na) - _xlogx(rows_sum)) - (_xlogx(cols_sum + nb) - _xlogx(cols_sum)))
    top = int(np.argmax(gain[:classes]))
    return top if gain[top] > gain[a] + 1e-9 else int(a)


def fit(docs: DataFrame, text_col: str = "text", cluster_words: int | None = None,
        head_words: int = HEAD_WORDS, classes: int = CLASSES, rounds: int | None = None,
        core_words: int = CORE_WORDS) -> Model:
    """Learn the model from every text of ``docs``.  Without rows all words are unknown.

    ``cluster_words`` clusters only so many (at most ``head_words``) most frequent words instead of
    all, ``rounds`` ends either exchange early.
    """
    spark = docs.sparkSession
    prepare(spark)
    train = docs.select(text_or_empty(docs[text_col]).alias("text"))
    counts = count_words(train).withColumn("bin", F.floor(F.log2("c") * 8).cast("int"))
    counts = saved(counts.withColumn("ending", ending_column(F.col("word"))).withColumn(
        "key", tail_key(F.col("word"))), "brown-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    words = counts.where(F.col("word") != F.lit(END))
    in_head = most_frequent(words, head_words)
    head_rows = sorted(((r["c"], bytes(r["word"]), r["ending"], r["key"]) for r in words.where(in_head)
                        .select("word", "c", "ending", "key").collect()), key=lambda x: (-x[0], -x[3], x[1]))
    tail = words.where(~in_head)
    whole = cluster_words is None
    movable = len(head_rows) if whole else min(cluster_words, len(head_rows))
    fixed = ENDINGS + 1
    units = {w: i + fixed for i, (_, w, _, _) in enumerate(head_rows[:movable])} | {END: ENDINGS}
    ending = np.array([*range(ENDINGS), 0, *(e for _, _, e, _ in head_rows[:movable])], np.int64)
    pairs = by_key = saved(count_pairs(train, units, whole), "brown-pairs")
    if whole:
        numbers, more = number_tail(tail, len(ending))
        ending = np.r_[ending, more]
        for side in ("l", "r"):
            known = pairs.where(F.col(side) >= 0)
            met = pairs.where(F.col(side) < 0).join(numbers, F.col(side) == F.col("key"))
            pairs = known.unionByName(met.withColumn(side, F.col("id")).drop("key", "id"))
    k, core = classes + fixed, fixed + min(core_words, movable)
    # a fixed random start: dealing words out in turn can balance so that no single move helps
    cls = np.r_[classes + np.arange(fixed), np.random.default_rng(0).integers(0, classes, core - fixed),
                classes + ending[core:]].astype(np.min_scalar_type(k))
    ex = Exchange(pairs, by_key, cls, core, classes)
    if len(cls) > core:
        near = ex.core_pairs(ending)
        small = Exchange(near, near, cls[:core], core, classes)
        small.cycles(rounds)
        ex.insert(np.r_[small.cls, cls[core:]])
    ex.cycles(rounds)
    cls, big = ex.cls.astype(np.int64), ex.unknown(ending) if whole else ex.big
    # transitions: a class's own share fills in
    share = (big.sum(0) + 0.5) / (big.sum() + 0.5 * k)
    trans = (big + PRIOR * share) / (big.sum(1, keepdims=True) + PRIOR)
    head = {w: i for i, (_, w, _, _) in enumerate(head_rows)} | {END: len(head_rows)}
    ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
    count = np.array([c for c, _, _, _ in head_rows] + [ends["c"] if ends else 0], float)
    klass = np.r_[cls[fixed:fixed + movable], [classes + e for _, _, e, _ in head_rows[movable:]], k - 1].astype(np.int64)
    # the words outside the head by class (learned, or by ending)
    tail = (tail.join(class_table(numbers, ex.cls), "key") if whole
            else tail.withColumn("klass", F.lit(classes) + F.col("ending"))).select("word", "c", "klass")
    tail = saved(tail, "brown-classes")
    n, v = (np.bincount(klass[:-1], weights=w, minlength=k) for w in (count[:-1], np.ones(len(count) - 1)))
    for r in tail.groupBy("klass").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        n[r["klass"]] += r["n"]
        v[r["klass"]] += r["v"]
    # the unknown word is an event of the ending's class; of a learned one, its discount is outside
    mass = n - DISCOUNT * v if whole else n
    discounted = np.full(len(count), whole) | (klass >= classes)
    emit = np.zeros(len(count))
    emit[:-1] = np.log10((count - DISCOUNT * discounted)[:-1] / mass[klass[:-1]])
    return Model(int(total["n"] or 0), int(total["v"] or 0), tail, head, count, klass, emit, np.log10(trans), mass,
                 n[classes:k - 1], v[classes:k - 1], ex.likelihood)


def class_table(numbers: DataFrame, cls: np.ndarray) -> DataFrame:
    """``key, klass`` of the numbered words."""
    shared = numbers.sparkSession.sparkContext.broadcast(cls)

    def run(batches):
        for b in batches:
            c = shared.value[b.column(1).to_numpy()].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c)], ["key", "klass"])

    return numbers.select("key", "id").mapInArrow(run, "key long, klass int")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` per input row, over the whole text.

    A null or empty text is its end alone; repeated rows are scored each; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    floor = np.log10(model.n + 0.1 * (model.v + 1))
    shared = spark.sparkContext.broadcast((model.head, model.head_count, model.head_class, model.log_emit, model.log_trans))
    first_ending, end_class = model.end_class - ENDINGS, model.end_class

    def run(batches):
        head, count, klass, emit, trans = shared.value
        base, known = np.log10(count + 0.1) - floor, count > 0
        m = len(count)
        klass = np.r_[klass, first_ending + np.arange(ENDINGS)]
        emit, base, known = np.r_[emit, np.zeros(ENDINGS)], np.r_[base, np.zeros(ENDINGS)], np.r_[known, np.zeros(ENDINGS, bool)]
        row, part = 0, TaskContext.get().partitionId() << 40
        for b in batches:
            texts = tokens(b.column(1))
            flat = [w for t in texts for w in t]
            off = np.cumsum([0] + [len(t) for t in texts])
            u = _unit_numbers(flat, head, m)
            c = klass[u]
            prev = np.r_[end_class, c[:-1]]  # the end before each text is a text's start, too
            out = u >= m
            near = out | np.r_[False, out[:-1]]  # transitions that need the class of a word outside the head
            local = np.where(near, 0.0, trans[prev, c]) + emit[u]
            add = lambda x: np.add.reduceat(x, off[:-1])
            # codes of those transitions: a class, or -1 - the number of the text's word outside the head
            code = c.copy()
            own = np.repeat(np.arange(len(texts)), np.diff(off))
            tails = [{} for _ in texts]
            for i in np.flatnonzero(out).tolist():
                t = tails[own[i]]
                e = t.setdefault(flat[i], [len(t), 0])
                e[1] += 1
                code[i] = -1 - e[0]
            steps = np.stack([np.r_[end_class, code[:-1]], code], 1)[near].ravel().astype(np.int32)
            ends = np.r_[0, 2 * np.cumsum(add(near.astype(np.int64)))]
            lens = np.cumsum([0] + [len(t) for t in tails])
            pairs = pa.StructArray.from_arrays([pa.array([w for t in tails for w in t], pa.binary()),
                                                pa.array([e[1] for t in tails for e in t.values()], pa.int64())], ["word", "tf"])
            yield pa.RecordBatch.from_arrays([
                pa.array(part + row + np.arange(len(texts))), b.column(0), pa.array(np.diff(off)),
                pa.array(add(known[u].astype(np.int64))), pa.array(add(base[u])), pa.array(add(local)),
                pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pairs),
                pa.array([steps[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())],
                ["row", "doc_id", "n_tokens", "known", "base", "local", "tail", "steps"])
            row += len(texts)

    d = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text"))
    d = saved(d.mapInArrow(run, f"row long, doc_id {id_type}, n_tokens long, known long, base double, local double, "
                                "tail array<struct<word: binary, tf: long>>, steps binary"), "brown-scores")
    tail = d.select("row", F.posexplode("tail").alias("j", "t")).select("row", "j", "t.word", "t.tf")
    tail = tail.join(model.counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    ending = ending_column(F.col("word"))
    tail = tail.withColumn("klass", F.coalesce("klass", F.lit(first_ending) + ending))
    of = lambda a, at: F.element_at(F.array(*[F.lit(float(x)) for x in a]), at + 1)
    v_of, n_of = of(model.ending_v, ending), of(model.ending_n, ending)
    # an unknown word takes what the discount left over (everything in a class without words)
    emit = F.when(F.col("c") > 0, F.log10((F.col("c") - DISCOUNT) / of(model.mass, F.col("klass")))).when(
        v_of > 0, F.log10(DISCOUNT * v_of / n_of)).otherwise(0.0)
    sums = tail.groupBy("row").agg(
        F.sum(F.col("tf") * (F.log10(F.col("c") + 0.1) - F.lit(float(floor)))).alias("t_base"),
        F.sum(F.col("tf") * emit).alias("t_emit"),
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("t_known"),
        F.collect_list(F.struct("j", "klass")).alias("classes"))

    def follow(batches):
        trans = shared.value[4]
        for b in batches:
            steps, got, out = b.column(0).to_pylist(), b.column(1), []
            j, c = (got.flatten().field(x).to_numpy() for x in (0, 1))
            lens = np.r_[0, np.cumsum(got.value_lengths().fill_null(0).to_numpy())]
            for x, lo, hi in zip(steps, lens[:-1], lens[1:]):
                x = np.frombuffer(x, np.int32).astype(np.int64)
                of = np.zeros(hi - lo + 1, np.int64)
                of[-1 - j[lo:hi]] = c[lo:hi]  # indexed by the negative code
                at = np.where(x < 0, of[np.minimum(x, -1)], x).reshape(-1, 2)
                out.append(float(trans[at[:, 0], at[:, 1]].sum()))
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(out, pa.float64())], [*b.schema.names[2:], "t_trans"])

    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = d.drop("tail").join(sums, "row", "left").select(
        "steps", "classes", "doc_id", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        (F.col("base") + zero("t_base")).alias("base_score"), (F.col("local") + zero("t_emit")).alias("part"))
    scored = scored.mapInArrow(follow, f"doc_id {id_type}, n_tokens long, n_known long, base_score double, part double, "
                                       "t_trans double")
    return scored.select("doc_id", "n_tokens", "n_known", "base_score", (F.col("part") + F.col("t_trans")).alias("score"))


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Fit on the rows that are not held out, score all of them."""
    model = fit(docs.where(~is_held_out(docs[id_col])), text_col, **kw)
    out = score(docs, model, id_col, text_col)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                      F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
