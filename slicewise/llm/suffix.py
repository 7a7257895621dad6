"""Substring deduplication on suffix arrays built by induced sorting.

Only places where a 100-byte string can repeat reach a suffix array: anchors (see ``windows``)
whose hash occurs once cannot, and where whole spans are equal the later ones go without sorting.
What is left, one span of each kind per anchor hash, is dealt out by that hash, so equal strings
meet in one shard.  A shard's spans form one text of bounded size; its suffix array is built by
induced sorting, the common prefix of each suffix with its predecessor (by text position) tells
which windows are equal, and in each group of equal windows all but the earliest go.

An anchor hash with very many different spans would make an unbounded shard; its windows are
compared by 128-bit hash in an aggregation instead, which holds one row per task and string.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import prepare, saved, text_or_empty
from slicewise.llm.hashing import U, mix
from slicewise.llm.windows import SpanHash, anchors, merge_spans, ranges, span_keys

WINDOW = 100            # bytes
GRAM = 64               # bytes of an anchor
SEEN_BITS = 1 << 29     # of the bitmap that leaves out anchors found once (64 MB)
SHARD_BYTES = 1 << 20   # text of one suffix array, about
WIDE = 2000             # spans of one anchor hash beyond which its windows are hashed instead
TILE = 1 << 21          # bytes of a text looked at together
HELD = 500_000          # anchors that a task compares with each other
CHUNK = 50_000          # sorted anchors looked at together
_BYTES = mix(np.arange(256, dtype=U) + U(0x51ED27))


# ---- suffix array ---------------------------------------------------------------------------


def _is_s_type(t: np.ndarray) -> np.ndarray:
    """Suffix i is S-type if it is smaller than suffix i+1; the last one (the sentinel) is."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int32) - t[:-1])
    nxt = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]  # where the run of equal symbols ends
    s = np.ones(n, bool)
    ok = nxt < n
    s[:-1][ok] = step[nxt[ok]] > 0
    return s


def _deal(t: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes ``j`` grouped by first symbol in their order: suffixes, symbols, rank in the
    group, and the groups' symbols and sizes."""
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[start, len(c)])
    return j, c, np.arange(len(c)) - np.repeat(start, size), c[start], size


def _induce(t, s_type, seeds, count) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes ``seeds`` in order.

    Buckets (by first symbol) are filled from the smallest for L-type suffixes, then from the
    largest for S-type ones.  What a bucket induces into itself is handled in waves, so the order
    is that of the sequential scan.
    """
    n, k = len(t), len(count)
    end = np.cumsum(count)
    begin = end - count
    sa = np.full(n, -1, np.int64)
    j, c, rank, symbols, size = _deal(t, seeds)
    seed_count = np.zeros(k, np.int64)
    seed_count[symbols] = size
    sa[(end - seed_count)[c] + rank] = j
    head = begin.copy()

    def to_heads(seg):
        j = seg - 1
        j = j[j >= 0]
        j = j[~s_type[j]]
        if len(j):
            j, c, rank, symbols, size = _deal(t, j)
            sa[head[c] + rank] = j
            head[symbols] += size

    for c in range(k):
        at = begin[c]
        while at < head[c]:
            at, seg = head[c], sa[at:head[c]]
            to_heads(seg)
        if seed_count[c]:
            to_heads(sa[end[c] - seed_count[c]:end[c]])
    tail, l_end = end.copy(), head

    def to_tails(seg):
        j = seg - 1
        j = j[j >= 0]
        j = j[s_type[j]]
        if len(j):
            j, c, rank, symbols, size = _deal(t, j)
            sa[tail[c] - 1 - rank] = j
            tail[symbols] -= size

    sa[0] = n - 1  # the sentinel, alone in its bucket
    tail[0] = begin[0]
    for c in reversed(range(1, k)):
        at = end[c]
        while at > tail[c]:
            at, seg = tail[c], sa[tail[c]:at][::-1]
            to_tails(seg)
        if l_end[c] > begin[c]:
            to_tails(sa[begin[c]:l_end[c]][::-1])
    return sa


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of ``t``, small non-negative integers whose last is a 0 found nowhere else.

    With ``depth`` the order is right for the first ``depth`` symbols at least.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    count = np.bincount(t)
    s_type = _is_s_type(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    # sort the LMS substrings (from one LMS place to the next) by inducing from any order
    sa = _induce(t, s_type, lms, count)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    stop = np.full(n, n, np.int64)
    stop[lms[:-1]] = lms[1:] + 1
    values = mix(t.astype(U))
    x, y = (SpanHash(values, i).of(order, stop[order]) for i in (0, 1))
    length = stop[order] - order
    new = np.r_[False, (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (length[1:] != length[:-1])]
    name = np.zeros(n, np.int64)
    name[order] = np.cumsum(new) + 1
    r = name[lms]
    # the reduced text of names, recursively: names of twice the substrings each time.  A name
    # stands for two symbols of progress at least.
    span = 1
    while r.max() < len(r) and (depth is None or 2 * span <= depth + 2):
        nxt = np.zeros(len(r), np.int64)
        nxt[:-span] = r[span:]
        r = np.unique(r * (len(r) + 1) + nxt, return_inverse=True)[1] + 1
        span *= 2
    return _induce(t, s_type, lms[np.argsort(r, kind="stable")], count)


def common_prefix_reaches(t: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """By text position: whether a suffix agrees with its predecessor in ``sa`` on ``length``
    symbols (the permuted common-prefix array, held against ``length``)."""
    out = np.zeros(len(t), bool)
    a, b = sa[1:], sa[:-1]
    fits = np.maximum(a, b) + length <= len(t)
    a, b = a[fits], b[fits]
    values = mix(t.astype(U))
    same = np.ones(len(a), bool)
    for i in (0, 1):
        h = SpanHash(values, i)
        same &= h.of(a, a + length) == h.of(b, b + length)
    out[a] = same
    return out


def equal_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the ``length``-byte windows inside the pieces: piece, offset, and a group number
    that equal windows share, groups in a row."""
    size = np.array([len(p) for p in pieces])
    t = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8).astype(np.uint16) + 2
    start = np.cumsum(size + 1) - size - 1
    t[start + size] = 1  # between pieces
    t = np.r_[t, np.zeros(1, np.uint16)]
    sa = suffix_array(t, length)
    piece = np.repeat(np.arange(len(size)), size + 1)
    inside = np.zeros(len(t), bool)
    inside[:-1] = (np.arange(len(t) - 1) - start[piece]) + length <= size[piece]
    same = common_prefix_reaches(t, sa, length)[sa]
    group = np.cumsum(~same)
    keep = inside[sa]
    sa, group = sa[keep], group[keep]
    return piece[sa], sa - start[piece[sa]], group


# ---- Spark side -----------------------------------------------------------------------------


def _row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), text)


def _tiles(texts: list[bytes], length: int):
    """Batches of about TILE bytes as ``(numbers of the texts, their starts, bytes, offsets)``;
    longer texts are cut into pieces that overlap by ``length - 1``, so each window is in one."""
    step, now, total = TILE - length + 1, [], 0
    for i, x in enumerate(texts):
        for s in range(0, max(1, len(x) - length + 1), step):
            now.append((i, s, x[s:s + TILE]))
            total += len(now[-1][2])
            if total >= TILE:
                yield now
                now, total = [], 0
    if now:
        yield now


def _anchors_of(texts: list[bytes], length: int, gram: int):
    """Per tile: values, anchors, and for each anchor its text and the start of its piece there
    less the piece's place in the tile."""
    for tile in _tiles(texts, length):
        off = np.cumsum([0] + [len(x) for _, _, x in tile])
        flat = _BYTES[np.frombuffer(b"".join(x for _, _, x in tile), np.uint8)]
        a = anchors(flat, off, length, gram)
        text = np.array([i for i, _, _ in tile])[a.owner]
        shift = np.array([s for _, s, _ in tile])[a.owner] - off[a.owner]
        yield flat, a, text, shift


def _bytes(col: pa.Array) -> list[bytes]:
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def _marks(p: np.ndarray) -> pa.RecordBatch:
    """Places ``p`` in the bitmap, at most two of each, by blocks of 2^16: block, low 16 bits."""
    p = np.sort(p)
    p = p[np.append([True] * min(2, len(p)), p[2:] != p[:-2])]
    block = p >> 16
    start = np.flatnonzero(np.append(len(p) > 0, block[1:] != block[:-1]))
    low = (p & 0xFFFF).astype(np.uint16)
    blobs = pa.Array.from_buffers(pa.binary(), len(start), [
        None, pa.py_buffer((np.append(start, len(p)) * 2).astype(np.int32).tobytes()), pa.py_buffer(low.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(block[start].astype(np.int32)), blobs], ["block", "low"])


def _twice(batches):
    """Words of the bitmap, ``w, bits``, from :func:`_marks` sorted by block."""
    def words(p: np.ndarray) -> pa.RecordBatch:
        p, n = np.unique(p, return_counts=True)
        p = p[n > 1]
        start = np.flatnonzero(np.append(len(p) > 0, (p[1:] >> 6) != (p[:-1] >> 6)))
        bits = np.left_shift(U(1), (p & 63).astype(U))
        bits = np.bitwise_or.reduceat(bits, start) if len(start) else bits
        return pa.RecordBatch.from_arrays([pa.array((p[start] >> 6).astype(np.int32)), pa.array(bits.view(np.int64))], ["w", "bits"])

    held = np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        block = b.column(0).to_numpy().astype(np.int64)
        blobs = b.column(1).to_pylist()
        size = np.array([len(x) // 2 for x in blobs])
        p = np.append(held, (np.repeat(block, size) << 16) | np.frombuffer(b"".join(blobs), np.uint16))
        whole = (p >> 16) != block[-1]
        yield words(p[whole])
        held = np.sort(p[~whole])  # of the block that may go on, two of each place
        held = held[np.append([True] * min(2, len(held)), held[2:] != held[:-2])]
    yield words(held)


def _seen_again(base: DataFrame, length: int, gram: int) -> np.ndarray:
    """Bitmap over anchor hashes (modulo ``SEEN_BITS``): set where at least two anchors fall.

    Its size is fixed.  With more anchors than it can tell apart it only lets through more of
    those found once, which costs work later and changes no result.
    """
    def run(batches):
        now, held = [], 0
        for b in batches:
            for _, a, _, _ in _anchors_of(_bytes(b.column(0)), length, gram):
                now.append((a.hash % U(SEEN_BITS)).astype(np.int64))
                held += len(now[-1])
                if held >= HELD:
                    yield _marks(np.concatenate(now))
                    now, held = [], 0
        if held:
            yield _marks(np.concatenate(now))

    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = (base.select("text").mapInArrow(run, "block int, low binary").repartition(n, "block")
             .sortWithinPartitions("block").mapInArrow(_twice, "w int, bits long")).toArrow()
    out = np.zeros(max(1, SEEN_BITS // 64), U)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy().view(U)
    return out


def _runs(k: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows in texts with those joined that follow each other."""
    order = np.lexsort((first, k))
    k, first, last = k[order], first[order], last[order]
    begin = np.flatnonzero(np.append(len(k) > 0, (k[1:] != k[:-1]) | (first[1:] > last[:-1] + 1)))
    return k[begin], first[begin], last[np.append(begin[1:], len(k)) - 1] if len(begin) else last


def _first_places(k, ids, no_id, first, last, h, span) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the anchors that are the first ones of their span here, and of those that come later."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    several = order[np.append(same, False) | np.append(False, same)] if len(order) else order
    alone = np.ones(len(h), bool)
    alone[several] = False
    at = several[np.lexsort((first[several], k[several], ids[several], no_id[several], span[several], h[several]))]
    new = np.append(len(at) > 0, (h[at][1:] != h[at][:-1]) | (span[at][1:] != span[at][:-1]))[:len(at)]
    rep = at[new][np.cumsum(new) - 1]
    # a row with the id and text of another one has its places, too
    later = (k[at] != k[rep]) | (first[at] != first[rep])
    return np.append(np.flatnonzero(alone), at[new]), at[later]


def _spans(base: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors that may occur again: text, place of their windows, hash, hash of their span.

    A task compares ``HELD`` of them at a time: those whose span is also at an earlier place there
    come, joined to long ranges, without hashes and id; no other task can make them the first."""
    shared = base.sparkSession.sparkContext.broadcast(_seen_again(base, length, gram))

    def compared(held: list) -> pa.RecordBatch:
        k, ids, no_id, first, last, h, span = (np.concatenate(c) for c in zip(*held))
        rep, later = _first_places(k, ids, no_id, first, last, h, span)
        lk, lf, ll = _runs(k[later], first[later], last[later])
        none = np.ones(len(lk), bool)

        def both(value: np.ndarray, missing: np.ndarray) -> pa.Array:
            return pa.array(np.append(value, np.zeros(len(lk), np.int64)), mask=np.append(missing, none))
        some = np.zeros(len(rep), bool)
        return pa.RecordBatch.from_arrays([
            pa.array(np.append(k[rep], lk)), both(ids[rep], no_id[rep]), pa.array(np.append(first[rep], lf)),
            pa.array(np.append((last - first)[rep], ll - lf).astype(np.int32)), both(h[rep], some), both(span[rep], some)],
            ["k", "doc_id", "first", "more", "h", "span"])

    def run(batches):
        seen, held, size = shared.value, [], 0
        for b in batches:
            k, no_id = b.column(0).to_numpy(), np.asarray(b.column(1).is_null())
            ids = b.column(1).fill_null(0).to_numpy()
            for flat, a, text, shift in _anchors_of(_bytes(b.column(2)), length, gram):
                p = a.hash % U(SEEN_BITS)
                keep = np.flatnonzero((seen[(p >> U(6)).astype(np.int64)] >> (p & U(63))) & U(1))
                row = text[keep]
                held.append((k[row], ids[row], no_id[row], (a.first + shift)[keep], (a.last + shift)[keep], a.hash[keep].view(np.int64),
                             span_keys(a, SpanHash(flat, 0), length)[keep].view(np.int64)))
                size += len(keep)
                if size >= HELD:
                    yield compared(held)
                    held, size = [], 0
        if size:
            yield compared(held)

    return base.mapInArrow(run, "k long, doc_id long, first long, more int, h long, span long")


def _places(wide: int):
    """From the anchors sorted by hash, span and place: the ranges of windows that come later, and the
    first place of each kind of span where a hash has several, with their number (``wide`` + 1 may
    stand for more).  At most ``wide`` first places are held."""
    def out(k, first, more, h=None, kinds=None) -> pa.RecordBatch:
        n, rep = len(k), h is not None
        none = pa.nulls(n, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(k), pa.array(first), pa.array(more), pa.array(np.full(n, rep)), pa.array(h) if rep else none,
                                           pa.array(kinds) if rep else none], ["k", "first", "more", "is_rep", "h", "kinds"])

    def chunks(batches):
        now, size = [], 0
        for b in batches:
            now, size = [*now, b], size + b.num_rows
            if size >= CHUNK:
                yield pa.Table.from_batches(now)
                now, size = [], 0
        if size:
            yield pa.Table.from_batches(now)

    def run(batches):
        prev = None     # hash, span and the first place of the last row's kind
        held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32)]  # first places of the last hash: h, k, first, more
        open_wide = None
        for t in chunks(batches):
            sure = np.asarray(t.column("h").is_null().combine_chunks())
            k, first, more = (t.column(c).to_numpy() for c in ("k", "first", "more"))
            if sure.any():
                yield out(k[sure], first[sure], more[sure])
                k, first, more = k[~sure], first[~sure], more[~sure]
            if not len(k):
                continue
            h, span = (t.column(c).fill_null(0).to_numpy()[~sure] for c in ("h", "span"))
            p = prev or (None, None, 0, 0)
            new = np.append((h[0], span[0]) != p[:2], (h[1:] != h[:-1]) | (span[1:] != span[:-1]))
            at = np.cumsum(new)
            rep_k, rep_first = np.append(p[2], k[new])[at], np.append(p[3], first[new])[at]
            later = ~new & ((k != rep_k) | (first != rep_first))
            if later.any():
                yield out(k[later], first[later], more[later])
            prev = (h[-1], span[-1], rep_k[-1], rep_first[-1])
            held = [np.append(a, b[new]) for a, b in zip(held, (h, k, first, more))]
            if not len(held[0]):
                continue
            start = np.flatnonzero(np.append(True, held[0][1:] != held[0][:-1]))
            kinds = np.diff(np.append(start, len(held[0])))
            kinds[held[0][start] == open_wide] = wide + 1
            if held[0][-1] == h[-1] and kinds[-1] > wide:
                open_wide, upto = h[-1], len(held[0])
            else:  # the last hash may go on
                upto = start[-1] if held[0][-1] == h[-1] else len(held[0])
            kinds = np.repeat(kinds, np.diff(np.append(start, len(held[0]))))
            give = np.flatnonzero(kinds[:upto] > 1)
            if len(give):
                yield out(held[1][give], held[2][give], held[3][give], held[0][give], kinds[give])
            held = [a[upto:] for a in held]
        if len(held[0]) > 1:
            yield out(held[1], held[2], held[3], held[0], np.full(len(held[0]), len(held[0])))

    return run


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """The texts ``k, doc_id, text`` and the byte spans ``s_k, spans`` to remove from them."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(docs[text_col]).alias("text")).select(
        _row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # order of places: id (null last), then the text's key, then the position
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "first")
    # one exchange of the anchors; ranges without a hash only pass through
    found = (_spans(base, length, gram).repartition(n, F.coalesce("h", "k"))
             .sortWithinPartitions("h", "span", F.col("doc_id").isNull(), "doc_id", "k", "first")
             .mapInArrow(_places(WIDE), "k long, first long, more int, is_rep boolean, h long, kinds long"))
    found = saved(found, "sfx-places")
    later = found.where("not is_rep").select("k", F.col("first").alias("start"),
                                             (F.col("first") + F.col("more") + length).alias("end"))
    check = found.where("is_rep").groupBy(F.col("k").alias("c_k")).agg(
        F.collect_set(F.struct("first", (F.col("first") + F.col("more")).alias("last"), "h", "kinds")).alias("c"))
    # every use of the texts reads the same exchange, in one job
    texts = base.repartition(n, "k")
    hit = (texts.join(check, F.col("k") == F.col("c_k")).dropDuplicates(["k"])
           .select("k", "doc_id", "text", "c.first", "c.last", "c.h", "c.kinds"))

    def cut_out(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            ks, ids, texts_, *lists = [b.column(0).to_pylist(), b.column(1).to_pylist(), _bytes(b.column(2)),
                                       *[b.column(i).to_pylist() for i in range(3, 7)]]
            for k, i, x, firsts, lasts, hs, kinds_ in zip(ks, ids, texts_, *lists):
                for f, z, h, m in zip(firsts, lasts, hs, kinds_):
                    piece = x[f:z + length]
                    if m <= WIDE:
                        rows = [(k, i, f, h, piece, None, None)]
                    else:
                        v = _BYTES[np.frombuffer(piece, np.uint8)]
                        at = np.arange(z - f + 1)
                        one, two = (SpanHash(v, w).of(at, at + length).view(np.int64).tolist() for w in (0, 1))
                        rows = [(k, i, f + o, None, None, p, q) for o, (p, q) in enumerate(zip(one, two))]
                    for r in rows:
                        for c, value in zip(out, r):
                            c.append(value)
            types = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             ["k", "doc_id", "first", "h", "piece", "x", "y"])

    pieces = hit.mapInArrow(cut_out, "k long, doc_id long, first long, h long, piece binary, x long, y long")
    shards = (pieces.where("h is not null").select("h", "k", "doc_id", "first", "piece")
              .repartition(n, "h").sortWithinPartitions("h"))

    def sort_shards(batches):
        rows, size, cut = [], 0, None
        for b in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if size >= SHARD_BYTES and r[0] != cut:
                    out.append(_later_windows(rows, length))
                    rows, size = [], 0
                rows.append(r)
                size += len(r[4])
                cut = r[0]
            yield from out
        if rows:
            yield _later_windows(rows, length)

    by_array = shards.mapInArrow(sort_shards, "k long, start long, end long")
    hashed = pieces.where("h is null").select("k", "doc_id", "first", "x", "y")
    earliest = (hashed.groupBy("x", "y").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1")
                .select(F.col("x").alias("x2"), F.col("y").alias("y2"), "rep"))
    by_hash = (hashed.join(earliest, (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")))
               .where((F.col("k") != F.col("rep.k")) | (F.col("first") != F.col("rep.first")))
               .select("k", F.col("first").alias("start"), (F.col("first") + length).alias("end")))
    spans = (later.unionByName(by_array).unionByName(by_hash).groupBy(F.col("k").alias("s_k"))
             .agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return texts, spans


def _later_windows(rows: list, length: int) -> pa.RecordBatch:
    """Spans of the windows that an earlier equal one precedes, in the shard of ``rows``
    ``(h, k, doc_id, first, piece)``."""
    piece, offset, group = equal_windows([r[4] for r in rows], length)
    k = np.array([r[1] for r in rows], np.int64)
    no_id = np.array([r[2] is None for r in rows])
    ids = np.array([r[2] or 0 for r in rows], np.int64)
    first = np.array([r[3] for r in rows], np.int64)
    # rank of each window's place, then the smallest of its group
    at = first[piece] + offset
    order = np.lexsort((at, k[piece], ids[piece], no_id[piece]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(rank, begin) if len(begin) else rank
    later = np.flatnonzero(rank != np.repeat(least, np.diff(np.r_[begin, len(group)])))
    piece, offset = piece[later], offset[later]
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    new = np.r_[True, (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(piece) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    last = np.r_[begin[1:], len(piece)] - 1 if len(begin) else begin
    p = piece[begin]
    return pa.RecordBatch.from_arrays([pa.array(k[p]), pa.array(first[p] + offset[begin]),
                                       pa.array(first[p] + offset[last] + length)], ["k", "start", "end"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier: in a smaller
    (integer) id, or in the same document before.  One row per input row.

    ``doc_id, n_bytes, n_removed, n_spans, starts, ends, kept binary``, or with ``digest``
    ``kept_sha256`` instead of the last three.  A null text counts as empty; null ids come last;
    rows with equal id are ordered by text, and of rows repeated with equal id and text the second
    and later ones lose all their bytes (from ``length`` bytes on).  Other columns are ignored; an
    empty table gives no rows.
    """
    texts, spans = repeated_spans(docs, id_col, text_col, length, gram)
    copy = F.row_number().over(Window.partitionBy("k").orderBy("k"))
    d = texts.withColumn("copy", copy).join(spans, F.col("k") == F.col("s_k"), "left").select(
        "doc_id", "text", F.col("spans.start").alias("s"), F.col("spans.end").alias("e"), "copy")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long" + (
        ", kept_sha256 string" if digest else ", starts array<long>, ends array<long>, kept binary")

    def run(batches):
        for b in batches:
            rows = [[] for _ in range(6)]
            for x, s, e, c in zip(_bytes(b.column(1)), *[b.column(i).to_pylist() for i in (2, 3, 4)]):
                if c > 1:
                    s, e = ([0], [len(x)]) if len(x) >= length else ([], [])
                s, e = merge_spans(np.array(s or [], np.int64), np.array(e or [], np.int64))
                parts, at = [], 0
                for i, j in zip(s.tolist(), e.tolist()):
                    parts.append(x[at:i])
                    at = j
                kept = b"".join([*parts, x[at:]])
                for col, value in zip(rows, (len(x), len(x) - len(kept), len(s), s, e, kept)):
                    col.append(value)
            cols = [b.column(0), *[pa.array(r, pa.int64()) for r in rows[:3]]]
            cols += ([pa.array([hashlib.sha256(x).hexdigest() for x in rows[5]], pa.string())] if digest else
                     [pa.array(rows[3], pa.list_(pa.int64())), pa.array(rows[4], pa.list_(pa.int64())),
                      pa.array(rows[5], pa.binary())])
            yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in schema.split(", ")])

    return d.mapInArrow(run, schema)
