"""Substring deduplication by relative Lempel-Ziv parsing against blocks of the corpus itself.

The corpus is cut into reference blocks of whole texts.  An index of anchors (see ``windows``) names for
each phrase, the span of words an anchor stands for, one reference place: its first occurrence, or for that one
its last.  A document visits every block that holds a reference of its phrases, with the words around them, and
is parsed there from left to right: at the first phrase not yet inside a factor the match with the reference
text is followed word by word to both ends, as far as the words agree, and becomes a factor
(block, reference text, place, length).  A factor of at least ``window`` words is a duplicate span.

What is left are windows at factor boundaries: those whose anchor is known but whose phrase is not.  They
are checked one by one by a 128-bit hash against the windows of the other boundaries and of one reference
phrase of each kind.  Equal windows have equal anchors, and an anchor's occurrences either lie in a
factor or are checked at a boundary, so this finds every repeated window and nothing else.

A block that many documents visit is sent to several tasks, one for each ``VISIT_BYTES`` of visitors;
so what is shuffled grows with the visiting text and no task holds more than a block and a batch of visitors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import prepare, saved, text_or_empty
from slicewise.llm.hashing import hash_words, split_words
from slicewise.llm.windows import SpanHash, anchors, merge_spans, ranges, span_keys

WINDOW = 35   # words
GRAM = 10     # words of an anchor
COVERED, CHECK = 1, 2
BLOCK_BYTES = 4 << 20   # text of a reference block (a longer text is a block of its own size)
VISIT_BYTES = 32 << 20  # text of visitors for which a block is sent once more
FACTOR = "k long, start long, end long, block long, ref long, ref_start long"


def row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), text)


def _occurrences(base: DataFrame, window: int, gram: int) -> DataFrame:
    """``k, at, h, span`` of every anchor of every text."""

    def run(batches):
        for b in batches:
            flat, off = hash_words(split_words(b.column(1)))
            a = anchors(flat, off, window, gram)
            key = b.column(0).to_numpy()[a.owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(a.at - off[a.owner]), pa.array(a.hash.view(np.int64)),
                 pa.array(span_keys(a, SpanHash(flat, 0), window).view(np.int64))], ["k", "at", "h", "span"])

    return base.mapInArrow(run, "k long, at long, h long, span long")


def index_phrases(base: DataFrame, window: int, gram: int) -> DataFrame:
    """``k, at, kind, ref, ref_at`` of the anchors that occur again: COVERED where the whole span does (with the
    place of its reference), CHECK where only the anchor does (and for one reference of each span with
    such neighbours)."""
    occ = _occurrences(base, window, gram)
    again = occ.select("h").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    occ = saved(occ.join(again, "h"), "rlz-anchors")
    here = F.struct("k", "at")
    spans = occ.groupBy("h", "span").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("low"), F.max(here).alias("high"))
    kinds = spans.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"))
    spans = saved(spans.join(kinds, "h"), "rlz-spans")
    found = occ.join(spans, ["h", "span"])
    covered, mixed, first = F.col("n") > 1, F.col("kinds") > 1, here == F.col("low")
    kind = (F.when(covered, COVERED).otherwise(0) + F.when(mixed & (~covered | first), CHECK).otherwise(0))
    ref = F.when(covered, F.when(first, F.col("high")).otherwise(F.col("low")))
    return found.select("k", "at", kind.alias("kind"), ref["k"].alias("ref"), ref["at"].alias("ref_at")).where("kind > 0")


def _visits(hit: DataFrame, window: int, gram: int, blocks: int) -> DataFrame:
    """Of every text with phrases: a row per run of covered spans and block of their references, with the words of the
    run and as many around it as a match can reach, and a row ``k, start, x, y`` per window to check."""
    around = 2 * window  # a match ends inside the span next to a covered one

    def run(batches):
        for b in batches:
            texts = split_words(b.column(1))
            flat, off = hash_words(texts)
            a = anchors(flat, off, window, gram)
            at = a.at - off[a.owner]
            bounds = np.searchsorted(a.owner, np.arange(len(off)))
            key = b.column(0).to_numpy()
            rows, checks = [], []
            for i, p in enumerate(b.column(2)):
                p = p.values
                lo, hi = bounds[i], bounds[i + 1]
                pos, kind, ref, ref_at = (p.field(f).fill_null(0).to_numpy() for f in range(4))
                place = lo + np.searchsorted(at[lo:hi], pos)
                checks.append(place[(kind & CHECK) > 0])
                c = np.flatnonzero(kind & COVERED)
                if not len(c):
                    continue
                r, r_at = ref[c], ref_at[c]
                first, last = a.first[place[c]], a.last[place[c]] + window
                part = r % blocks
                order = np.lexsort((first, part))
                part, r, r_at, mine = part[order], r[order], r_at[order], pos[c][order]
                first, last = first[order], last[order]
                new = np.ones(len(part), bool)
                new[1:] = (part[1:] != part[:-1]) | (first[1:] > last[:-1])
                cut = np.append(np.flatnonzero(new), len(part))
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    x = max(0, first[s] - off[i] - around)
                    rows.append((key[i], x, part[s], b" ".join(texts[i][x:last[e - 1] - off[i] + around]),
                                 mine[s:e] - x, r[s:e], r_at[s:e]))
            t = np.concatenate(checks) if checks else np.zeros(0, np.int64)
            w, which = ranges(a.first[t], a.last[t])
            own = a.owner[t][which]
            one, two = SpanHash(flat, 0).of(w, w + window), SpanHash(flat, 1).of(w, w + window)
            n, m = len(rows), len(w)
            column = list(zip(*rows)) if rows else [()] * 7
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([pa.array(column[0], pa.int64()), pa.array(key[own], pa.int64())]),
                 pa.concat_arrays([pa.array(column[1], pa.int64()), pa.array(w - off[own], pa.int64())]),
                 pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(one.view(np.int64))]),
                 pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(two.view(np.int64))]),
                 pa.concat_arrays([pa.array(column[2], pa.int64()), pa.nulls(m, pa.int64())]),
                 pa.concat_arrays([pa.array(column[3], pa.binary()), pa.nulls(m, pa.binary())]),
                 *[pa.concat_arrays([pa.array(column[f], longs), pa.nulls(m, longs)]) for f in (4, 5, 6)]],
                ["k", "start", "x", "y", "block", "words", "at", "ref", "ref_at"])

    return hit.mapInArrow(run, "k long, start long, x long, y long, block long, words binary, at array<long>, "
                               "ref array<long>, ref_at array<long>")


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many values from the start on are equal."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        differ = np.flatnonzero(a[done:done + step][:n - done] != b[done:done + step][:n - done])
        if len(differ):
            return done + int(differ[0])
        done += step
        step *= 4
    return n


def greedy_parse(words: np.ndarray, at: np.ndarray, ref: np.ndarray, ref_at: np.ndarray, block: dict, reach: int):
    """Factors ``(start, end, ref, ref_start)`` of a run of words, from left to right.  ``at`` are the run's phrases in
    order; one that lies in the last factor with ``reach`` words to its right belongs to that factor."""
    out, end = [], -1
    for i, r, j in zip(at.tolist(), ref.tolist(), ref_at.tolist()):
        if i + reach <= end:
            continue
        text = block[r]
        left = agree(words[:i][::-1], text[:j][::-1])
        right = agree(words[i:], text[j:])
        out.append((i - left, i + right, r, j - left))
        end = i + right
    return out


def _factors(visits: DataFrame, texts: DataFrame, window: int, blocks: int) -> DataFrame:
    """``FACTOR`` of all visits: each block's texts meet its visitors in tasks."""
    spark = visits.sparkSession
    visits = visits.where("block is not null")
    # copies of a block: one per VISIT_BYTES of its visitors; as a table its size is known before it is joined
    copies = saved(visits.groupBy(F.col("block").alias("c_block")).agg(
        F.ceil(F.sum(F.octet_length("words")) / VISIT_BYTES).cast("int").alias("copies")), "rlz-blocks")
    wanted = visits.select(F.explode("ref").alias("w_ref")).distinct()
    refs = texts.join(wanted, F.col("k") == F.col("w_ref"), "left_semi").select(
        "k", F.col("text").cast("binary").alias("words"), F.pmod("k", F.lit(blocks)).alias("block"))
    none = F.lit(None).cast("array<long>")
    refs = refs.join(copies, F.col("block") == F.col("c_block")).select(
        "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("visitor"), "k",
        F.lit(0).cast("long").alias("start"), "words", none.alias("at"), none.alias("ref"), none.alias("ref_at"))
    guests = visits.join(copies, F.col("block") == F.col("c_block")).select(
        "block", F.pmod(F.xxhash64("k", "start"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("visitor"),
        "k", "start", "words", "at", "ref", "ref_at")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = refs.unionByName(guests).repartition(n, "block", "copy").sortWithinPartitions("block", "copy", "visitor")

    def run(batches):
        now, block = None, {}
        for b in batches:
            part, copy, visitor, k, start = (b.column(c).to_numpy() for c in range(5))
            flat, off = hash_words(split_words(b.column(5)))
            out = []
            for i in range(b.num_rows):
                if (part[i], copy[i]) != now:
                    now, block = (part[i], copy[i]), {}
                words = flat[off[i]:off[i + 1]]
                if not visitor[i]:
                    block[int(k[i])] = words.copy()
                    continue
                lists = [b.column(c)[i].values.to_numpy() for c in (6, 7, 8)]
                out += [(k[i], s + start[i], e + start[i], part[i], r, j)
                        for s, e, r, j in greedy_parse(words, *lists, block, window)]
            cols = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split(" ")[0] for f in FACTOR.split(", ")])

    return met.mapInArrow(run, FACTOR)


def _parsed(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int):
    """The texts by key, the table of factors, and the repeated windows at their boundaries."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(docs[id_col].alias("doc_id"), text_or_empty(docs[text_col]).alias("text")).select(
        row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    blocks = (base.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BLOCK_BYTES + 1
    phrases = index_phrases(base.select("k", "text"), window, gram)
    phrases = saved(phrases.groupBy(F.col("k").alias("p_k")).agg(
        F.sort_array(F.collect_set(F.struct("at", "kind", "ref", "ref_at"))).alias("phrases")), "rlz-phrases")
    # a key's copies stand behind each other: all uses of the texts read the same exchange
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = base.repartition(n, "k")
    hit = texts.join(phrases, F.col("k") == F.col("p_k")).select("k", "text", "phrases")
    visits = saved(_visits(hit, window, gram, blocks), "rlz-visits")
    factors = saved(_factors(visits, texts, window, blocks), "rlz-factors")
    ends = visits.where("block is null")
    twice = (ends.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select(F.col("x").alias("x2"), F.col("y").alias("y2")))
    ends = ends.join(twice, (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2"))).select(
        "k", "start", (F.col("start") + window).alias("end"))
    return texts, factors, ends


def factor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 gram: int = GRAM) -> DataFrame:
    """The parse itself: ``doc_id, start, length, block, ref_id, ref_start``, one row per factor.

    ``length`` words of the document from ``start`` on equal those of the reference document from ``ref_start`` on, and the
    words before and behind differ or a text ends there.  Factors may be shorter than ``window`` (a hash collision
    only) and may overlap.  Repeated rows are one document.  Texts without a repeated phrase have no factors.
    """
    texts, factors, _ = _parsed(docs, id_col, text_col, window, gram)
    names = texts.select("k", "doc_id").dropDuplicates(["k"])
    return (factors.distinct().join(names, "k")
            .join(names.select(F.col("k").alias("ref"), F.col("doc_id").alias("ref_id")), "ref")
            .select("doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "block", "ref_id", "ref_start"))


def parse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          gram: int = GRAM) -> DataFrame:
    """``doc_id, text, starts, ends``: word ranges to remove, one row per input row.

    A range is covered by windows of ``window`` words that start anywhere else too (same or another document, repeated
    rows included); ranges may overlap.  Null texts count as empty and have no range; other columns are ignored; an
    empty table gives no rows.  Texts of any length are parsed whole; one text must fit a task.
    """
    texts, factors, ends = _parsed(docs, id_col, text_col, window, gram)
    spans = (factors.where(F.col("end") - F.col("start") >= window).select("k", "start", "end").unionByName(ends)
             .groupBy(F.col("k").alias("s_k")).agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return texts.join(spans, F.col("k") == F.col("s_k"), "left").select(
        "doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   digest: bool = False, **kw) -> DataFrame:
    """Drop the repeated word ranges: ``doc_id, n_words, n_removed, starts, ends, text`` (the kept
    words joined by one space), or with ``digest`` ``doc_id, n_words, n_removed, kept_sha256``."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_removed long" + (
        ", kept_sha256 string" if digest else ", starts array<long>, ends array<long>, text string")

    def run(batches):
        for b in batches:
            counts, gone, kept, ss, es = [], [], [], [], []
            for words, s, e in zip(split_words(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, e = merge_spans(np.array(s or [], np.int64), np.array(e or [], np.int64))
                parts, at = [], 0
                for i, j in zip(s.tolist(), e.tolist()):
                    parts += words[at:i]
                    at = j
                parts += words[at:]
                counts.append(len(words))
                gone.append(len(words) - len(parts))
                kept.append(b" ".join(parts))
                ss.append(s)
                es.append(e)
            cols = [b.column(0), pa.array(counts, pa.int64()), pa.array(gone, pa.int64())]
            if digest:
                cols.append(pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()))
            else:
                cols += [pa.array(ss, pa.list_(pa.int64())), pa.array(es, pa.list_(pa.int64())),
                         pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [c.split(" ")[0] for c in schema.split(", ")])

    return parse(docs, id_col, text_col, **kw).mapInArrow(run, schema)
