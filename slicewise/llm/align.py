"""Alignment of two tokenizers' tokens by lockstep merging.

Both token sequences of a text cut the same bytes.  A state vector holds one pair of pointers per
lane; every step compares the ends of the tokens under all pointers at once, emits the link of the
two tokens, moves the pointer whose token ends first (both at a common end, which is a cut) and
drops the lanes that are finished.

A lane is a run of segments of one text.  Texts fall into segments at single spaces between other
characters: there both tokenizers begin a token, so a segment's tokens are the same wherever it
stands, and each distinct segment is encoded once per worker.  A lane ends after ``LANE`` tokens or
so, hence a step works on thousands of lanes whatever the lengths of the texts.

Counts of id pairs over the corpus go by blocks of texts: a block sends each of its pairs once,
and gets back the totals of those pairs alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slicewise.llm.bpe import byte_alphabet
from slicewise.llm.common import prepare, saved, text_or_empty

LANE = 512                # tokens of both kinds in a lane, about
BLOCK_CHARS = 24_000_000  # characters of the texts of a block, about
KEPT_SEGMENTS = 250_000   # encoded segments that a worker holds; beyond it starts anew
KEPT_TOKENS = 4_000_000   # and their tokens
AT_ONCE = 4096            # segments given to a tokenizer in one call
SHIFT = 32                # bits of the second id in a pair

# a space between two characters that are no white space (Python's class holds all of Unicode's)
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class ByteBpe:
    """A byte-level BPE of the tokenizers library; the text of a special token is ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or not spec["pre_tokenizer"]["use_regex"] or spec["normalizer"]:
            raise ValueError("the first tokenizer must split words before the space, as byte-level vocabularies do")
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = [b""] * size
        for s, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(of_char[c] for c in s) if all(c in of_char for c in s) else s.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("the second tokenizer has pieces across a space")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _gather(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges ``start, start + n`` of an array, one after the other."""
    total = int(n.sum())
    return values[np.arange(total) + np.repeat(start - (np.cumsum(n) - n), n)]


class Segments:
    """Encoded segments of a worker: ids by place in flat arrays, and whether the bytes agree."""

    def __init__(self, a: ByteBpe, b: Pieces):
        self.coders = (a, b)
        self.length = [np.array([len(x) for x in c.bytes], np.int64) for c in self.coders]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.start = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.sound = np.zeros(0, bool)

    def numbers(self, segments: list[str]) -> np.ndarray:
        """The number of each segment; new ones are encoded together."""
        if len(self.known) > KEPT_SEGMENTS or len(self.ids[0]) > KEPT_TOKENS:
            self.clear()
        new = [s for s in dict.fromkeys(segments) if s not in self.known]
        if new:
            both = [[x for a in range(0, len(new), AT_ONCE) for x in c.encode(new[a:a + AT_ONCE])] for c in self.coders]
            sound = np.array([b"".join(map(self.coders[0].bytes.__getitem__, x)) == (raw := (" " + s).encode())
                              and b"".join(map(self.coders[1].bytes.__getitem__, y)) == raw
                              for s, x, y in zip(new, *both)])
            for k, lists in enumerate(both):
                end = np.cumsum([len(x) for x in lists])
                self.start[k] = np.concatenate([self.start[k], self.start[k][-1] + end])
                self.ids[k] = np.concatenate([self.ids[k], np.fromiter((i for x in lists for i in x), np.int64, int(end[-1]))])
            self.sound = np.concatenate([self.sound, sound])
            first = len(self.known)
            self.known.update((s, first + i) for i, s in enumerate(new))
        return np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))


def lockstep(a_end: np.ndarray, a_lane: np.ndarray, b_end: np.ndarray, b_lane: np.ndarray):
    """Links and cuts of many lanes at once.

    ``*_end``: byte offsets in the lane where the tokens of all lanes end, lane after lane;
    ``*_lane``: where each lane's tokens start in them, with the end.  Returns ``link_a, link_b``
    (places of linked tokens) and ``cut_a, cut_b`` (places of tokens that end together).
    """
    lanes = np.flatnonzero(np.diff(a_lane) > 0)
    at_a, at_b = a_lane[lanes].copy(), b_lane[lanes].copy()
    stop = a_lane[lanes + 1]
    link_a, link_b, cut_a, cut_b = [], [], [], []
    while len(at_a):
        end_a, end_b = a_end[at_a], b_end[at_b]
        link_a.append(at_a)
        link_b.append(at_b)
        cut = end_a == end_b
        if cut.any():
            cut_a.append(at_a[cut])
            cut_b.append(at_b[cut])
        at_a, at_b = at_a + (end_a <= end_b), at_b + (end_b <= end_a)
        done = at_a == stop
        if done.any():
            left = ~done
            at_a, at_b, stop = at_a[left], at_b[left], stop[left]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or none) for x in (link_a, link_b, cut_a, cut_b))



def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below ``n``, a row each, and which of them are written."""
    tens = 10 ** np.arange(len(str(n - 1)) - 1, -1, -1, dtype=np.int64)
    ids = np.arange(n)[:, None]
    return (ids // tens % 10 + ord("0")).astype(np.uint8), (ids >= tens) | (tens == 1)


def group_texts(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray, owner: np.ndarray,
                n: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each of ``n`` texts; groups are numbered over all of them, ``owner``
    is the text of a group."""
    groups = len(owner)
    a_size, b_size = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    a_before, b_before = np.cumsum(a_size) - a_size, np.cumsum(b_size) - b_size
    total = len(a) + len(b)
    ids, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
    place_a = np.arange(len(a)) + b_before[a_group]
    place_b = np.arange(len(b)) + (a_before + a_size)[b_group]
    ids[place_a], ids[place_b] = a, b
    mark[place_a[np.cumsum(a_size) - 1]] = ord("|")
    mark[place_b[np.cumsum(b_size) - 1]] = ord(";")
    digits, shown_digits = _decimals(int(ids.max()) + 1 if total else 1)
    table = np.empty((total, digits.shape[1] + 1), np.uint8)
    table[:, :-1] = digits[ids]
    table[:, -1] = mark
    shown = np.ones(table.shape, bool)
    shown[:, :-1] = shown_digits[ids]
    flat = table[shown].tobytes()
    size = np.zeros(n, np.int64)
    group_chars = np.zeros(groups + 1, np.int64)
    group_of = np.zeros(total, np.int64)
    group_of[place_a], group_of[place_b] = a_group, b_group
    group_chars[:groups] = np.bincount(group_of, weights=shown.sum(1), minlength=groups)
    np.add.at(size, owner, group_chars[:groups])
    end = np.cumsum(size)
    return [flat[e - s:e - 1] if s else b"" for s, e in zip(size.tolist(), end.tolist())]


def aligned(texts: list[str | None], store: Segments) -> dict:
    """Alignment of a batch of texts: ``a, b`` ids with their text (``a_doc, b_doc``), places of
    linked tokens, groups of the tokens, and the text of each group."""
    parts = [_SEAM.split(t) if t else [] for t in texts]
    number = store.numbers([s for p in parts for s in p])
    doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    # a text with a segment whose bytes do not come back has no tokens
    bad = np.zeros(len(texts), bool)
    bad[doc[~store.sound[number]]] = True
    number, doc = number[~bad[doc]], doc[~bad[doc]]
    tokens = [store.start[k][number + 1] - store.start[k][number] for k in (0, 1)]
    ids = [_gather(store.ids[k], store.start[k][number], tokens[k]) for k in (0, 1)]
    # lanes: a text's segments, cut anew where its tokens pass a multiple of LANE
    upto = np.cumsum(tokens[0] + tokens[1])
    first = np.searchsorted(doc, doc)  # first segment of the same text
    inside = upto - np.where(first > 0, upto[first - 1], 0) - tokens[0] - tokens[1] if len(doc) else upto
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (inside[1:] // LANE != inside[:-1] // LANE)
    lane = np.cumsum(new) - 1
    ends, lanes = [], []
    for k in (0, 1):
        token_lane = np.repeat(lane, tokens[k])
        count = np.bincount(token_lane, minlength=int(lane[-1]) + 1 if len(lane) else 0)
        start = np.concatenate([[0], np.cumsum(count)])
        reach = np.cumsum(store.length[k][ids[k]])
        base = np.concatenate([[0], reach])[start[:-1]]
        ends.append(reach - base[token_lane])
        lanes.append(start)
    link_a, link_b, cut_a, cut_b = lockstep(ends[0], lanes[0], ends[1], lanes[1])
    group, owner = [], None
    a_doc, b_doc = np.repeat(doc, tokens[0]), np.repeat(doc, tokens[1])
    for k, cut in enumerate((np.sort(cut_a), np.sort(cut_b))):
        last = np.zeros(len(ids[k]), np.int64)
        last[cut] = 1
        group.append(np.cumsum(last) - last)
        if k == 0:
            owner = a_doc[cut]
    return {"a": ids[0], "b": ids[1], "a_doc": a_doc, "b_doc": b_doc, "link_a": link_a, "link_b": link_b,
            "a_group": group[0], "b_group": group[1], "group_doc": owner}


_LOADED: dict = {}


def _store(paths: tuple[str, str]) -> Segments:
    if paths not in _LOADED:
        _LOADED.clear()
        _LOADED[paths] = Segments(ByteBpe(paths[0]), Pieces(paths[1]))
    return _LOADED[paths]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def alignments(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: ``id``, counts, the digest of its groups and its distinct linked id pairs
    with their numbers (``pairs, times``), in blocks of about ``BLOCK_CHARS`` characters; and one
    row per block (``whole`` true) with the block's pairs and the number of texts that have them.
    """
    paths = (byte_bpe, pieces)
    id_type = docs.schema[id_col].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        store, part, block, chars, held, held_rows = _store(paths), TaskContext.get().partitionId(), 0, 0, [], 0

        def table(ids, counts, digest, off, pairs, times, whole):
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{part}-{block}"] * len(ids), pa.string()), ids, pa.array([whole] * len(ids), pa.bool_()),
                 *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(pairs, pa.int64())),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(times, pa.int32()))],
                ["block", "id", "whole", *_COUNTS, "groups_sha256", "pairs", "times"])

        def close(held, id_kind):
            pair, inverse = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            count = np.bincount(inverse, weights=np.concatenate([h[1] for h in held]), minlength=len(pair)).astype(np.int64)
            return pair, count, table(pa.nulls(1, id_kind), [[0]] * 4, [""], [0, len(pair)], pair, count, True)

        id_kind = None
        for b in batches:
            id_kind, texts = b.column(0).type, b.column(1).to_pylist()
            n, x = len(texts), aligned(texts, store)
            counts = [np.bincount(x[d], minlength=n) for d in ("a_doc", "b_doc", "group_doc")]
            link_doc = x["a_doc"][x["link_a"]]
            key = (x["a"][x["link_a"]] << SHIFT) | x["b"][x["link_b"]]
            order = np.lexsort((key, link_doc))
            key, link_doc = key[order], link_doc[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (link_doc[1:] != link_doc[:-1])
            at = np.flatnonzero(first)
            times, pairs = np.diff(np.append(at, len(key))), key[at]
            off = np.searchsorted(link_doc[at], np.arange(n + 1))
            texts_of = group_texts(x["a"], x["a_group"], x["b"], x["b_group"], x["group_doc"], n)
            digest = [hashlib.sha256(t).hexdigest() if t else "" for t in texts_of]
            yield table(b.column(0), [*counts, np.bincount(link_doc, minlength=n)], digest, off, pairs, times, False)
            pair, count = np.unique(pairs, return_counts=True)
            held.append((pair, count))
            held_rows, chars = held_rows + len(pair), chars + sum(map(len, filter(None, texts)))
            if held_rows > 2_000_000 or chars > BLOCK_CHARS:
                pair, count, row = close(held, id_kind)
                held, held_rows = [(pair, count)], len(pair)
                if chars > BLOCK_CHARS:
                    yield row
                    block, held, held_rows, chars = block + 1, [], 0, 0
        if held:
            yield close(held, id_kind)[2]

    schema = (f"block string, id {id_type}, whole boolean, {', '.join(c + ' long' for c in _COUNTS)}, "
              "groups_sha256 string, pairs array<long>, times array<int>")
    return docs.select(docs[id_col].alias("id"), text_or_empty(docs[text_col]).alias("text")).mapInArrow(align, schema)


def align(docs: DataFrame, byte_bpe: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, a row per text.

    ``n_links``: pairs of an A and a B token occurrence whose bytes overlap.  The count of an id
    pair is the number of texts of the corpus that hold it linked; ``count_sum`` adds it up over
    the text's links, ``n_best`` are the links whose count is the highest of their A id.
    ``groups_sha256``: digest of the ids between common ends, ``a1,a2|b1;a3|b2,b3``.

    A text that is null or empty, or that a tokenizer does not give back byte for byte, has no
    tokens: zeros and an empty digest.  Repeated rows and ids count as texts of their own.  A very
    long text is cut into lanes and is in one block with its neighbours; only a text without any
    space between other characters is one segment.  An empty table gives no rows; other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    rows = saved(alignments(docs, byte_bpe, pieces, id_col, text_col), "align-rows")
    own = rows.where("whole").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "block", F.col("e.pairs").alias("pair"), F.col("e.times").alias("n"))
    totals = saved(own.groupBy("pair").agg(F.sum("n").alias("total")), "align-totals")
    a_id = F.shiftright("pair", SHIFT).alias("a")
    # a row per A id at most: its size is that of the vocabulary
    best = F.broadcast(totals.groupBy(a_id).agg(F.max("total").alias("most")))
    known = (own.drop("n").join(totals, "pair").withColumn("a", a_id).join(best, "a")
             .select(F.col("block").alias("of_block"), "pair", "total", (F.col("total") == F.col("most")).alias("best")))
    texts = rows.where("not whole").drop("whole")
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, total = pair[order], right.column("total").to_numpy()[order]
        best = right.column("best").to_numpy().astype(bool)[order]
        links, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in left.select(["pairs", "times"]).to_batches(max_chunksize=512):
            lists, times = b.column(0), b.column(1)
            off = np.asarray(lists.offsets).astype(np.int64)
            at = np.searchsorted(pair, np.asarray(lists.values)[off[0]:off[-1]])
            t_off = np.asarray(times.offsets)
            n = np.asarray(times.values)[t_off[0]:t_off[-1]].astype(np.int64)
            off = off - off[0]
            for out, value in ((links, n * best[at]), (sums, n * total[at])):
                run = np.concatenate([[0], np.cumsum(value)])
                out.append(run[off[1:]] - run[off[:-1]])
        return pa.table({"doc_id": left.column("id"), **{c: left.column(c) for c in _COUNTS},
                         "n_best": np.concatenate(links), "count_sum": np.concatenate(sums),
                         "groups_sha256": left.column("groups_sha256")})

    schema = (f"doc_id {id_type}, {', '.join(c + ' long' for c in _COUNTS)}, n_best long, count_sum long, "
              "groups_sha256 string")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(count, schema)
