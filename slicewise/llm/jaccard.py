"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles (a text of one to four words is one shingle).  Equal word
sequences become one text with a count.  MinHash bands propose candidates; texts that share a
bucket, directly or over others, form a candidate family.  A family is cut into blocks by hash and
every two blocks meet in one task: there MinHash values are compared a few at a time, a pair goes
as soon as the posterior probability that its similarity reaches the threshold is below the
tolerance, and the shingle sets of the rest are intersected exactly.  A task returns counts per
text and a spanning forest of its links, never the pairs, and holds two blocks at most.
"""

from __future__ import annotations

import hashlib
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import prepare, saved, text_or_empty
from slicewise.llm.graph import components
from slicewise.llm.hashing import U, hash_words, mix, rolling, split_words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 34, 5      # a pair at the threshold is proposed with probability 1 - 1.4e-6
TOLERANCE = 1e-6         # posterior probability under which a pair is dropped
STEP = 34                # MinHash values compared at a time
BLOCK = 256              # texts of a block, about
_MULT = np.random.default_rng(20240501).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts in one array (sorted inside a text), and offsets."""
    flat, off = hash_words(texts)
    n = np.diff(off)
    grams = mix(rolling(flat, SHINGLE, 0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(texts)), n)
    inside = (owner[:len(grams)] == owner[SHINGLE - 1:]) if len(grams) else np.zeros(0, bool)
    h, o = grams[inside], owner[:len(grams)][inside]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        own = np.array([int.from_bytes(hashlib.md5(b"short " + b" ".join(texts[i])).digest()[:8], "little")
                        for i in short], U)
        h, o = np.concatenate([h, own]), np.concatenate([o, short])
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[first], o[first]
    return h, np.searchsorted(o, np.arange(len(texts) + 1))


def signatures(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values (high 32 bits), a row per text; texts without shingles get zeros."""
    out = np.zeros((len(off) - 1, len(_MULT)), np.uint32)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        starts = off[some]
        for j, m in enumerate(_MULT):
            out[some, j] = np.minimum.reduceat(h * m, starts) >> U(32)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = np.tile(np.arange(1, BANDS + 1, dtype=U), (len(sig), 1))
    s = sig.reshape(len(sig), BANDS, ROWS).astype(U)
    for r in range(ROWS):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + s[:, :, r])
    return keys.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest matches among ``n`` compared values that leave a posterior probability of at least
    ``tolerance`` for a similarity of ``threshold`` or more, under a uniform prior: the posterior
    is Beta(matches + 1, n - matches + 1), whose tail is a binomial sum."""
    tail = 0.0
    for k in range(n + 1):
        tail += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        if tail >= tolerance:
            return k
    return n


def linked_pairs(h, off, left: np.ndarray, right: np.ndarray | None, threshold: float, tolerance: float):
    """Yield ``(i, js)``: texts ``js`` whose Jaccard similarity with text ``i`` is at least
    ``threshold``.  ``right`` None: pairs inside ``left``."""
    sig, size = signatures(h, off), np.diff(off)
    local = np.unique(h, return_inverse=True)[1]
    seen = np.zeros(len(h) + 1, bool)
    steps = [(a, min(a + STEP, sig.shape[1])) for a in range(0, sig.shape[1], STEP)]
    need = [least_matches(b, threshold, tolerance) for _, b in steps]
    for at, i in enumerate(left):
        js = left[at + 1:] if right is None else right
        if not size[i] or not len(js):
            continue
        small, big = np.minimum(size[js], size[i]), np.maximum(size[js], size[i])
        js = js[small >= threshold * big - 1e-9]  # no overlap can make up for the sizes
        got = np.zeros(len(js), np.int64)
        for (a, b), k in zip(steps, need):
            got += (sig[js, a:b] == sig[i, a:b]).sum(1)
            js, got = js[got >= k], got[got >= k]
            if not len(js):
                break
        if not len(js):
            continue
        mine = local[off[i]:off[i + 1]]
        seen[mine] = True
        both = np.array([np.count_nonzero(seen[local[off[j]:off[j + 1]]]) for j in js])
        seen[mine] = False
        # in whole numbers: both / (union) >= threshold
        hit = both * 1000000 >= round(threshold * 1000000) * (size[i] + size[js] - both)
        if hit.any():
            yield i, js[hit]


def _row_key(id_col: Column, text: Column) -> Column:
    return F.xxhash64(id_col.cast("string"), text)


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """Row table ``k, doc_id, node`` and text table ``node, nid, rep, rep_id, copies, label,
    links, text_links`` (see :func:`near_duplicates` for their meaning)."""
    spark = docs.sparkSession
    prepare(spark)
    text = text_or_empty(text_col)
    base = docs.select(docs[id_col].alias("doc_id"), text.alias("text")).select(
        _row_key(F.col("doc_id"), F.col("text")).alias("k"), "doc_id", "text")
    id_type = docs.schema[id_col].dataType.simpleString()

    def propose(batches):
        for b in batches:
            texts = split_words(b.column(2))
            sig = band_keys(signatures(*shingle_sets(texts)))
            node = [hashlib.md5(b" ".join(t)).digest() if t else None for t in texts]
            keys = pa.ListArray.from_arrays(
                pa.array(np.arange(0, sig.size + 1, BANDS), pa.int32()), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(node, pa.binary()), keys], ["k", "doc_id", "node", "bands"])

    rows = saved(base.mapInArrow(propose, f"k long, doc_id {id_type}, node binary, bands array<long>"), "jac-rows")
    # one row per distinct word sequence; a text without words has no shingles and no links
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "bands"))
    texts = rows.where("node is not null").groupBy("node").agg(
        first.alias("f"), F.count(F.lit(1)).alias("copies"))
    texts = saved(texts.select("node", F.monotonically_increasing_id().alias("nid"), F.col("f.k").alias("rep"),
                               F.col("f.doc_id").alias("rep_id"), "copies", F.col("f.bands").alias("bands")), "jac-texts")
    keys = texts.select("nid", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a < z")
    family = saved(components(keys.join(shared.select("key", "a"), "key").where("nid <> a")
                              .select("a", F.col("nid").alias("b"))), "jac-family")
    sizes = family.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    place = (family.join(sizes, "label").join(texts.select(F.col("nid").alias("node"), "rep", "copies"), "node")
             .select("rep", F.col("node").alias("nid"), "copies", "label", "blocks",
                     F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")))
    place = saved(place, "jac-place")
    # every text meets the texts of each block once: one row per block of its family
    meet = (base.select("k", "text").dropDuplicates(["k"]).join(place, F.col("k") == F.col("rep"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("label", F.least("own", "other").cast("int").alias("i"),
                    F.greatest("own", "other").cast("int").alias("j"), "own", "nid", "copies", "text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j")

    def compare(batches):
        group, key = [], None
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:6]] + [b.column(6).cast(pa.binary()).to_pylist()]
            out = []
            for r in zip(*cols):
                if r[:3] != key:
                    if group:
                        out += _compare_group(group, key, threshold, tolerance)
                    group, key = [], r[:3]
                group.append(r[3:])
            yield _links_batch(out)
        if group:
            yield _links_batch(_compare_group(group, key, threshold, tolerance))

    links = saved(meet.mapInArrow(compare, "nid long, peer long, links long, text_links long"), "jac-links")
    counts = (links.where("peer is null").groupBy(F.col("nid").alias("c_nid"))
              .agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links")))
    classes = components(links.where("peer is not null").select(F.col("nid").alias("a"), F.col("peer").alias("b")))
    texts = (texts.drop("bands").join(counts, F.col("nid") == F.col("c_nid"), "left")
             .join(classes.withColumnRenamed("node", "c_node"), F.col("nid") == F.col("c_node"), "left"))
    texts = texts.select("node", "nid", "rep", "rep_id", "copies", F.coalesce("label", "nid").alias("label"),
                         F.coalesce("links", F.lit(0)).alias("links"),
                         F.coalesce("text_links", F.lit(0)).alias("text_links"))
    return rows.drop("bands"), saved(texts, "jac-classes")


def _compare_group(group: list, key: tuple, threshold: float, tolerance: float) -> list:
    """Rows ``(nid, peer, links, text_links)`` of one meeting of two blocks."""
    own = np.array([g[0] for g in group])
    nid, copies = [g[1] for g in group], np.array([g[2] for g in group], np.int64)
    h, off = shingle_sets([g[3].split() for g in group])
    left = np.flatnonzero(own == key[1])
    right = None if key[1] == key[2] else np.flatnonzero(own == key[2])
    links, texts = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    up, out = list(range(len(group))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, js in linked_pairs(h, off, left, right, threshold, tolerance):
        links[i] += copies[js].sum()
        texts[i] += len(js)
        links[js] += copies[i]
        texts[js] += 1
        for j in js.tolist():
            a, b = root(i), root(j)
            if a != b:
                up[a] = b
                out.append((nid[i], nid[j], None, None))
    out += [(nid[i], None, int(links[i]), int(texts[i])) for i in np.flatnonzero(texts)]
    return out


def _links_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                      ["nid", "peer", "links", "text_links"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``doc_id, class_id, n_links, n_text_links, kept`` per input row.

    ``class_id``: smallest id of the row's class (rows connected by links; null ids last).
    ``n_links``: other rows of similarity ``threshold`` or more, equal texts included;
    ``n_text_links``: distinct other texts among them.  ``kept`` marks one row per class (smallest
    id).  A null text counts as empty; a text without words has no links and is its own class.
    Repeated rows count as rows; an empty table gives no rows; other columns are ignored.
    """
    rows, texts = similar_texts(docs, id_col, text_col, **kw)
    first = F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep"))
    heads = texts.groupBy("label").agg(first.alias("f")).select(
        F.col("label").alias("h_label"), F.col("f.rep_id").alias("class_id"), F.col("f.rep").alias("head"))
    t = (texts.join(heads, F.col("label") == F.col("h_label"))
         .select(F.col("node").alias("t_node"), "class_id", "head", "copies", "links", "text_links"))
    repeated = rows.groupBy("k", "doc_id", "node").agg(F.count(F.lit(1)).alias("c"))
    out = (repeated.join(t, F.col("node") == F.col("t_node"), "left")
           .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c")))))
    return out.select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
        (F.col("node").isNull() | ((F.col("k") == F.col("head")) & (F.col("copy") == 1))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, one per class, with all their columns; rows without words
    stay as they are."""
    rows, texts = similar_texts(docs, id_col, text_col, **kw)
    first = F.min(F.struct(F.col("rep_id").isNull().alias("no_id"), "rep_id", "rep"))
    heads = texts.groupBy("label").agg(first.alias("f")).select(F.col("f.rep").alias("h_k"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                         _row_key(docs[id_col], text_or_empty(text_col)).alias("k"))
    has_words = F.length(F.translate(text_or_empty(F.col(f"row.{text_col}")), " \t\n\x0b\f\r", "")) > 0
    stay = (packed.where(has_words).join(heads, F.col("k") == F.col("h_k"), "left_semi")
            .dropDuplicates(["k"]))
    return stay.unionByName(packed.where(~has_words)).select("row.*")
