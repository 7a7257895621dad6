"""Operators on texts against brute force, on small inputs with every awkward case."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slicewise.llm import bpe, brown, exact_dedup, jaccard, mixing, quality_rules, rlz, suffix
from slicewise.llm.common import prepare
from slicewise.llm.queries import vocabulary_path
from tests.llm.helpers import CLASH, DOC_SCHEMA, documents, empty, hard_texts, rows_of

WS = str.maketrans("", "", " \t\n\x0b\f\r")


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "clashing-columns"])
def docs(request, spark):
    prepare(spark)
    return documents(spark, clash=request.param).cache()


@pytest.fixture(scope="module")
def local(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def words(t):
    return (t or "").encode().split()


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- op7 ------------------------------------------------------------------------------------


def expected_groups(local):
    groups = {}
    for i, t in local:
        groups.setdefault((t or "").translate(WS), []).append((-len(t or ""), i is None, i if i is not None else 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        left = 1
        for m in members:
            kept = left == 1 and m[:3] == best[:3]
            left -= kept
            out.append((m[3], best[3], len(members), kept, sha(norm.encode())))
    return out


def test_exact_groups(docs, local):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows_of(exact_dedup.exact_groups(docs), cols) == sorted(expected_groups(local), key=key)


def test_exact_groups_survive_hash_collisions(docs, local):
    weak = lambda c: F.unhex(F.lit("00"))  # noqa: E731  every text collides
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows_of(exact_dedup.exact_groups(docs, hash_fn=weak), cols) == sorted(expected_groups(local), key=key)


def test_drop_exact_copies(docs, local):
    out = exact_dedup.drop_exact_copies(docs)
    assert out.columns == docs.columns
    kept = [(r[0], r[4]) for r in expected_groups(local) if r[3]]
    got = [(r["doc_id"], sha((r["text"] or "").translate(WS).encode())) for r in out.collect()]
    assert sorted(got, key=str) == sorted(kept, key=str)


# ---- op9 ------------------------------------------------------------------------------------


def test_mixing(docs, local):
    d = mixing.with_copies(docs)
    rows = d.collect()
    assert len(rows) == len(local)
    sizes = Counter()
    for r in docs.select("doc_id", "text", "source").collect():
        sizes[r["source"]] += len(words(r["text"]))
    # the water filling, step by step
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    left = float(total)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    by_size = {}
    for r in rows:
        by_size.setdefault((r["source_size"], round(r["target"], 6)), []).append(r)
    assert {(sizes[s], round(target[s], 6)) for s in order} == set(by_size)
    for (n, t), rs in by_size.items():
        longest = max(r["size"] for r in rs)
        assert abs(sum(r["copies"] * r["size"] for r in rs) - t * len({s for s in order if sizes[s] == n})) <= 2 * longest
        assert all(0 <= r["copies"] <= 3 for r in rs)
    again = mixing.with_copies(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_returns_documents(docs):
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == mixing.with_copies(docs).agg(F.sum("copies")).first()[0]


# ---- op4 ------------------------------------------------------------------------------------


def expected_stats(t):
    t = t or ""
    w = words(t)
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if c[tuple(w[i:i + 5])] > 1:
            hit.update(range(i, i + 5))
    lines = [x for x in t.split("\n") if x.translate(WS)]
    return (len(w), sum(len(x.decode()) for x in w), sum(x in "#*$%&|<>" for x in t),
            len(lines) - len(set(lines)), len(hit))


def test_text_stats(docs, local):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    want = sorted(((i, *expected_stats(t)) for i, t in local), key=key)
    assert rows_of(quality_rules.text_stats(docs), cols) == want


def test_learned_rules(spark):
    rows, labels = [], []
    for i in range(900):
        bad = i % 3 == 0
        body = " ".join("word%d%s" % ((i * 31 + j * 7) % 997, "***" if bad else "") for j in range(40))
        rows.append((i, body, "en", "s", 0))
        labels.append((i, None if i % 50 == 1 else int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_rules.judge(docs, lab)
    assert out.where("kept = (doc_id % 3 = 0)").count() == 0
    assert "reject if" in str(quality_rules.learn_rules(quality_rules.text_stats(docs), lab))
    kept = quality_rules.drop_rejected(docs, lab)
    assert kept.columns == docs.columns and kept.count() == 600
    # no labels: only the base rule decides
    none = quality_rules.judge(docs, lab.where("false"))
    assert none.where("kept = base_failed").count() == 0


# ---- op3 ------------------------------------------------------------------------------------


def test_bpe_matches_the_tokenizers_library(docs, local):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want = []
    for i, x in local:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False).encode())))
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    got = bpe.encode(docs, vocabulary_path(), digest=True)
    assert rows_of(got, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=key)
    full = bpe.encode(docs, vocabulary_path())
    again = bpe.decode(full, vocabulary_path())
    assert rows_of(full, ["doc_id", "decoded"]) == rows_of(again, ["doc_id", "decoded"])


def test_bpe_on_every_script():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary_path())
    with open(vocabulary_path(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    points = [c for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000]
    texts = ["".join("a%sB " % chr(c) for c in points[i:i + 200]) for i in range(0, len(points), 200)]
    texts += ["aaaaaaaaaaaaaaaaaaaa" * 3, "ΣΑΣ İ it'S <|endoftext|><|endoftext"]
    for x, got in zip(texts, v.encode_texts(texts)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


# ---- op2, op6 -------------------------------------------------------------------------------


@pytest.mark.parametrize("window,gram", [(35, 10), (6, 3)])
def test_rlz_removes_exactly_the_repeated_windows(docs, local, window, gram):
    c = Counter(tuple(w[i:i + window]) for _, t in local for w in [words(t)] for i in range(len(w) - window + 1))
    want = []
    for i, t in local:
        w, hit = words(t), set()
        for s in range(len(w) - window + 1):
            if c[tuple(w[s:s + window])] > 1:
                hit.update(range(s, s + window))
        want.append((i, len(w), len(hit), sha(b" ".join(x for j, x in enumerate(w) if j not in hit))))
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    got = rlz.remove_repeats(docs, digest=True, window=window, gram=gram)
    assert rows_of(got, ["doc_id", "n_words", "n_removed", "kept_sha256"]) == sorted(want, key=key)


@pytest.mark.parametrize("visit_bytes,block_bytes", [(rlz.VISIT_BYTES, rlz.BLOCK_BYTES), (400, 300)])
def test_rlz_factors_are_longest_at_their_place(spark, monkeypatch, visit_bytes, block_bytes):
    """Also with many small blocks that go to several tasks each."""
    monkeypatch.setattr(rlz, "VISIT_BYTES", visit_bytes)
    monkeypatch.setattr(rlz, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(5)
    passages = [rng.integers(0, 50, 90).tolist() for _ in range(4)]
    texts = []
    for i in range(40):
        p = passages[i % 4][rng.integers(0, 20):rng.integers(60, 91)]
        texts.append((i, " ".join(map(str, rng.integers(100 * i + 100, 100 * i + 200, 15).tolist() + p
                                      + rng.integers(100 * i + 100, 100 * i + 200, 15).tolist()))))
    texts += [(40, None), (41, ""), (42, "7 " * 80), (43, texts[0][1])]
    by_id = {i: (t or "").split() for i, t in texts}
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = rlz.factor_table(table).collect()
    covered = {i: set() for i in by_id}
    for f in got:
        w, r, s, e, j = by_id[f.doc_id], by_id[f.ref_id], f.start, f.start + f.length, f.ref_start
        assert w[s:e] == r[j:j + f.length] and f.length >= rlz.WINDOW and (f.doc_id, s) != (f.ref_id, j)
        assert s == 0 or j == 0 or w[s - 1] != r[j - 1]
        assert e == len(w) or j + f.length == len(r) or w[e] != r[j + f.length]
        covered[f.doc_id].update(range(s, e))
    assert len({f.block for f in got}) > (1 if block_bytes == 300 else 0)
    assert covered[0] == set(range(len(by_id[0]))) and covered[42] == set(range(80))
    assert all(f.doc_id not in (40, 41) for f in got)
    # factors cover repeated words only; the other repeated windows come from the factors' boundaries
    c = Counter(tuple(w[i:i + 35]) for w in by_id.values() for i in range(len(w) - 34))
    again = {i: {j for s in range(len(w) - 34) if c[tuple(w[s:s + 35])] > 1 for j in range(s, s + 35)} for i, w in by_id.items()}
    assert all(covered[i] <= again[i] for i in by_id)
    whole = {r.doc_id: {j for s, e in zip(r.starts or [], r.ends or []) for j in range(s, e)} for r in rlz.parse(table).collect()}
    assert whole == again


def later_bytes(local, length):
    order = sorted(local, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = set(), []
    for i, t in order:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                hit[s:s + length] = b"\1" * length
            seen.add(x)
        runs = sum(1 for j in range(len(b)) if hit[j] and (j == 0 or not hit[j - 1]))
        out.append((i, len(b), sum(hit), runs, sha(bytes(c for c, h in zip(b, hit) if not h))))
    return out


@pytest.mark.parametrize("length,gram,wide", [(100, 64, 2000), (100, 32, 1), (17, 5, 2000)])
def test_suffix_arrays_remove_exactly_the_later_bytes(docs, local, length, gram, wide, monkeypatch):
    monkeypatch.setattr(suffix, "WIDE", wide)  # 1: every shared anchor takes the hashed way
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    got = suffix.remove_repeats(docs, digest=True, length=length, gram=gram)
    assert rows_of(got, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) == sorted(
        later_bytes(local, length), key=key)


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(5)
    for symbols in (1, 2, 4, 30):
        for n in (1, 2, 3, 10, 200):
            t = np.r_[rnd.integers(1, symbols + 1, n), 0].astype(np.uint16)
            assert suffix.suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())


def test_long_texts_are_looked_at_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(suffix, "TILE", 700)
    monkeypatch.setattr(suffix, "SEEN_BITS", 64)  # a full bitmap lets every anchor through
    texts = hard_texts()
    d = documents(spark, texts)
    local = [(r["doc_id"], r["text"]) for r in d.collect()]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows_of(suffix.remove_repeats(d, digest=True), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) \
        == sorted(later_bytes(local, 100), key=key)


# ---- op5 ------------------------------------------------------------------------------------


def jaccard_truth(local):
    def shingles(t):
        w = words(t)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    s = [shingles(t) for _, t in local]
    n = len(s)
    link = [[False] * n for _ in range(n)]
    for a in range(n):
        for b in range(a):
            if s[a] and s[b] and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b]):
                link[a][b] = link[b][a] = True
    cls = list(range(n))
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if link[a][b]:
                    cls[a] = cls[b] = min(cls[a], cls[b])
    ids = {}
    for a in range(n):
        ids.setdefault(cls[a], []).append(local[a][0])
    return [(local[a][0], min((x for x in ids[cls[a]] if x is not None), default=None), sum(link[a])) for a in range(n)]


@pytest.mark.parametrize("block", [256, 2])
def test_near_duplicates(docs, local, block, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", block)  # 2: families span many blocks
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    got = jaccard.near_duplicates(docs)
    assert rows_of(got, ["doc_id", "class_id", "n_links"]) == sorted(jaccard_truth(local), key=key)
    with_words = [r for r in got.collect() if r["kept"]]
    classes = {t[1] for (i, x), t in zip(local, jaccard_truth(local)) if words(x)}
    assert len(with_words) == len(classes) + sum(not words(x) for _, x in local)


def test_drop_near_duplicates(docs, local):
    out = jaccard.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    classes = {t[1] for (i, x), t in zip(local, jaccard_truth(local)) if words(x)}
    assert out.count() == len(classes) + sum(not words(x) for _, x in local)


def test_bayesian_pruning_bound():
    # more matches needed for a looser tolerance, none at no tolerance; all matching always stays
    assert jaccard.least_matches(34, 0.8, 0.0) == 0
    need = [jaccard.least_matches(n, 0.8, 1e-6) for n in (34, 68, 102, 136, 170)]
    assert need == sorted(need) and all(k <= 0.8 * n for k, n in zip(need, (34, 68, 102, 136, 170)))


# ---- op1 ------------------------------------------------------------------------------------


def test_brown_scores(docs, local):
    got = brown.score_held_out(docs, classes=6, rounds=3, cluster_words=50, head_words=80).collect()
    toks = [(i, [*(t or "").encode().lower().split(), b"\n"]) for i, t in local]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(t), sum(c[w] > 0 for w in t),
                   round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5), held(i)) for i, t in toks)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5), r["held_out"]) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)


def test_brown_probabilities_sum_to_one(docs):
    m = brown.fit(docs, classes=6, rounds=3, cluster_words=50, head_words=80)
    assert np.allclose((10 ** m.log_trans).sum(1), 1)
    # every class's words, its unknown event included
    k, mass = len(m.log_trans), np.zeros(len(m.log_trans))
    np.add.at(mass, m.head_class, 10 ** m.log_emit)
    first = m.end_class - brown.ENDINGS
    for r in m.counts.select(brown.ending_column(F.col("word")).alias("e"), "c").collect():
        mass[first + r["e"]] += (r["c"] - brown.DISCOUNT) / m.ending_n[r["e"]]
    for e in range(brown.ENDINGS):
        mass[first + e] += brown.DISCOUNT * m.ending_v[e] / m.ending_n[e] if m.ending_v[e] else 1
    used = np.unique(m.head_class)
    assert np.allclose(mass[used], 1) and np.allclose(mass[first:k - 1], 1)
    assert max(m.likelihood) >= m.likelihood[0]


def test_brown_finds_classes(spark):
    import random
    rnd = random.Random(4)
    animals, verbs = ["cat", "dog", "cow", "hen"], ["runs", "eats", "sits", "naps"]
    rows = [(i, " ".join("%s %s" % (rnd.choice(animals), rnd.choice(verbs)) for _ in range(30)), None, "s", 0)
            for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    m = brown.fit(d, classes=2, rounds=16, cluster_words=20, head_words=20)
    of = {w: m.head_class[m.head[w.encode()]] for w in animals + verbs}
    assert len({of[a] for a in animals}) == 1 and {of[a] for a in animals}.isdisjoint({of[v] for v in verbs})
    held = brown.score_held_out(d, classes=2, rounds=16, cluster_words=20, head_words=20).where("held_out").collect()
    assert held and all(r["score"] > r["base_score"] for r in held)


def class_texts(spark):
    import random
    rnd = random.Random(4)
    animals, verbs = ["animal%d" % i for i in range(30)], ["verb%d" % i for i in range(30)]
    rows = [(i, " ".join("%s %s" % (rnd.choice(animals), rnd.choice(verbs)) for _ in range(60)), None, "s", 0)
            for i in range(60)]
    return spark.createDataFrame(rows, DOC_SCHEMA), animals, verbs


def found_classes(m, words_):
    of = {bytes(r["word"]): r["klass"] for r in m.counts.collect()} | {w: m.head_class[i] for w, i in m.head.items()}
    return {of[w.encode()] for w in words_}


def test_brown_clusters_every_known_word(spark):
    # only 8 words in the core, 20 in the head: the others must get learned classes, too
    d, animals, verbs = class_texts(spark)
    m = brown.fit(d, classes=2, core_words=8, head_words=20)
    assert m.counts.count() == 40
    a, v = found_classes(m, animals), found_classes(m, verbs)
    assert len(a) == len(v) == 1 and a != v and a | v == {0, 1}
    # emissions of a class and its unknown event, and transitions, sum to 1
    mass = np.zeros(len(m.log_trans))
    np.add.at(mass, m.head_class, 10 ** m.log_emit)
    for r in m.counts.collect():
        mass[r["klass"]] += (r["c"] - brown.DISCOUNT) / m.mass[r["klass"]]
    assert np.allclose(mass[[0, 1, m.end_class]], 1) and np.allclose((10 ** m.log_trans).sum(1), 1)
    # by hand: every score from the model's own tables
    c = {bytes(r["word"]): (r["klass"], math.log10((r["c"] - brown.DISCOUNT) / m.mass[r["klass"]])) for r in m.counts.collect()}
    c |= {w: (m.head_class[i], m.log_emit[i]) for w, i in m.head.items()}
    texts = [(i, t) for i, t in enumerate(["animal1 verb2 animal3 unknown animal29 verb29", "", "animal5 animal5 new new,"])]
    e = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in brown.score(e, m).collect()}
    for i, t in texts:
        prev, want = m.end_class, 0.0
        for w in [*t.encode().split(), b"\n"]:
            k, emit = c.get(w, (m.end_class - brown.ENDINGS + int(brown._ENDING[w[-1]]), 0.0))
            want, prev = want + m.log_trans[prev, k] + emit, k
        assert abs(got[i] - want) < 1e-6


def test_brown_every_word_has_its_turn():
    ids = np.arange(2048)
    for cycle in range(3):
        turns = sum(brown._turn(ids, cycle * brown.SHARES + i).astype(int) for i in range(brown.SHARES))
        assert (turns == 1).all()


def test_brown_head_is_full_for_like_counts(spark):
    w = spark.range(500).select(F.col("id").cast("string").cast("binary").alias("word"), F.lit(1000).alias("c"))
    w = w.withColumn("bin", F.floor(F.log2("c") * 8).cast("int")).withColumn("key", brown.tail_key(F.col("word")))
    for most in (0, 1, 120, 499, 500, 600):
        assert w.where(brown.most_frequent(w, most)).count() == min(most, 500)


def test_mixing_spreads_one_source_of_one_size(spark):
    d = spark.range(200_000).select(F.lit("web").alias("source"), F.lit(300).alias("size"),
                                    F.md5(F.col("id").cast("string")).alias("key"))
    assert mixing.with_cell(d).groupBy(mixing.CELL).count().agg(F.max("count")).first()[0] <= 200_000 // 8_000


# ---- empty tables ---------------------------------------------------------------------------


def test_empty_tables(spark):
    e = empty(spark)
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert exact_dedup.exact_groups(e).count() == 0 and exact_dedup.drop_exact_copies(e).count() == 0
    assert mixing.with_copies(e).count() == 0 and mixing.mix(e).count() == 0
    assert quality_rules.judge(e, lab).count() == 0 and quality_rules.drop_rejected(e, lab).count() == 0
    assert bpe.encode(e, vocabulary_path(), digest=True).count() == 0
    assert rlz.remove_repeats(e, digest=True).count() == 0
    assert suffix.remove_repeats(e, digest=True).count() == 0
    assert jaccard.near_duplicates(e).count() == 0 and jaccard.drop_near_duplicates(e).count() == 0
    assert brown.score_held_out(e).count() == 0


def test_clash_list_is_not_empty():
    assert len(CLASH) > 10


@pytest.mark.parametrize("wide", [2, 2000])
def test_anchors_sorted_in_small_chunks(spark, monkeypatch, wide):
    for name, value in (("WIDE", wide), ("HELD", 40), ("CHUNK", 7), ("SEEN_BITS", 1 << 17)):
        monkeypatch.setattr(suffix, name, value)
    texts = hard_texts()
    d = documents(spark, texts)
    local = [(r["doc_id"], r["text"]) for r in d.collect()]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows_of(suffix.remove_repeats(d, digest=True), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) \
        == sorted(later_bytes(local, 100), key=key)


def test_copies_in_a_task_are_not_sent_anchor_by_anchor(spark):
    text = " ".join(str(i * i) for i in range(400))
    base = spark.range(50).coalesce(1).select(F.col("id").alias("k"), F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    rows = suffix._spans(base, 100, 64)
    first = rows.where("k = 0").count()
    assert first > 10 and rows.count() == first + 49
