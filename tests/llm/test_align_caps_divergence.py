"""Alignment, vector filters and source divergence against brute force on small inputs."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from slicewise.llm import align, caps, divergence
from slicewise.llm.common import prepare
from tests.llm.helpers import CLASH, documents, empty, hard_texts, rows_of

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
VEC = "vec_id long, embedding array<float>, label int"


# ---- op11 -----------------------------------------------------------------------------------


def odd_texts():
    rnd = random.Random(3)
    chars = list("ab e\n\t'sé字 ▁ .,0\x00\x1c　\xa0\U0001F600<") + ["<|endoftext|>", "<s>", "<0x41>", "  ", " the", "ing", "<unk>"]
    made = ["".join(rnd.choice(chars) for _ in range(rnd.randint(1, 60))) for _ in range(150)]
    return hard_texts() + made + [" ", "  ", " a", "a ", "a  b", "x▁y", "\n", "字" * 3000, "a" * 4000, "it's we'll 's", "a " * 9000]


def tokens_of(text):
    """Tokens with their bytes, by encoding the whole text at once; None without tokens."""
    if not text:
        return None
    a, b = align.ByteBpe(A_PATH), align.Pieces(B_PATH)
    return text, a, b


def brute_alignment(rows):
    a_bpe, b_bpe = align.ByteBpe(A_PATH), align.Pieces(B_PATH)
    found = []
    for _, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            a, b = a_bpe.encode([text])[0], b_bpe.encode([text])[0]
            raw = (" " + text).encode()
            if b"".join(a_bpe.bytes[i] for i in a) != raw or b"".join(b_bpe.bytes[i] for i in b) != raw:
                a, b = [], []
        spans = []
        for ids, coder in ((a, a_bpe), (b, b_bpe)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(coder.bytes[i])))
                at += len(coder.bytes[i])
            spans.append(out)
        j = 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(b) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        last = 0
        for c in cuts:
            groups.append("|".join(",".join(str(t) for t, (s, e) in zip(ids, sp) if last <= s and e <= c)
                                   for ids, sp in ((a, spans[0]), (b, spans[1]))) if len(a) < 3000 else None)
            last = c
        found.append((len(a), len(b), len(cuts), links, groups))
    count = Counter(p for f in found for p in set(f[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (i, _), (na, nb, ng, links, groups) in zip(rows, found):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups and None not in groups else ("" if not groups else None)
        out.append((i, na, nb, ng, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), digest))
    return out


COLS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("block", [align.BLOCK_CHARS, 2000])
def test_alignment(spark, monkeypatch, clash, block):
    if clash and block == 2000:
        pytest.skip("one of the two is enough")
    monkeypatch.setattr(align, "BLOCK_CHARS", block)
    monkeypatch.setattr(align, "LANE", 64)
    docs = documents(spark, odd_texts(), clash=clash).cache()
    local = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(align.align(docs.repartition(3), A_PATH, B_PATH), COLS)
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    want = brute_alignment(local)
    assert len(got) == len(want)
    plain = lambda rows: sorted((r[:-1] for r in rows), key=key)
    assert plain(got) == plain(want)
    digests = Counter(w[-1] for w in want if w[-1] is not None)
    have = Counter(g[-1] for g in got)
    assert all(have[d] >= n for d, n in digests.items())
    assert sum(1 for w in want if w[1]) > 100


def test_alignment_of_nothing(spark):
    assert align.align(empty(spark), A_PATH, B_PATH).count() == 0
    out = align.align(documents(spark, [None, "", "▁"]), A_PATH, B_PATH).collect()
    assert len(out) == 3 and all(r["n_a"] == 0 and r["groups_sha256"] == "" and r["count_sum"] == 0 for r in out)


def test_lockstep_is_a_merge():
    """Links are the overlaps, cuts the common ends, whatever the lanes hold."""
    rnd = np.random.default_rng(5)
    ends, lanes = [[], []], [[0], [0]]
    want_links, want_cuts = [], []
    for _ in range(50):
        n = int(rnd.integers(1, 40))
        own = [np.unique(np.append(rnd.integers(1, n + 1, rnd.integers(0, n)), n)) for _ in (0, 1)]
        for i, x in enumerate(own[0]):
            for j, y in enumerate(own[1]):
                if max([0, *own[0]][i], [0, *own[1]][j]) < min(x, y):
                    want_links.append((lanes[0][-1] + i, lanes[1][-1] + j))
                if x == y:
                    want_cuts.append((lanes[0][-1] + i, lanes[1][-1] + j))
        for k in (0, 1):
            ends[k] += own[k].tolist()
            lanes[k].append(len(ends[k]))
    a, b, ca, cb = align.lockstep(*[np.array(x) for x in (ends[0], lanes[0], ends[1], lanes[1])])
    assert sorted(zip(a.tolist(), b.tolist())) == want_links and sorted(zip(ca.tolist(), cb.tolist())) == want_cuts


# ---- op12 -----------------------------------------------------------------------------------


def brute_links(rows, threshold=caps.THRESHOLD):
    """``n_links, component`` per row, in the order of the rows."""
    ok = [v is not None and lab is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
          for _, v, lab in rows]
    near = [[] for _ in rows]
    for i, (_, v, lab) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows):
            if i != j and ok[i] and ok[j] and lab == other and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].append(j)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return out


def hard_vectors():
    rnd = np.random.default_rng(2)
    rows = []
    for c in range(12):  # clusters around a centre, chains that turn slowly, copies and multiples
        x, y = rnd.standard_normal((2, 16))
        rows += [((x + rnd.standard_normal(16) * 0.08 * rnd.random()).tolist(), c % 3) for _ in range(9)]
        rows += [((x * np.cos(t) + y * np.sin(t)).tolist(), c % 3) for t in np.arange(0, 1.2, 0.15)]
        rows += [(x.tolist(), c % 3), (x.tolist(), c % 3), ((x * 1e-3).tolist(), c % 3), ((-x).tolist(), c % 3), (x.tolist(), None)]
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([float("nan")] + [1.0] * 15, 1),
             ([float("inf")] + [1.0] * 15, 1), ([1.0], 1), ([2.0], 1), ([-1.0], 1), ([1.0, 1.0], 1), ([1.0, 1.01], 1),
             ([1.0, 0.0, 0.0], 2), ([1.0, 0.01, 0.0], 2), ([3e38] * 16, 2), ([1e-38] * 16, 2), ([1e-44] * 16, 2)]
    out = [(i * 37 % 1009, v, lab) for i, (v, lab) in enumerate(rows)]
    return out + [out[3], out[3], (None, out[3][1], out[3][2]), (None, [0.5] * 15 + [-9.0], 0)]


VCOLS = ["vec_id", "n_links", "component_id", "kept"]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("rows", [caps.BLOCK_ROWS, 3])
def test_near_vectors(spark, monkeypatch, clash, rows):
    monkeypatch.setattr(caps, "BLOCK_ROWS", rows)
    local = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in hard_vectors()]
    df = spark.createDataFrame(local, VEC)
    for c in CLASH if clash else []:
        if c != "label":
            df = df.withColumn(c, F.lit(None).cast("string"))
    want = [(i, n, c, i == c) for i, n, c in brute_links(local)]
    key = lambda t: tuple((x is not None, str(x)) for x in t)
    assert rows_of(caps.near_vectors(df.repartition(4)), VCOLS) == sorted(want, key=key)
    assert caps.near_vectors(df.where("false")).count() == 0


def test_directions_are_those_above_the_bound():
    """List decoding finds exactly the directions whose cosine reaches the bound."""
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = caps.ProductCode(24, 400, 0)
    row, key = code.decode(x)
    y = code.rotated(x)
    assert np.allclose(np.linalg.norm(y, axis=1), 1)
    words = [len(w) for w in code.words]
    whole = np.stack([np.concatenate([w[k] for w, k in zip(code.words, np.unravel_index(c, words))]) for c in range(code.size)])
    assert np.allclose(np.linalg.norm(whole, axis=1), 1)
    want = np.argwhere(y @ whole.T >= code.bound)
    assert sorted(zip(row.tolist(), key.tolist())) == [tuple(x) for x in want.tolist()]
    assert 0.4 * caps.HITS < len(row) / 40 < 2.5 * caps.HITS


def test_recall_of_links_at_the_threshold(spark):
    """Pairs that lie just above the threshold, among vectors at large."""
    rnd = np.random.default_rng(8)
    n, d = 3000, 64
    x = rnd.standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rnd.standard_normal((n, d))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.9805 * x + np.sqrt(1 - 0.9805**2) * z
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    out = {r["vec_id"]: r for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(out[n + i]["component_id"] == i and out[i]["n_links"] >= 1 for i in range(n)) / n
    print("recall just above the threshold:", found)
    assert found >= 0.99


# ---- op13 -----------------------------------------------------------------------------------


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute_divergence(rows, min_df, top=10):
    docs = [(lang or "", source or "", terms_of(text)) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in df.items() if n >= min_df), key=lambda t: t.encode())
        v, sources = len(kept), sorted({d[1] for d in own}, key=lambda s: s.encode())

        def p_of(select):
            c = Counter(t for d in own if select(d) for t in d[2] if df[t] >= min_df)
            n = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        by = {s: p_of(lambda d, s=s: d[1] == s) for s in sources}
        _, q = p_of(lambda d: True)
        for s in sources:
            pairs = [(o, sum(f(by[s][1][t], by[o][1][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(by[s][1][t], q[t])) for t in kept if by[s][0][t] > 0 and by[s][1][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


DCOLS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("clash", [False, True])
def test_divergence(spark, clash):
    prepare(spark)
    rnd = random.Random(9)
    texts = hard_texts() + ["AZ\x00az[Été`字{ÀB@c" + " T%s" % "xyzÄ"[i % 4] * (i % 5) for i in range(40)]
    rows = [(rnd.choice(["en", "EN", None, "", "字"]), rnd.choice(["a", "b", "ä", "Z", None, ""]), t) for t in texts * 2]
    rows += [("xx", "lonely", "few words here"), ("xx", "other", None), ("one", "only", "w " * 50)] + [("one", "only", "w")] * 12
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for c in [*CLASH, "v", "p0", "c", "term", "vec", "terms", "value", "rank"] if clash else []:
        df = df.withColumn(c, F.lit(None).cast("string"))
    got = sorted(tuple(r[c] for c in DCOLS) for r in divergence.divergence(df.repartition(3)).collect())
    want = brute_divergence(rows, divergence.MIN_DF)
    assert got == want and len(want) > 100
    assert any(r[2] == "pair" and r[0] == "xx" and r[4] == 0 for r in got)
    assert divergence.divergence(df.where("false")).count() == 0


def test_divergence_of_other_sizes(spark):
    rows = [("en", "s%d" % (i % 3), " ".join("w%s" % "abcdefgh"[(i * j) % 8] for j in range(i % 7))) for i in range(60)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    for min_df, top in ((1, 3), (5, 100), (1000, 10)):
        got = sorted(tuple(r[c] for c in DCOLS) for r in divergence.divergence(df, min_df, top).collect())
        assert got == brute_divergence(rows, min_df, top)


def test_vectors_are_summed_without_being_written(spark, monkeypatch):
    """op13: a language's vectors go from its model to the sums within a task; only models and sums are written."""
    import os

    rows = [("en", s, f"alpha {s} beta alpha") for s in ("web", "books") for _ in range(6)] + [("de", "web", "eins"), ("", "web", "x")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    folders = []
    monkeypatch.setattr(divergence, "scratch_path", lambda spark, name, old=divergence.scratch_path: folders.append(old(spark, name)) or folders[-1])
    got = {(r["lang"], r["source"], r["term"]): r["c"] for r in divergence.term_counts(docs, 10).collect()}
    assert got == {("en", s, t): c for s in ("web", "books") for t, c in (("alpha", 12), ("beta", 6))}
    assert sorted(os.listdir(folders[0].replace("file:", "", 1))) == ["model0", "sums0"]
    sums = spark.read.parquet(f"{folders[0]}/sums0")
    assert sums.columns == ["lang", "source", "term", "c"] and sums.count() == 4


def test_shares_are_exact_on_both_sides_of_the_long_range(spark):
    """Counts that a scaled long holds need no decimals; larger ones still do."""
    last = divergence.LONG_COUNT
    rows = [(c, n, v) for c in (0, 1, last - 1, last, last + 1, 10**15) for n, v in ((c + 7, 3), (10**16, 10**6))]  # a group has its term's count at least
    df = spark.createDataFrame(rows, "c long, n long, v long").withColumn("p", divergence._p("c", "n", "v"))
    assert [r["p"] for r in df.collect()] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
