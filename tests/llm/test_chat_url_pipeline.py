"""Chat formatting, URL filter, SQL oracles and the pipeline on small inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from slicewise.llm import chat, url_filter
from slicewise.llm.common import prepare, saved, table
from slicewise.llm.queries import LLM_ORACLES, LLM_QUERIES
from tests.llm.helpers import empty
from tests.llm.test_text_operators import expected_groups, expected_stats, jaccard_truth

CONV = "conv_id long, turn long, role string, text string, path string, depth int, tree int"


def paths_of(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["tree"], r["path"]), []).append((r["depth"], r["id"]))
    return sorted((k[0], [i for _, i in sorted(v)]) for k, v in out.items())


def test_branches_are_ranked_by_score(spark):
    prepare(spark)
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 9.0), (1, 5, 2, 0.0), (1, 6, 2, None),
            (2, 1, None, 0.0), (2, 2, 99, 1.0), (3, 1, 2, 1.0), (3, 2, 1, 1.0), (3, 3, 1, 1.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, score double")
    # best path 1-3-4 (11), then 1-2-5 and 1-2-6 tie at 6 and the smaller leaf wins; 2/2 answers a
    # message that is not there and is a root; tree 3 is a circle without a root
    assert paths_of(chat.chosen_paths(m)) == [(1, [1, 3, 4]), (2, [1]), (2, [2])]
    assert paths_of(chat.chosen_paths(m, branches=2)) == [(1, [1, 2, 5]), (1, [1, 3, 4]), (2, [1]), (2, [2])]


def test_long_chain(spark):
    rows = [(7, i, i - 1 if i else None, 1.0) for i in range(150)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, score double")
    assert paths_of(chat.chosen_paths(m)) == [(7, list(range(150)))]


def test_formatting_round_trip(spark):
    tricky = ["</turn>\n", "<turn>assistant<text>x", "\\", "\\l\\b<", "", None, "é😀<", "\\### Assistant: </turn> ok", "a\nb"]
    rows = [(1, i, "assistant" if i % 2 else "user", t, "p", 1, 2) for i, t in enumerate(tricky)]
    rows += [(2, 0, None, "no role", "p", 1, 2), (2, None, "assistant", "null turn first", "p", 1, 2),
             (2, 0, "user", "same turn", "p", 1, 2), (2, 0, "user", "same turn", "p", 1, 2),
             (None, 3, "assistant", "null conversation", "p", 1, 2), (3, 0, "user", "z" * 200_000, "p", 1, 2)]
    conv = spark.createDataFrame(rows, CONV)
    f = chat.format_paths(chat.from_turns(conv)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.masked_texts(F.col("formatted"), F.col("loss_from"), F.col("loss_to"))).collect()
    got = {r["tree"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss"]) for r in f}
    want = {}
    for c in (1, 2, 3, None):
        turns = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want[c] = ([(r[2] or "", r[3] or "") for r in turns], [r[3] or "" for r in turns if r[2] == "assistant"])
    assert got == want
    assert chat.format_paths(chat.from_turns(conv.where("false"))).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?utm_a=1", "http://example.com/en/", "http://a.example.com/en",
            "http://example.com", "https://x.net/es/a#b", "https://net/fr/", "https://xnet/fr/", "http://h.org?utm_x", "http://h.org/p",
            "http://É.org/", "http://q.org/a?u=http://z.com/"] + ["http://host%d.org/%s" % (i % 40, "?utm_s" if i % 160 == 3 else "") for i in range(400)]
    rows = [(None if i == 6 else i // 2, u, None, "x", "y") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, key string")


def test_cascade_is_exact(spark, pages):
    hosts = pages.select(url_filter.url_parts()[0].alias("key"))
    listed = spark.createDataFrame([("host%d.org" % i,) for i in range(0, 40, 3)] + [(None,), ("elsewhere",)], "key string")
    c = url_filter.build_cascade(hosts, listed)
    got = {r["key"]: r["x"] for r in hosts.select("key", c.contains(F.col("key")).alias("x")).distinct().collect()}
    want = {"host%d.org" % i for i in range(0, 40, 3)} | {""}
    assert {k for k, x in got.items() if x} == want & set(got) and len(got) > 40
    assert len(c.levels) >= 1
    none = url_filter.build_cascade(hosts, listed.where("false"))
    assert hosts.where(none.contains(F.col("key"))).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_url_filter_against_sql(spark, pages, limit, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_FILTER_BYTES", limit)  # 0: the list is joined instead
    got = sorted(map(str, url_filter.filter_urls(pages, url_filter.tracking_hosts(pages)).collect()))
    con = duckdb.connect()
    con.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = con.execute(LLM_ORACLES["op8_url_filter"]).fetchall()
    key = lambda r: str(tuple(r))
    rows = [tuple(r) for r in url_filter.filter_urls(pages, url_filter.tracking_hosts(pages)).collect()]
    assert sorted(map(key, rows)) == sorted(map(key, want)) and len(got) == len(want)
    assert url_filter.filter_urls(pages.where("false"), url_filter.tracking_hosts(pages.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = LLM_QUERIES[name](spark, sf)
    cur = con.execute(LLM_ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    norm = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(norm, map(tuple, df.select(*names).collect())))) == sorted(map(str, map(norm, cur.fetchall())))


def test_pipeline_stages(spark, sf):
    docs = table(spark, sf, "documents")
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    before = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = saved(stage(spark, before, sf), "test-stage")
        local = [(r["doc_id"], r["text"]) for r in before.collect()]
        if i < 4:
            assert after.columns == docs.columns
            ids = sorted(r["doc_id"] for r in after.collect())
        if name == "quality_rules":
            base_ok = {i for i, t in local for s in [expected_stats(t)] if s[0] >= 10 and 100 * s[4] <= 20 * s[0]}
            assert set(ids) <= base_ok
            good = [i for i in base_ok if labels.get(i) == 1]
            assert sum(i in set(ids) for i in good) >= 0.98 * len(good)
        elif name == "exact_dedup":
            assert ids == sorted(r[0] for r in expected_groups(local) if r[3])
        elif name == "jaccard_join":
            assert len(ids) == len({t[1] for t in jaccard_truth(local)})
        elif name == "mixing":
            assert set(ids) <= {i for i, _ in local} and max(ids.count(x) for x in set(ids)) <= 3
        else:
            assert after.count() == len(local)
        before = after


def test_pipeline_on_an_empty_table(spark, sf):
    d = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        d = saved(stage(spark, d, sf), "test-empty")
        assert d.count() == 0
