from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from slicewise.operators import access_log as LG
from slicewise.plans import registry as R


def _log(spark, sf):
    return R.access_log(spark, sf)


@pytest.mark.parametrize("bucket_factor", [1, 8])
def test_trailing_count_brute_force(spark, sf, bucket_factor):
    log = _log(spark, sf)
    w = 6 * 3600
    got = {r.event_id: r.trailing_count for r in
           LG.trailing_count(log, window_seconds=w, bucket_factor=bucket_factor).collect()}
    pdf = log.select("event_id", "client", "ts").toPandas()
    pdf["us"] = pdf.ts.astype("int64") // 1000
    for _, g in pdf.groupby("client"):
        us = g.us.to_numpy()
        for eid, t in zip(g.event_id, us):
            want = int(((us > t - w * 1_000_000) & (us <= t)).sum())
            assert got[eid] == want


def _limiter(pdf, limit, w_us):
    out = {}
    for _, g in pdf.sort_values(["client", "us", "event_id"]).groupby("client"):
        q = deque()
        for eid, t in zip(g.event_id, g.us):
            while q and not (t - q[0] < w_us):
                q.popleft()
            if len(q) >= limit:
                out[eid] = False
            else:
                q.append(t)
                out[eid] = True
    return out


@pytest.mark.parametrize("window_s,limit,bucket_factor", [(86400, 2, 4), (6 * 3600, 1, 1), (3 * 86400, 3, 1)])
def test_rate_limit_brute_force(spark, sf, window_s, limit, bucket_factor):
    log = _log(spark, sf)
    pdf = log.select("event_id", "client", "ts").toPandas()
    pdf["us"] = pdf.ts.astype("int64") // 1000
    want = _limiter(pdf, limit, window_s * 1_000_000)
    got = {r.event_id: r.accepted for r in
           LG.rate_limit_bucketed(log, limit=limit, window_seconds=window_s,
                                  bucket_factor=bucket_factor).collect()}
    assert got == want
    long = {r.event_id: r.accepted for r in LG.rate_limit(log, limit=limit, window_seconds=window_s).collect()}
    assert long == want
    assert not all(got.values())


def test_rate_limit_steady_client(spark):
    """One client with a request every 3 s: every bucket's carry hangs on the one before."""
    times = [1_000_000 * 3 * i for i in range(150)]
    log = spark.createDataFrame([(i, 7, t) for i, t in enumerate(times)], "event_id long, client long, us long")
    log = log.select("event_id", "client", F.expr("cast(timestamp_micros(us) as timestamp_ntz)").alias("ts"))
    want = _limiter(pd.DataFrame({"event_id": range(150), "client": 7, "us": times}), 2, 10_000_000)
    out = LG.rate_limit(log, limit=2, window_seconds=10, bucket_factor=4)
    assert {r.event_id: r.accepted for r in out.collect()} == want


def test_screen_text_cases(spark):
    rows = [(1, ""), (2, None), (3, "x" * 1001), (4, "hello <SCRIPT>"), (5, "  fine　\n"),
            (6, "Data: url")]
    df = spark.createDataFrame(rows, "id int, text string")
    out = {r.id: (r.status, r.clean_text) for r in LG.screen_text(df).collect()}
    assert out[1] == ("empty", "")
    assert out[2] == ("empty", None)
    assert out[3][0] == "too_long"
    assert out[4][0] == "dangerous"
    assert out[5] == ("accepted", "fine")
    assert out[6][0] == "dangerous"
    allowed = {r.id: r.status for r in LG.screen_text(df, allow_html=True).collect()}
    assert allowed[4] == "accepted"


def test_bruteforce_flags(spark, sf):
    out = LG.bruteforce_flags(_log(spark, sf), window_seconds=30 * 86400, threshold=3)
    assert out.where(F.col("flagged") != (F.col("failure_count") >= 3)).count() == 0
    assert out.where("flagged").count() > 0
