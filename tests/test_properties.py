"""Property-based checks (hypothesis) of the order statistics and the allocation search."""
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from slicewise.functions.order_stats import exact_quantiles
from slicewise.operators import allocation as AL

SLOW = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@given(st.integers(min_value=3, max_value=60))
def test_candidates_cover_every_split(total):
    c = AL.candidate_list(total)
    assert len(c) == (total - 1) * (total - 2) // 2
    assert all(a + b + x == total and min(a, b, x) >= 1 for a, b, x in c)
    assert c == sorted(c) and len(set(c)) == len(c)


@SLOW
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float),
                          st.floats(-1e6, 1e6, allow_nan=False, width=32).map(float)),
                min_size=1, max_size=300),
       st.lists(st.floats(0, 1), min_size=1, max_size=4))
def test_exact_quantiles_equal_numpy(spark, values, probs):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = exact_quantiles(df, ["x"], probs, accuracy=50)["x"]
    arr = np.array([v for v in values if v is not None])
    if len(arr) == 0:
        assert got == [None] * len(probs)
        return
    want = np.quantile(arr, probs)
    assert np.allclose(got, want, rtol=1e-12, atol=1e-9), (got, want)


@SLOW
@given(st.integers(min_value=3, max_value=14),
       st.lists(st.floats(-2, 2, allow_nan=False), min_size=3, max_size=3))
def test_linear_search_equals_brute_force(spark, total, w):
    df = spark.createDataFrame([("s",)], "state_id string")
    r = AL.custom_search(df, AL.linear_scorer(*w), total=total).first()
    best, arg = None, None
    for a, b, c in AL.candidate_list(total):
        s = (float(a) * w[0] + float(b) * w[1]) + float(c) * w[2]
        if best is None or s > best:
            best, arg = s, (a, b, c)
    assert (r.best_rbg_0, r.best_rbg_1, r.best_rbg_2) == arg and r.best_score == best


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40)), min_size=1, max_size=60),
       st.integers(1, 3), st.integers(1, 3), st.integers(1, 3))
def test_bucketed_windows_equal_brute_force(spark, events, window, limit, bucket_factor):
    """Times on a coarse grid make events fall on bucket edges and share timestamps."""
    import datetime as dt
    from collections import deque
    from slicewise.operators import access_log as LG
    base = dt.datetime(2024, 1, 1)
    rows = [(i, c, base + dt.timedelta(seconds=t)) for i, (c, t) in enumerate(events)]
    log = spark.createDataFrame(rows, "event_id long, client long, ts timestamp_ntz")
    tc = {r.event_id: r.trailing_count for r in
          LG.trailing_count(log, window_seconds=window, bucket_factor=bucket_factor).collect()}
    rl = {r.event_id: r.accepted for r in
          LG.rate_limit_bucketed(log, limit=limit, window_seconds=window, bucket_factor=bucket_factor).collect()}
    for i, c, t in rows:
        ts = [u for j, d, u in rows if d == c]
        assert tc[i] == sum(1 for u in ts if t - dt.timedelta(seconds=window) < u <= t)
    want = {}
    for c in {c for _, c, _ in rows}:
        q = deque()
        for i, _, t in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0])):
            while q and not (t - q[0] < dt.timedelta(seconds=window)):
                q.popleft()
            want[i] = len(q) < limit
            if want[i]:
                q.append(t)
    assert rl == want


def test_preparation_takes_every_row(spark, sf):
    import __spark_entry__ as E
    from slicewise.plans import registry as R
    n = R.features(spark, sf).where("allocation_efficiency is not null").count()
    got = E.queries()["prep_prepare_data_whole"](spark, sf).collect()
    assert n > 5000 and len(got) == 13 and all(r["train_size"] + r["test_size"] == n for r in got)
