import random
from datetime import datetime, timedelta

from slicewise.operators import access_log as LG
from slicewise.plans import registry as R
from slicewise.streaming import streams as SS


def test_feature_stream_equals_batch(spark, sf):
    s = R.q_stream_kpi_features(spark, sf)
    b = R.q_kpi_features(spark, sf)
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_rate_limit_stream_equals_batch(spark, sf):
    s = R.q_stream_rate_limit(spark, sf).select("event_id", "accepted")
    b = R.q_log_rate_limit(spark, sf).select("event_id", "accepted")
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_request_rate_stream_update_mode(spark, sf):
    log = R.access_log(spark, sf).select("event_id", "client", "ts")
    src = R._stage_parquet(log.orderBy("ts"), "rate-src")
    stream = SS.request_rate_stream(spark.readStream.schema(log.schema).parquet(src), watermark="1 hour")
    q = (stream.writeStream.format("memory").queryName("rate_stream_test").outputMode("complete")
               .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("rate_stream_test")
    want = LG.request_rate(log)
    assert got.select("window_start", "requests").exceptAll(want.select("window_start", "requests")).count() == 0
    assert got.count() == want.count()


def _limited(spark, batches, limit, window_s, watermark):
    """Decisions of the stream over micro-batches of (event_id, client, seconds)."""
    schema = "event_id long, client long, ts timestamp_ntz"
    src, base = SS.scratch_path(spark, "limit-src"), SS.scratch_path(spark, "limit-run")
    for rows in batches:
        df = spark.createDataFrame([(i, c, datetime(2024, 1, 1) + timedelta(seconds=t)) for i, c, t in rows], schema)
        df.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        out = SS.rate_limit_stream(stream, limit=limit, window_seconds=window_s, watermark=watermark)
        path = SS.run_available_now(out, "limit", base=base)
    return spark.read.parquet(path)


def test_rate_limit_stream_out_of_order_inside_the_watermark(spark):
    """Late rows change earlier-looking decisions; ties, several clients, one event after idle time."""
    rnd = random.Random(5)
    events = [(i, i % 3, rnd.randrange(0, 400)) for i in range(150)]
    arrival = sorted(events, key=lambda e: e[2] + rnd.randrange(0, 50))
    batches = [arrival[i:i + 50] for i in (0, 50, 100)] + [[(None, None, 100_000)]]
    got = _limited(spark, batches, 2, 20, "60 seconds")
    schema = "event_id long, client long, ts timestamp_ntz"
    log = spark.createDataFrame([(i, c, datetime(2024, 1, 1) + timedelta(seconds=t)) for i, c, t in events], schema)
    want = {r.event_id: r.accepted for r in LG.rate_limit(log, limit=2, window_seconds=20).collect()}
    rows = got.collect()
    assert len(rows) == len(events) and {r.event_id: r.accepted for r in rows} == want


def test_rate_limit_stream_holds_rows_and_drops_late_ones(spark):
    got = _limited(spark, [[(1, 7, 0), (2, 7, 100)], [(3, 7, 10), (4, 7, 101)]], 1, 10, "30 seconds")
    # the watermark stands at 71 s: event 3 is behind the first batch's watermark (70 s), 2 and 4 still wait
    assert [(r.event_id, r.accepted) for r in got.collect()] == [(1, True)]
