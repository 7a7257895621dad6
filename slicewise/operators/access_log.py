"""Access-log analytics over ``access_log(event_id, client, ts, event_type, failed, details)``
(L1-L8).

Trailing-window counts per client are range windows, but a window partitioned only by client
would put a client holding a third of the log into one task.  ``trailing_count`` therefore
partitions by ``(client, time bucket)`` with buckets at least as long as the window, and copies
the events near a bucket's end into the next bucket, so every event still sees its whole
trailing window while a busy client is spread over many tasks.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def trailing_count(df: DataFrame, key: str = "client", ts: str = "ts",
                   window_seconds: int = P.RATE_WINDOW_SECONDS, out: str = "trailing_count",
                   bucket_factor: int = 8) -> DataFrame:
    """L1: per event, the number of events of the same key in ``(t - window, t]``.

    ``now - t < window`` (strict), so the range frame ends one microsecond short of
    ``window``; events with equal timestamps count each other.
    """
    w_us = int(window_seconds) * 1_000_000
    b_us = w_us * max(1, int(bucket_factor))
    us = _micros(ts)
    base = df.withColumn("_us", us).withColumn("_b", F.floor(F.col("_us") / F.lit(b_us)).cast("long"))
    # one scan: every event in its own bucket (a query row), and events within `window` of the
    # next bucket's start once more in that bucket (context only)
    own = F.struct(F.col("_b").alias("_pb"), F.lit(True).alias("_q"))
    nxt = F.struct((F.col("_b") + 1).alias("_pb"), F.lit(False).alias("_q"))
    near_end = F.col("_us") > (F.col("_b") + 1) * F.lit(b_us) - F.lit(w_us)
    both = base.select("*", F.inline(F.when(near_end, F.array(own, nxt)).otherwise(F.array(own))))
    w = Window.partitionBy(key, "_pb").orderBy("_us").rangeBetween(-(w_us - 1), 0)
    return (both.withColumn(out, F.count(F.lit(1)).over(w))
                .where(F.col("_q")).drop("_us", "_b", "_pb", "_q"))


def bruteforce_flags(log: DataFrame, window_seconds: int = P.BRUTEFORCE_WINDOW_SECONDS,
                     threshold: int = P.BRUTEFORCE_THRESHOLD) -> DataFrame:
    """L3: per failure, failures of the client in ``(t - window, t]``; flagged at ``>= threshold``."""
    fails = log.where(F.col("failed"))
    out = trailing_count(fails, window_seconds=window_seconds, out="failure_count")
    return out.withColumn("flagged", F.col("failure_count") >= threshold)


def failures_by_client(log: DataFrame) -> DataFrame:
    """L4: failures per client (partial counts map-side, so a hot client costs one row per task)."""
    return log.where(F.col("failed")).groupBy("client").agg(F.count(F.lit(1)).alias("failures"))


def active_requests(log: DataFrame, window_seconds: int = P.RATE_WINDOW_SECONDS,
                    now: Column | None = None) -> DataFrame:
    """Requests per client in the current window ``(now - window, now]``; ``now`` defaults to
    the latest event of the log (one aggregate value, applied as a literal)."""
    if now is None:
        latest = log.agg(F.max(_micros("ts")).alias("_now")).first()["_now"]
        x = log.withColumn("_now", F.lit(latest).cast("long"))
    else:
        x = log.withColumn("_now", F.unix_micros(now.cast("timestamp")))
    w_us = int(window_seconds) * 1_000_000
    us = _micros("ts")
    x = x.where((F.col("_now") - us < w_us) & (us <= F.col("_now")))
    return x.groupBy("client").agg(F.count(F.lit(1)).alias("active_requests"))


def recent_events(log: DataFrame, n: int = P.RECENT_EVENTS) -> DataFrame:
    """The last ``n`` events (top-k: partial top-n per task, then one merge of n rows)."""
    return log.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def screen_text(df: DataFrame, text: str = "text", max_length: int = P.MAX_INPUT_LENGTH,
                allow_html: bool = False) -> DataFrame:
    """``status`` in {accepted, empty, too_long, dangerous} and the trimmed ``clean_text``.

    Empty values pass unchanged; longer than ``max_length`` is rejected first; then the
    case-insensitive dangerous substrings (unless ``allow_html``); accepted values are trimmed
    of Unicode white space at both ends.
    """
    t = F.col(text)
    low = F.lower(t)
    danger = F.lit(False)
    if not allow_html:
        for p in P.DANGEROUS_PATTERNS:
            danger = danger | F.contains(low, F.lit(p))
    cls = P.STRIP_CHARS_CLASS
    trimmed = F.regexp_replace(t, f"^{cls}+|{cls}+$", "")
    status = (F.when(t.isNull() | (t == ""), "empty")
               .when(F.length(t) > max_length, "too_long")
               .when(danger, "dangerous")
               .otherwise("accepted"))
    return df.withColumns({
        "length": F.length(t),
        "status": status,
        "clean_text": F.when(status == "accepted", trimmed).when(status == "empty", t),
    })


def request_rate(log: DataFrame, minutes: int = 5, slide_minutes: int | None = None) -> DataFrame:
    """Requests per ``minutes`` window and the per-second rate (tumbling or sliding)."""
    dur = f"{minutes} minutes"
    win = F.window("ts", dur, f"{slide_minutes} minutes") if slide_minutes else F.window("ts", dur)
    return (log.groupBy(win.alias("w"))
               .agg(F.count(F.lit(1)).alias("requests"))
               .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                       F.col("requests"),
                       (F.col("requests") / F.lit(float(minutes * 60))).alias("rate_per_s")))


def security_report(log: DataFrame, path: str, limit: int = P.RATE_LIMIT,
                    window_seconds: int = P.RATE_WINDOW_SECONDS) -> DataFrame:
    """L4, L5, L6 and the limiter's settings as one written report (S5), read back."""
    from ..sources import sinks as SK
    spark = log.sparkSession
    settings = spark.createDataFrame([(int(limit), int(window_seconds))], "max_requests long, window_seconds long")
    SK.write_report({"settings": settings, "failures": failures_by_client(log),
                     "active_requests": active_requests(log, window_seconds),
                     "recent_events": recent_events(log)}, path)
    return SK.read_report(spark, path)


# --- L2: rate limiter (recursive: the decision depends on earlier decisions) -------------------

RATE_SCHEMA = "event_id long, client long, ts timestamp_ntz, accepted boolean"
_PASS_SCHEMA = "event_id long, client long, ts timestamp_ntz, accepted boolean, _b long, carry array<long>"


def admit(times: np.ndarray, accepted: deque, limit: int, window_us: int) -> np.ndarray:
    """Decisions for sorted ``times``, given the accepted times still in the window (changed in
    place, at most ``limit``).  When the limit is reached it goes straight to the first time at
    which the oldest accepted request has left the window, so the cost is per accepted request."""
    out = np.zeros(len(times), bool)
    i = 0
    while i < len(times) and limit > 0:
        t = int(times[i])
        while accepted and t - accepted[0] >= window_us:
            accepted.popleft()
        if len(accepted) < limit:
            accepted.append(t)
            out[i] = True
            i += 1
        else:
            i += int(np.searchsorted(times[i:], accepted[0] + window_us, "left"))
    return out


def _bucket_pass(limit: int, window_us: int, bucket_us: int):
    """Over rows sorted by (client, bucket, kind, time, id): ``kind`` 0 rows bring the accepted
    times carried in from the previous bucket, ``kind`` 1 rows are the bucket's events.  Gives
    every event's decision and one row per bucket with the accepted times that reach into the
    next one; both hold at most ``limit`` times."""
    def run(batches):
        key, q = None, deque()

        def closed():
            end = (key[1] + 1) * bucket_us
            return key[0], key[1] + 1, [t for t in q if t > end - window_us]

        for pdf in batches:
            if not len(pdf):
                continue
            c, b, kind = (pdf[x].to_numpy() for x in ("client", "_b", "_kind"))
            us = pdf["_us"].to_numpy()
            if us.dtype.kind == "f" and np.isnan(us[kind == 1]).any():
                raise ValueError("a request has no time")
            us = np.where(kind == 1, us, 0).astype(np.int64)
            carry = pdf["carry"].to_numpy()
            first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (b[1:] != b[:-1])])
            accepted, carries = np.ones(len(pdf), bool), []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(pdf)]):
                if (c[lo], b[lo]) != key:
                    if key is not None:
                        carries.append(closed())
                    key, q = (c[lo], b[lo]), deque()
                if kind[lo] == 0:
                    q.extend(int(t) for t in carry[lo])
                    lo += 1
                if len(q) + hi - lo <= limit:  # never as many as would reject one
                    q.extend(us[lo:hi].tolist())
                elif lo < hi:
                    accepted[lo:hi] = admit(us[lo:hi], q, limit, window_us)
            events = pdf.loc[kind == 1, ["event_id", "client", "ts", "_b"]]
            if len(events):
                yield events.assign(accepted=accepted[kind == 1], carry=None)[["event_id", "client", "ts", "accepted", "_b", "carry"]]
            if carries:
                yield _carry_frame(carries)
        if key is not None:
            yield _carry_frame([closed()])
    return run


def _carry_frame(carries: list) -> pd.DataFrame:
    n = len(carries)
    return pd.DataFrame({"event_id": pd.array([None] * n, dtype="Int64"), "client": [c for c, _, _ in carries],
                         "ts": pd.Series([pd.NaT] * n, dtype="datetime64[us]"),
                         "accepted": pd.array([None] * n, dtype="boolean"), "_b": [b for _, b, _ in carries],
                         "carry": [t for _, _, t in carries]})


def rate_limit(log: DataFrame, limit: int = P.RATE_LIMIT, window_seconds: int = P.RATE_WINDOW_SECONDS,
               bucket_factor: int = 32) -> DataFrame:
    """L2: a request is rejected when the client already has ``limit`` *accepted* requests in
    the trailing window; rejected requests do not count.  Ties in time are broken by event id.

    The rule is recursive, but a decision depends only on accepted requests less than a window
    old.  Time is cut into buckets of ``bucket_factor`` windows, so a (client, bucket) depends on
    its predecessor only through the accepted times that reach into it, at most ``limit``.  The
    first pass decides all buckets with nothing carried in; every further pass decides again just
    the buckets whose carried-in times turned out different, until none does.  Then every bucket
    has seen its true carry (by induction from each client's first), so the result is exact.  A
    busy client is spread over its buckets; each pass is written to the shared checkpoint folder.
    """
    from ..session import scratch_path
    spark = log.sparkSession
    w_us = int(window_seconds) * 1_000_000
    b_us = w_us * max(1, int(bucket_factor))
    events = log.select("event_id", "client", "ts", _micros("ts").alias("_us"))
    events = events.withColumn("_b", F.floor(F.col("_us") / F.lit(b_us)).cast("long"))
    none = F.lit(None).cast("array<long>")
    fn = _bucket_pass(int(limit), w_us, b_us)

    def decide(rows: DataFrame, given: DataFrame | None, number: int) -> DataFrame:
        rows = rows.select(F.lit(1).alias("_kind"), "client", "_b", "_us", "event_id", "ts", none.alias("carry"))
        if given is not None:
            rows = rows.unionByName(given.select(
                F.lit(0).alias("_kind"), "client", "_b", F.lit(None).cast("long").alias("_us"),
                F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"), "carry"))
        path = scratch_path(spark, "rate-limit-pass")
        (rows.repartition("client", "_b").sortWithinPartitions("client", "_b", "_kind", "_us", "event_id")
         .mapInPandas(fn, _PASS_SCHEMA).withColumn("_pass", F.lit(number)).write.parquet(path))
        return spark.read.parquet(path)

    buckets = events.select("client", "_b").distinct()
    done = decide(events, None, 0)
    # what each bucket has been given so far; nothing in the first pass
    given = buckets.withColumn("was", F.array().cast("array<long>"))
    number = 0
    while True:
        latest = (done.where("carry is not null").groupBy("client", "_b")
                  .agg(F.max_by("carry", "_pass").alias("carry")))
        changed = given.join(latest, ["client", "_b"]).where("carry <> was").select("client", "_b", "carry")
        path = scratch_path(spark, "rate-limit-changed")
        changed.write.parquet(path)
        changed = spark.read.parquet(path)
        if changed.isEmpty():
            break
        number += 1
        done = done.unionByName(decide(events.join(changed, ["client", "_b"], "left_semi"), changed, number))
        path = scratch_path(spark, "rate-limit-given")
        (given.join(changed.withColumnRenamed("carry", "now"), ["client", "_b"], "left")
         .select("client", "_b", F.coalesce("now", "was").alias("was")).write.parquet(path))
        given = spark.read.parquet(path)
    decisions = done.where("carry is null")
    last = decisions.groupBy("client", "_b").agg(F.max("_pass").alias("_pass"))
    return decisions.join(last, ["client", "_b", "_pass"]).select("event_id", "client", "ts", "accepted")


def rate_limit_bucketed(log: DataFrame, limit: int = P.RATE_LIMIT,
                        window_seconds: int = P.RATE_WINDOW_SECONDS, bucket_factor: int = 4) -> DataFrame:
    """:func:`rate_limit` with short buckets."""
    return rate_limit(log, limit, window_seconds, bucket_factor)
