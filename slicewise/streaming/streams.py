"""Structured Streaming forms of the batch operators.

* ``kpi_feature_stream``: the same ``kpi_features`` code on a streaming source (stateless,
  map-only; the slice table joins as a stream-static broadcast join).
* ``request_rate_stream``: tumbling or sliding windows with a watermark (late rows beyond the
  watermark are dropped), append mode.
* ``rate_limit_stream``: the recursive rate limiter as state of buckets of clients
  (``transformWithStateInPandas``): rows wait until the watermark passes them and are decided per
  client in time order; event-time timers wake a bucket and drop idle clients.

Checkpoints of every query go under the shared checkpoint folder of the session.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import params as P
from ..operators import access_log as LG
from ..operators import features as FE
from ..session import scratch_path


def kpi_feature_stream(spark: SparkSession, source_dir: str, schema, keep=("row_key",),
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """F12 on a stream of raw KPI parquet files (same transformation as batch)."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return FE.kpi_features(r.parquet(source_dir), keep=list(keep))


def request_rate_stream(log: DataFrame, minutes: int = 5, slide_minutes: int | None = None,
                        watermark: str = "10 minutes") -> DataFrame:
    """L8 on a stream: windowed request counts with a watermark on ``ts``.

    Watermarks need a session-zone ``timestamp``; NTZ input is read as UTC (the session zone).
    """
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    return LG.request_rate(log.withWatermark("ts", watermark), minutes, slide_minutes)


# Rows wait here until the watermark has passed them, and each client's accepted times as in the
# batch form: one entry per micro-batch with the columns as bytes, no entry per row.
WAITING_SCHEMA = "us binary, event_id binary, client binary, no_client binary"
ACCEPTED_SCHEMA = "us binary, client binary, no_client binary"
TIMER_SCHEMA = "next_ms long"
_WAITING_TYPES = (np.int64, np.int64, np.int64, np.bool_)
_ACCEPTED_TYPES = (np.int64, np.int64, np.bool_)

LIMITER_BUCKETS = 64  # groups of clients that share a state entry, at least; fixed for a checkpoint
BUCKET_ROWS = 100_000  # rows of a log that a bucket should have, about


def limiter_buckets(rows: int) -> int:
    """Buckets for a log of about ``rows`` rows, so that a bucket does not grow with the log."""
    return max(LIMITER_BUCKETS, -(-rows // BUCKET_ROWS))


def _packed(columns) -> tuple:
    return tuple(c.tobytes() for c in columns)


def _unpacked(entries, types) -> list[np.ndarray]:
    entries = list(entries)
    return [np.frombuffer(b"".join(e[i] for e in entries), t) for i, t in enumerate(types)]


class RateLimiter(StatefulProcessor):
    """State of the rate limiter for a bucket of clients: rows that wait, each client's accepted
    times (at most ``limit``), and the time of the next event-time timer.

    A row is decided only when the watermark has reached it, for then no earlier row of its client
    can arrive; all rows that are due are decided together in time order (ties by event id).  A
    timer stands at the first waiting row; when none waits it stands where the last accepted
    request leaves the window.  Whenever it fires, clients whose requests have left it are dropped.
    """

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING_SCHEMA)
        self.accepted = handle.getValueState("accepted", ACCEPTED_SCHEMA)
        self.timer = handle.getValueState("timer", TIMER_SCHEMA)

    def _wake_at(self, ms: int) -> None:
        """One timer at a time, at ``ms`` or at the earlier one that stands."""
        if self.timer.exists():
            old = int(self.timer.get()[0])
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, entries = None, []
        for p in rows:
            p = p[~p["heartbeat"].astype(bool)]
            if not len(p):
                continue
            cols = [p[c].to_numpy().astype(t) for c, t in zip(("us", "id", "client", "no_client"), _WAITING_TYPES)]
            entries.append(_packed(cols))
            us = int(cols[0].min())
            first = us if first is None else min(first, us)
        if entries:
            self.waiting.appendList(entries)
            self._wake_at(-(-first // 1000))
        return iter(())

    def _decide(self, us: np.ndarray, client: np.ndarray, none: np.ndarray, times: dict) -> np.ndarray:
        """Decisions for rows sorted by client and time; ``times`` has the accepted times by client."""
        ok = np.ones(len(us), bool)
        new = np.flatnonzero(np.append(True, (client[1:] != client[:-1]) | (none[1:] != none[:-1]))[:len(us)])
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(us)]):
            q = times.setdefault((bool(none[lo]), int(client[lo])), deque())
            if len(q) + hi - lo <= self.limit:  # never as many as would reject one
                q.extend(us[lo:hi].tolist())
            else:
                ok[lo:hi] = LG.admit(us[lo:hi], q, self.limit, self.window_us)
        return ok

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        seen_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(self.waiting.get() if self.waiting.exists() else [], _WAITING_TYPES)
        due = rows[0] <= seen_us
        later = [c[~due] for c in rows]
        us, ids, client, none = (c[due] for c in rows)
        order = np.lexsort((ids, us, client, none))
        us, ids, client, none = us[order], ids[order], client[order], none[order]
        times: dict = {}
        if self.accepted.exists():
            for t, c, n in zip(*(c.tolist() for c in _unpacked([self.accepted.get()], _ACCEPTED_TYPES))):
                times.setdefault((n, c), deque()).append(t)
        ok = self._decide(us, client, none, times)
        left = [(t, c, n) for (n, c), q in times.items() for t in q if t + self.window_us > seen_us]
        if len(us):
            if len(later[0]):
                self.waiting.put([_packed(later)])
            else:
                self.waiting.clear()
        if left:
            self.accepted.update(_packed(np.array(c, t) for c, t in zip(zip(*left), _ACCEPTED_TYPES)))
        else:
            self.accepted.clear()
        if len(later[0]):
            self._wake_at(-(-int(later[0].min()) // 1000))
        elif left:
            self._wake_at(-(-(max(t for t, _, _ in left) + self.window_us) // 1000))
        if len(us):
            yield pd.DataFrame({"event_id": ids, "client": pd.arrays.IntegerArray(client, none), "ts": us.astype("datetime64[us]"),
                                "accepted": ok})

    def close(self) -> None:
        pass


def rate_limit_stream(log: DataFrame, limit: int = P.RATE_LIMIT,
                      window_seconds: int = P.RATE_WINDOW_SECONDS, watermark: str = "1 hour",
                      buckets: int = LIMITER_BUCKETS) -> DataFrame:
    """L2 on a stream: equals the batch operator for rows that arrive in any order inside the
    watermark; rows behind the watermark are dropped.

    Rows come out when the watermark passes them.  A row without ``event_id`` (a heartbeat of the
    source) is not decided and only moves the watermark on.  The state is every client's rows of
    the last ``watermark`` and at most ``limit`` accepted times; it is kept, read and written in
    ``buckets`` groups of clients by hash, so that the cost of a call of the state store is not paid
    for every client.  Start the query inside :func:`state_partitions`, which chooses the state
    store that such state needs.
    """
    x = (log.withColumn("event_time", F.col("ts").cast("timestamp"))
            .withWatermark("event_time", watermark)
            # no nulls go to Python: there they would turn whole columns into floats
            .select(F.pmod(F.xxhash64("client"), F.lit(int(buckets))).alias("bucket"),
                    F.coalesce("client", F.lit(0)).alias("client"), F.col("client").isNull().alias("no_client"),
                    F.coalesce("event_id", F.lit(0)).alias("id"), F.col("event_id").isNull().alias("heartbeat"),
                    "event_time", F.unix_micros(F.col("event_time")).alias("us")))
    return x.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=RateLimiter(int(limit), int(window_seconds) * 1_000_000),
        outputStructType=LG.RATE_SCHEMA, outputMode="Append", timeMode="EventTime")


# Timers and list state need the store that keeps state on disk and writes changes only.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Shuffle partitions and kind of a stream's state store while it is started and run.

    A stateful query fixes its number of state partitions at its first batch (then it is kept
    in the checkpoint); default to the cluster's cores instead of the batch setting.
    """
    wanted = {"spark.sql.shuffle.partitions": str(n or spark.sparkContext.defaultParallelism),
              "spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def run_available_now(stream: DataFrame, name: str, fmt: str = "parquet",
                      output_mode: str = "append", base: str | None = None) -> str:
    """Run a streaming query over everything available and return the sink path.

    Sink and checkpoint live in the shared checkpoint folder, so a restarted job resumes; with
    the same ``base`` a later call goes on from the state of the call before.
    """
    spark = stream.sparkSession
    base = base or scratch_path(spark, f"stream-{name}")
    with state_partitions(spark):
        q = (stream.writeStream.format(fmt).outputMode(output_mode)
                   .option("checkpointLocation", os.path.join(base, "_checkpoint"))
                   .option("path", os.path.join(base, "out"))
                   .trigger(availableNow=True).start())
        q.awaitTermination()
    return os.path.join(base, "out")


def run_update_mode(stream: DataFrame, base: str) -> None:
    """Run an aggregating stream in update mode over the data available now.

    Each micro-batch's changed rows are appended (tagged with the batch id) to ``base/updates``;
    the checkpoint is ``base/_checkpoint``, so calling this again after more input arrived
    continues from the saved state and watermark.  Unlike append mode this also yields the
    windows the watermark has not closed yet.
    """
    out = os.path.join(base, "updates")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("append").parquet(out)

    with state_partitions(stream.sparkSession):
        q = (stream.writeStream.outputMode("update").foreachBatch(sink)
                   .option("checkpointLocation", os.path.join(base, "_checkpoint"))
                   .trigger(availableNow=True).start())
        q.awaitTermination()


def final_updates(spark: SparkSession, base: str, keys: list[str]) -> DataFrame:
    """Per key, the row of the latest micro-batch written by ``run_update_mode``."""
    upd = spark.read.parquet(os.path.join(base, "updates"))
    latest = upd.groupBy(*keys).agg(F.max("_batch").alias("_batch"))
    return upd.join(latest, keys + ["_batch"]).drop("_batch")
