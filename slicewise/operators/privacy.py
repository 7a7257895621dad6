"""Differentially private grouped counts and sums (Laplace mechanism).

What protects a client (the unit of privacy), step by step:

* contributions are bounded: of a client's rows, ``max_rows`` in each group and ``max_groups`` groups
  count, chosen by a keyed hash, so a client changes all counts together by at most
  ``max_groups * max_rows``;
* noise is ``-b * sign(u) * ln(1 - 2|u|)``, ``u`` uniform in (-1/2, 1/2) from 52 bits of the SHA-256
  of a secret and the group.  The caller gives a fresh secret for each release: without it the noise
  cannot be computed, with it a retried task or a rerun gives the same result;
* epsilon is divided evenly among the released statistics;
* with ``delta > 0`` a group comes out only if its noisy number of clients reaches a threshold, so a
  group that one client alone has is shown with probability ``delta`` at most.  With ``delta = 0``
  the list of groups counts as public;
* a :class:`Ledger` adds up what was spent on a table and refuses a release beyond its budget, and a
  secret that was used before.

Doubles are rounded to 6 decimals, which does not close the known gap between the Laplace
distribution and floating-point numbers.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions import commits
from ..functions.columns import dlit


def group_key(cols: list[str]) -> Column:
    """The values as one text from which they can be told apart, nulls included."""
    one = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")),
                      F.lit("-")) for c in cols]
    return F.concat(*one) if one else F.lit("")


def keyed_hash(secret: str, use: str, text: Column) -> Column:
    """SHA-256 of the secret, what the hash is for, and a text."""
    return F.sha2(F.concat(F.lit(f"{len(secret)}:{secret}|{use}|"), text), 256)


def laplace(secret: str, key: Column, scale: float, use: str) -> Column:
    m = F.conv(F.substring(keyed_hash(secret, use, key), 1, 13), 16, 10).cast("long").cast("double")
    u = (m + dlit(0.5)) / dlit(float(2 ** 52)) - dlit(0.5)     # strictly inside (-1/2, 1/2)
    return dlit(-scale) * F.signum(u) * F.log(dlit(1.0) - dlit(2.0) * F.abs(u))


def bounded(df: DataFrame, group_cols: list[str], client_col: str, id_cols: list[str], secret: str,
            max_rows: int, max_groups: int) -> DataFrame:
    """The rows that count, with ``_g`` (group) and ``_c`` (client).  Rows without a client are one
    client.  Both rankings keep the first few only, which Spark does before the shuffle too, so a
    client with a third of the table sends a few rows a task and group."""
    x = df.withColumns({"_g": group_key(group_cols), "_c": group_key([client_col])})
    x = x.withColumn("_row", keyed_hash(secret, "row", group_key(id_cols)))
    mine = Window.partitionBy("_c", "_g").orderBy("_row", *id_cols)
    x = x.withColumn("_n", F.row_number().over(mine)).where(F.col("_n") <= max_rows).drop("_n", "_row")
    some = Window.partitionBy("_c").orderBy(keyed_hash(secret, "group", F.concat("_c", "_g")), "_g")
    return x.withColumn("_n", F.dense_rank().over(some)).where(F.col("_n") <= max_groups).drop("_n")


def threshold(epsilon: float, delta: float, max_groups: int) -> float:
    """Noisy number of clients from which on a group is shown: one client's groups all stay below it
    but for a probability of ``delta``, with noise of scale ``max_groups / epsilon``."""
    return 1.0 + max_groups / epsilon * math.log(max_groups / (2.0 * delta))


def noisy_aggregate(df: DataFrame, group_cols: list[str], value_col: str | None = None, *, secret: str,
                    client_col: str, id_cols: list[str], epsilon: float = P.DP_EPSILON, delta: float = P.DP_DELTA,
                    clamp: tuple[float, float] | None = None, max_rows: int = 1, max_groups: int = 1,
                    ledger: "Ledger | None" = None) -> DataFrame:
    """Per group a noisy count and, with ``value_col``, a noisy sum of the values clamped to ``clamp``
    (null counts as the lower end).  ``id_cols`` tell rows apart.  The whole release is
    ``(epsilon, delta)``-private per client; with a ``ledger`` it is booked there first.

    The clamped sum is rounded to 6 decimals before and after noising, so the result does not depend
    on the order in which partial sums were added.
    """
    if not secret:
        raise ValueError("a release needs a secret")
    if not (epsilon > 0 and 0 <= delta < 0.5 and max_rows >= 1 and max_groups >= 1):
        raise ValueError("epsilon must be positive, delta in [0, 0.5), max_rows and max_groups at least 1")
    lo, hi = clamp or (0.0, 1.0)
    if ledger is not None:
        ledger.spend(epsilon, delta, secret)
    share = epsilon / (1 + (value_col is not None) + (delta > 0))
    x = bounded(df, group_cols, client_col, id_cols, secret, max_rows, max_groups)
    aggs = [F.count(F.lit(1)).alias("_n")]
    if delta > 0:
        aggs.append(F.countDistinct("_c").alias("_clients"))
    if value_col:
        v = F.coalesce(F.col(value_col).cast("double"), dlit(lo))
        aggs.append(F.sum(F.least(F.greatest(v, dlit(lo)), dlit(hi))).alias("_s"))
    g = x.groupBy(*group_cols, "_g").agg(*aggs)
    key, most = F.col("_g"), max_rows * max_groups
    if delta > 0:
        clients = F.col("_clients") + laplace(secret, key, max_groups / share, "clients")
        g = g.where(clients >= dlit(threshold(share, delta, max_groups))).drop("_clients")
    out = g.withColumn("noisy_count", F.round(F.col("_n").cast("double")
                                              + laplace(secret, key, most / share, "count"), 6))
    if value_col:
        scale = most * max(abs(lo), abs(hi)) / share
        out = out.withColumn("noisy_sum", F.round(F.round(F.col("_s"), 6) + laplace(secret, key, scale, "sum"), 6))
    return out.drop("_n", "_s", "_g")


class Ledger:
    """What was spent on one table, in a shared folder, by any number of writers."""

    def __init__(self, spark: SparkSession, path: str, epsilon: float, delta: float = 0.0):
        self.spark, self.path, self.epsilon, self.delta = spark, path, epsilon, delta

    def spent(self) -> tuple[float, float]:
        past = commits.entries(self.spark, self.path)
        return math.fsum(e["epsilon"] for e in past), math.fsum(e["delta"] for e in past)

    def spend(self, epsilon: float, delta: float, secret: str) -> None:
        """Book a release, or raise if the budget does not hold it or its secret is used up.  What is
        booked stays booked, also when the release is never run."""
        mark = hashlib.sha256(f"ledger|{secret}".encode()).hexdigest()

        def decide(past: list[dict]) -> dict:
            if any(e["secret_sha256"] == mark for e in past):
                raise ValueError("this secret was used in an earlier release")
            total = math.fsum([epsilon, *(e["epsilon"] for e in past)])
            deltas = math.fsum([delta, *(e["delta"] for e in past)])
            if total > self.epsilon * (1 + 1e-12) or deltas > self.delta * (1 + 1e-12):
                raise ValueError(f"the budget ({self.epsilon}, {self.delta}) does not hold ({total}, {deltas})")
            return {"epsilon": epsilon, "delta": delta, "secret_sha256": mark}

        commits.append(self.spark, self.path, decide)
