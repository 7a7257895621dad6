"""URL filter: ordered host/path rules, then a listed-host test by a Bloom filter cascade.

The cascade holds exact membership of a key set over a known universe of keys: level 1 is a Bloom
filter of the listed keys, level 2 one of the universe's other keys that pass level 1, level 3 one
of the listed keys that pass level 2, and so on until nothing passes wrongly.  A key of the
universe is looked up by the first level that rejects it; no page is joined to a list.

Each level is one array of 64-bit words, built by ``bit_or`` over the keys' positions and read as
a scalar subquery, so plans and driver stay small.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import saved, text_or_empty

BITS_PER_KEY = 10
HASHES = 5
MAX_FILTER_BYTES = 64 << 20  # all levels; beyond it the list is joined instead of broadcast

# Rules of the registered query: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    u = text_or_empty(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower())
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (its text, its verdict), null where none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, n_words: int) -> list[Column]:
    """Bit positions of a key at a level: two independent hashes, combined."""
    a, b = F.xxhash64(F.lit(2 * level), key), F.xxhash64(F.lit(2 * level + 1), key)
    return [F.pmod(F.xxhash64(a, b, F.lit(i)), F.lit(n_words * 64)) for i in range(HASHES)]


def _filter_of(keys: DataFrame, level: int, n_words: int) -> DataFrame:
    """One row: the level's bits as ``array<bigint>`` in word order."""
    spark = keys.sparkSession
    bits = (keys.select(F.explode(F.array(*_positions(F.col("key"), level, n_words))).alias("p"))
            .select(F.floor(F.col("p") / 64).alias("w"),
                    F.expr("shiftleft(cast(1 as bigint), cast(p % 64 as int))").alias("bits")))
    zeros = spark.range(n_words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    per_word = bits.unionByName(zeros).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return per_word.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))),
                                    lambda x: x["bits"]).alias("bits"))


def _passes(key: Column, bits: DataFrame, level: int, n_words: int) -> Column:
    arr, ok = bits.scalar(), F.lit(True)
    for p in _positions(key, level, n_words):
        word = F.get(arr, F.floor(p / 64).cast("int"))
        ok = ok & (F.shiftrightunsigned(word, 0).bitwiseAND(
            F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
    return ok


class Cascade:
    """Levels of a built cascade; :meth:`contains` is a Column over a key column."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    def contains(self, key: Column) -> Column:
        """True for the listed keys, exact for every key of the universe."""
        # rejected first at level 1, 3, ...: not listed; at level 2, 4, ...: listed
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            bits, n = self.levels[i]
            out = F.when(~_passes(key, bits, i + 1, n), F.lit(i % 2 == 1)).otherwise(out)
        return out


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade | None:
    """Cascade over ``universe`` (column ``key``) for the keys of ``listed`` (column ``key``).

    Both are made distinct here; listed keys outside the universe do no harm.  Null keys count as
    the empty key.  None where the filters could exceed ``MAX_FILTER_BYTES``.
    """
    key = F.coalesce(F.col("key"), F.lit("")).alias("key")
    inside = listed.select(key).distinct().withColumn("in_list", F.lit(True))
    both = saved(universe.select(key).distinct().join(inside, "key", "left")
                 .select("key", F.coalesce("in_list", F.lit(False)).alias("in_list")), "cascade-keys")
    this, other = both.where("in_list").select("key"), both.where("not in_list").select("key")
    levels: list[tuple[DataFrame, int]] = []
    n, spent = this.count(), 0
    while n:
        n_words = -(-n * BITS_PER_KEY // 64)
        spent += 8 * n_words
        if spent > MAX_FILTER_BYTES:
            return None
        level = len(levels) + 1
        bits = saved(_filter_of(this, level, n_words), f"cascade-{level}")
        levels.append((bits, n_words))
        wrong = saved(other.where(_passes(F.col("key"), bits, level, n_words)), f"cascade-fp-{level}")
        this, other = wrong, this
        n = wrong.count()
    return Cascade(levels)


def filter_urls(pages: DataFrame, listed_hosts: DataFrame, id_col: str = "page_id",
                url_col: str = "url", rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page.

    The longest rule that fits decides; otherwise a host of ``listed_hosts`` (column ``key``) is
    blocked and any other allowed.  A null URL or one without ``://`` has empty host and path.
    Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """
    host, path = url_parts(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    cascade = build_cascade(p.select(F.col("host").alias("key")), listed_hosts)
    rule, by_rule = rule_column(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("by_rule", by_rule)
    if cascade is None:
        # too many listed keys to hold in every task: an ordinary join by host
        bad = listed_hosts.select(F.coalesce("key", F.lit("")).alias("host")).distinct()
        p = p.join(bad.withColumn("listed", F.lit(True)), "host", "left").withColumn(
            "listed", F.coalesce("listed", F.lit(False)))
    else:
        p = p.withColumn("listed", cascade.contains(F.col("host")))
    return p.select("page_id", "host", "path", "rule",
                    F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def tracking_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Hosts (``key``) that serve at least one URL with a ``utm_`` tracking parameter."""
    host, _ = url_parts(url_col)
    return (pages.where(text_or_empty(url_col).contains("utm_")).select(host.alias("key")).distinct())
