"""Quality rules: text statistics and a learned decision list (DataFrame functions only).

Sequential covering over labelled statistics: a rule starts empty and takes the threshold test
with the largest information gain until it covers no good row or nothing helps; it is then cut
back to the prefix that does best on rows held out for pruning, kept if it is precise enough
there, and the rows it covers leave the table before the next rule grows.  The rules come out as
an ordered Spark conditional expression.

Each step is one grouped count over the labelled rows' bin codes; only the counts per
(statistic, bin, label) reach the driver, a number fixed by the parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicewise.llm.common import saved, text_or_empty, without_space, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10          # base rule: fewer words fail
MAX_REPEAT_PCT = 20     # base rule: a larger share of repeated words fails
WINDOW = 5

MAX_LABELLED_ROWS = 200_000  # bound of the labelled sample the list is fitted on (by id hash)
BINS = 32
MAX_RULES = 12
MAX_TESTS = 3
MIN_PRECISION = 0.9
MIN_COVER = 5           # rejected rows a rule must cover among the pruning rows

# Statistics the rules may test, as SQL over the columns of text_stats.
RULE_STATS = {
    "n_words": "cast(n_words as double)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
}


def _count_chars(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("long")


def with_stats(df: DataFrame, text: str) -> DataFrame:
    """Add the statistics of the column ``text`` (null: empty) to ``df``; linear in the text."""
    d = df.withColumn("t", text_or_empty(text)).withColumn("w", words("t"))
    d = d.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.length(without_space(x)) > 0))
    n = F.size("w")
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW),
                        lambda i: F.xxhash64(*[F.get("w", i + k) for k in range(WINDOW)]))
    d = d.withColumn("g", F.when(n >= WINDOW, grams).otherwise(F.array().cast("array<bigint>")))
    # windows sorted by hash stand beside their repeats; only texts that have any are sorted
    d = d.withColumn("s", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = F.filter("s", lambda p, i: ((i > 0) & (F.get("s", i - 1)["h"] == p["h"]))
                     | F.coalesce(F.get("s", i + 1)["h"] == p["h"], F.lit(False)))
    d = d.withColumn("starts", F.sort_array(F.transform(again, lambda p: p["i"])))
    covered = F.aggregate(
        "starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"])
    return (d.withColumn("n_words", n.cast("long"))
            .withColumn("word_chars", F.length(without_space("t")).cast("long"))
            .withColumn("n_symbols", _count_chars(F.col("t"), SYMBOLS))
            .withColumn("n_lines", F.size("lines").cast("long"))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
            .withColumn("n_upper", (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long"))
            .withColumn("n_bangs", _count_chars(F.col("t"), "!"))
            .withColumn("n_distinct", F.size(F.array_distinct("w")).cast("long"))
            .drop("t", "w", "lines", "g", "s", "starts"))


STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
                "n_upper", "n_bangs", "n_distinct")


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics, one row per input row; other columns are ignored."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return with_stats(d, "text").select("doc_id", *STAT_COLUMNS)


@dataclass
class DecisionList:
    """Ordered rules; each is a list of ``(statistic, '<=' or '>', threshold)`` tests."""

    rules: list = field(default_factory=list)

    def keeps(self) -> Column:
        """False for the rows some rule rejects, over the columns of :func:`text_stats`."""
        out = None
        for rule in self.rules:
            hit = F.lit(True)
            for stat, op, x in rule:
                v = F.expr(RULE_STATS[stat])
                hit = hit & ((v <= F.lit(x)) if op == "<=" else (v > F.lit(x)))
            out = F.when(hit, F.lit(False)) if out is None else out.when(hit, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{s} {o} {x:g}" for s, o, x in r) for r in self.rules)


def learn_rules(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                label_col: str = "quality", max_rows: int = MAX_LABELLED_ROWS,
                min_precision: float = MIN_PRECISION) -> DecisionList:
    """Fit the list on the labelled rows that pass the base rule.

    ``label_col`` 0 means reject; null labels and ids are left out, of several labels for an id
    the smallest counts.  At most about ``max_rows`` labelled rows are used, chosen by id hash.
    Without labelled rows of both kinds the list is empty and keeps everything.
    """
    y = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
         .groupBy(F.col(id_col).alias("l_id")).agg((F.min(label_col) == 0).cast("int").alias("y")))
    n = y.count()
    if n > max_rows:
        y = y.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 40)) < int((1 << 40) * max_rows / n))
    names = list(RULE_STATS)
    rows = saved(stats.where(~base_failed()).join(y, F.col("doc_id") == F.col("l_id")).select(
        "doc_id", "y", *[F.expr(RULE_STATS[s]).alias(s) for s in names]), "rules-rows")
    # cuts lie halfway between neighbouring quantiles of the two kinds of rows
    marks = rows.groupBy("y").agg(*[F.percentile_approx(s, [i / BINS for i in range(BINS + 1)], 2000).alias(s)
                                    for s in names]).collect()
    if len(marks) < 2:
        return DecisionList()
    values = {s: sorted({x for m in marks for x in m[s]}) for s in names}
    cuts = {s: [(a + b) / 2 for a, b in zip(v, v[1:])] for s, v in values.items()}
    # bin code of a value: the number of cuts below it, so "<= cut i" is "code <= i"
    code = {s: sum([(F.col(s) > F.lit(x)).cast("int") for x in cuts[s]], F.lit(0)) for s in names}
    coded = rows.select("y", (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("held"),
                        *[code[s].alias(s) for s in names])
    coded = saved(coded.groupBy("y", "held", *names).agg(F.count(F.lit(1)).alias("c")).coalesce(4), "rules-bins")

    def test(s, op, i):
        return (F.col(s) <= i) if op == "<=" else (F.col(s) > i)

    def grow(left: DataFrame) -> list:
        rule, here = [], left.where("not held")
        while len(rule) < MAX_TESTS:
            hist = (here.select("y", "c", F.explode(F.array(*[
                F.struct(F.lit(s).alias("s"), F.col(s).alias("b")) for s in names])).alias("f"))
                .groupBy("f.s", "f.b", "y").agg(F.sum("c").alias("c")).collect())
            table = {s: [[0, 0] for _ in range(len(cuts[s]) + 1)] for s in names}
            for r in hist:
                table[r["s"]][r["b"]][r["y"]] += r["c"]
            n0, p0 = (sum(x[k] for x in table[names[0]]) for k in (0, 1))
            if not n0 or not p0:
                break
            best = None
            for s in names:
                low = [0, 0]
                for i in range(len(cuts[s])):
                    low = [low[k] + table[s][i][k] for k in (0, 1)]
                    for op, (neg, pos) in (("<=", low), (">", [n0 - low[0], p0 - low[1]])):
                        if pos:
                            gain = pos * (math.log2(pos / (pos + neg)) - math.log2(p0 / (p0 + n0)))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, s, op, i)
            if best is None or best[0] <= 1e-9:
                break
            rule.append(best[1:])
            here = here.where(test(*best[1:]))
        return rule

    def cut_back(left: DataFrame, rule: list) -> list:
        hit, sums = F.lit(True), []
        for k, t in enumerate(rule):
            hit = hit & test(*t)
            sums += [F.sum(F.when(hit, F.col("c") * F.col("y")).otherwise(0)).alias(f"p{k}"),
                     F.sum(F.when(hit, F.col("c")).otherwise(0)).alias(f"n{k}")]
        r = left.where("held").agg(*sums).first()
        score = [((r[f"p{k}"] or 0), (r[f"n{k}"] or 0)) for k in range(len(rule))]
        ok = [((2 * p - n) / n, -k) for k, (p, n) in enumerate(score)
              if p >= MIN_COVER and p >= min_precision * n]
        return rule[:1 - max(ok)[1]] if ok else []

    rules, left = [], coded
    while len(rules) < MAX_RULES:
        rule = grow(left)
        rule = cut_back(left, rule) if rule else []
        if not rule:
            break
        rules.append(rule)
        hit = F.lit(True)
        for t in rule:
            hit = hit & test(*t)
        left = left.where(~hit)
    return DecisionList([[(s, op, float(cuts[s][i])) for s, op, i in rule] for rule in rules])


def judge(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    Null text counts as empty (and fails the base rule); repeated rows are each judged; an empty
    table gives no rows.
    """
    stats = saved(text_stats(docs), "rules-stats")
    rules = learn_rules(stats, labels, **kw)
    return stats.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & rules.keeps())


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep, columns unchanged."""
    ids = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id")).distinct()
    labelled = docs.join(ids, docs[id_col] == F.col("l_id"), "left_semi")
    rules = learn_rules(saved(text_stats(labelled, id_col, text_col), "rules-stats"), labels, id_col, **kw)
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    d = with_stats(d.withColumn("text", F.col(f"row.{text_col}")), "text")
    # the row number keeps the filter above the statistics: pushed below them it would repeat
    # their expressions inside one another
    d = d.withColumn("n", F.monotonically_increasing_id())
    return d.where(~base_failed() & rules.keeps() & (F.col("n") >= 0)).select("row.*")
