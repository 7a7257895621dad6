"""Chat formatting over reply trees.

Messages point at the message they answer.  Pointer-doubling self-joins give every message its
root, depth and the score of its branch in ``log2(depth)`` rounds; leaves are ranked by branch
score inside their tree; going back down the same jump tables marks every message of the chosen
root-to-leaf paths once.  Each path is then formatted as one conversation.

Template: every turn is ``<turn>role<text>text</turn>`` and a newline.  Inside role and text a
backslash is written ``\\b`` and ``<`` is written ``\\l``, so a bare ``<`` is always the
template's and the text comes back exactly.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slicewise.llm.common import saved

OPEN, MIDDLE, CLOSE = "<turn>", "<text>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``path, tree, depth, id`` of every message on the best ``branches`` paths of each root.

    ``messages``: ``tree, id, parent, score``; ``(tree, id)`` names a message.  A branch's score is
    the sum over its messages (null: 0), ties go to the smaller leaf id.  A parent that does not
    exist makes the message a root.  Messages that answer each other in a circle have no root and
    so lie on no path.  Repeated ids are the caller's to resolve (see :func:`from_turns`).
    """
    name = lambda c: F.concat(F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit("n")),
                              F.lit("|"), F.col(c).cast("string"))
    nodes = saved(messages.select("tree", "id", name("id").alias("node"), name("parent").alias("up"),
                                  F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")), "chat-nodes")
    known = nodes.select(F.col("node").alias("up"), F.lit(True).alias("known"))
    links = nodes.join(known, "up", "left").select(
        "tree", "id", "node", F.when(F.col("known"), F.col("up")).alias("up"), "score")
    # one round doubles the distance: (node, up) jumps over 2^k messages, steps and total are
    # what has been passed so far
    jump = saved(links.select("node", "up", F.lit(1).cast("long").alias("steps"),
                              F.col("score").alias("total"), F.col("node").alias("root")), "chat-jump")
    jumps, rounds = [jump], 2 + max(1, math.ceil(math.log2(1 + nodes.count())))
    while len(jumps) <= rounds and not jump.where("up is not null").isEmpty():
        far = jump.select(F.col("node").alias("up"), F.col("up").alias("up2"),
                          F.col("steps").alias("steps2"), F.col("total").alias("total2"),
                          F.col("root").alias("root2"))
        jump = saved(jump.join(far, "up", "left").select(
            "node", F.col("up2").alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
            F.coalesce("root2", "root").alias("root")), "chat-jump")
        jumps.append(jump)
    done = jump.where("up is null").select("node", "root", "total", F.col("steps").alias("depth"))
    leaves = (links.join(links.select(F.col("up").alias("node")).where("node is not null").distinct(),
                         "node", "left_anti").select("node", "id").join(done, "node"))
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.desc("total"), "id"))
    best = leaves.withColumn("rank", rank).where(F.col("rank") <= branches)
    marked = best.select(F.col("node").alias("path"), "node")
    for j in reversed(jumps):
        up = j.where("up is not null").select("node", "up")
        marked = saved(marked.unionByName(
            marked.join(up, "node").select("path", F.col("up").alias("node"))), "chat-marked")
    return (marked.join(done.select("node", "depth"), "node")
            .join(nodes.select("node", "tree", "id"), "node").select("path", "tree", "depth", "id"))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each row answers the row before it in its conversation.

    Order inside a conversation: turn (null first), role, text; so repeated turns have a fixed
    place and every row is a message of its own.  Null role or text counts as empty.
    """
    t = conversations.select(F.col("conv_id").alias("tree"), "turn",
                             F.coalesce("role", F.lit("")).alias("role"),
                             F.coalesce("text", F.lit("")).alias("text"))
    rn = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return t.select("tree", rn.cast("long").alias("id"), "role", "text",
                    F.lit(1.0).alias("score")).withColumn(
        "parent", F.when(F.col("id") > 1, F.col("id") - 1))


def format_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree, path, formatted, loss_from, loss_to`` per chosen path.

    The loss mask is the code-point ranges ``[from, to)`` of the assistant texts inside
    ``formatted``, in order.
    """
    paths = chosen_paths(messages, branches)
    m = messages.select(F.col("tree").alias("m_tree"), F.col("id").alias("m_id"), "role", "text")
    full = paths.join(m, F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("id") == F.col("m_id")))
    head = F.concat(F.lit(OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(MIDDLE))
    body = escape(F.coalesce("text", F.lit("")))
    full = full.select("path", "tree", "depth", (F.col("role") == "assistant").alias("learn"),
                       F.concat(head, body, F.lit(CLOSE)).alias("piece"),
                       F.length(head).alias("before"), F.length(body).alias("inside"))
    # start of each piece: running length over the conversation's turns
    run = Window.partitionBy("path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(run), F.lit(0)).cast("long"))
    g = full.groupBy("path").agg(
        F.first("tree").alias("tree"),
        F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("pieces"),
        F.array_sort(F.collect_list(F.when(F.coalesce("learn", F.lit(False)), F.struct(
            (F.col("at") + F.col("before")).alias("a"),
            (F.col("at") + F.col("before") + F.col("inside")).alias("b"))))).alias("mask"))
    return g.select("tree", "path", F.concat_ws("", F.transform("pieces", lambda p: p["piece"])).alias("formatted"),
                    F.transform("mask", lambda p: p["a"]).alias("loss_from"),
                    F.transform("mask", lambda p: p["b"]).alias("loss_to"))


def read_turns(formatted: Column) -> Column:
    """Array of ``(role, text)`` read back from a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(p, MIDDLE, -1)).alias("text")))


def masked_texts(formatted: Column, loss_from: Column, loss_to: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return F.transform(F.arrays_zip(loss_from.alias("a"), loss_to.alias("b")), lambda s: unescape(
        F.substr(formatted, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
