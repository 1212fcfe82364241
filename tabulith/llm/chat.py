"""Chat formatting of reply trees.

Messages point at the message they reply to. Root-to-leaf paths are found by self-joins whose
reach doubles each round, branches are ranked by score, and each chosen path is formatted as
one conversation, with a mask of what a model should learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, let

#: Marks of the template. No role or text holds a bare mark: control strings in them are escaped.
OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>\n"
#: Control strings of the usual chat templates start with one of the last two of these.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def escape(text: Column, rules: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, safe in rules:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, rules: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    for plain, safe in reversed(rules):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def best_paths(replies: DataFrame, scratch: Scratch, per_tree: int = 1) -> DataFrame:
    """(tree, path, msg, up) of the ``per_tree`` best root-to-leaf paths; up counts from the leaf, 0.

    ``replies`` has tree, msg, parent and score, one row for each message. A path's score is the
    mean of its messages'; ties go to the longer path, then to the leaf of least msg. A message
    whose parent is null or missing is a root; messages on a cycle are on no path.

    A table of jumps maps each message to its ancestor 2^i steps up, with the number and the
    scores of the messages passed. Jumps double by a self-join, and so do the chosen paths; there
    are log2 of the longest path of rounds, each ended by a table in the shared folder.
    """
    ids = replies.select("tree", "msg", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = ids.select(F.col("tree").alias("t"), F.col("msg").alias("m"))
    jump = scratch.table(ids.join(known, (ids.tree.eqNullSafe(known.t)) & (ids.parent == known.m), "left").select(
        "tree", "msg", F.col("m").alias("to"), F.lit(1).cast("long").alias("n"), "score"), "jump")
    leaves = ids.select("tree", "msg").join(
        ids.select(F.col("tree").alias("t"), F.col("parent").alias("m")).filter("m IS NOT NULL").distinct(),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m")), "left_anti")
    ends, jumps, most = [jump.filter("to IS NULL").select("tree", "msg", "n", "score")], [], jump.count()
    while True:
        open_ = jump.filter("to IS NOT NULL")
        if 2 ** len(jumps) > most or open_.isEmpty():
            break
        jumps.append(open_.select("tree", "msg", "to"))
        far = jump.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.col("to").alias("far"), F.col("n").alias("more"), F.col("score").alias("plus"))
        jump = scratch.table(open_.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("to") == F.col("m"))).select(
            "tree", "msg", F.col("far").alias("to"), (F.col("n") + F.col("more")).alias("n"), (F.col("score") + F.col("plus")).alias("score"))
            .unionByName(_all(ends)), "jump")
        ends = [jump.filter("to IS NULL").select("tree", "msg", "n", "score")]
    done = _all(ends)
    scored = leaves.alias("l").join(done.alias("d"), F.col("l.tree").eqNullSafe(F.col("d.tree")) & (F.col("l.msg") == F.col("d.msg"))).select(
        "l.tree", "l.msg", "n", (F.col("score") / F.col("n")).alias("mean"))
    rank = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "msg")
    path = scored.withColumn("path", F.row_number().over(rank)).filter(F.col("path") <= per_tree).select(
        "tree", "path", "msg", F.lit(0).cast("long").alias("up"))
    for i, j in enumerate(jumps):
        path = scratch.table(path.unionByName(path.alias("p").join(
            j.alias("j"), F.col("p.tree").eqNullSafe(F.col("j.tree")) & (F.col("p.msg") == F.col("j.msg"))).select(
            "p.tree", "path", F.col("j.to").alias("msg"), (F.col("up") + 2**i).alias("up"))), "path")
    return path


def _all(frames: list[DataFrame]) -> DataFrame:
    return frames[0].select("tree", "msg", F.lit(None).cast(frames[0].schema["msg"].dataType).alias("to"), "n", "score")


def format_trees(texts: DataFrame, replies: DataFrame, *, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """One formatted conversation for each of the best paths of each tree.

    ``texts`` has tree, msg, role and text; ``replies`` tree, msg, parent and score. msg is any
    type that sorts. Null roles and texts are empty. Repeated messages count once; of messages
    with one msg and different texts the first by role and text stands for all. Returns tree,
    path (1 is the best), formatted, and loss: an array of (turn, start, end), the spans of the
    texts of role ``learn``, in code points from the start of their turn's mark (turns from 0).
    Every other column is ignored; empty tables give an empty result.
    """
    scratch = Scratch(texts.sparkSession, "chat")
    replies = scratch.table(replies.select("tree", "msg", "parent", "score").dropDuplicates(["tree", "msg"]), "replies")
    rank = replies.select(F.col("tree").alias("t"), F.col("msg").alias("m"), F.row_number().over(
        Window.partitionBy("tree").orderBy("msg")).alias("rank"))
    path = best_paths(replies, scratch, per_tree)
    order = path.join(rank, F.col("tree").eqNullSafe(F.col("t")) & (F.col("msg") == F.col("m"))).groupBy("tree", "path").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "rank"))).alias("order"))
    held = texts.select("tree", F.struct("msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("x"))
    held = held.groupBy(F.col("tree").alias("t")).agg(F.sort_array(F.collect_list("x")).alias("x"))
    held = held.withColumn("x", F.filter("x", lambda x, i: (i == 0) | (x["msg"] != F.get("x", i - 1)["msg"])))
    rows = order.join(held, F.col("tree").eqNullSafe(F.col("t"))).withColumn(
        "turns", F.transform("order", lambda o: F.element_at("x", o["rank"]))).drop("x", "order")
    rows = rows.withColumn("turns", F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"], ROLE_ESCAPES), F.lit(BREAK)).alias("head"), escape(x["text"]).alias("body"),
        (x["role"] == learn).alias("learn"))))
    span = lambda x, i: F.struct(i.alias("turn"), F.length(x["head"]).alias("start"),
                                 (F.length(x["head"]) + F.length(x["body"])).alias("end"), x["learn"].alias("learn"))
    loss = F.transform(F.filter(F.transform("turns", span), lambda s: s["learn"]), lambda s: s.dropFields("learn"))
    return rows.select("tree", "path", F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
                       loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns, an array of (role, text), and learned, the texts under the mask, read from ``formatted`` and ``loss``."""
    rows = formatted.withColumn("_s", F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.length("formatted") + 1))
    head = lambda s: F.substring_index(s, BREAK, 1)
    turn = lambda s: F.struct(unescape(head(s), ROLE_ESCAPES).alias("role"), unescape(F.substring(
        s, F.length(head(s)) + 2, F.length(s) - F.length(head(s)) - len(BREAK + CLOSE))).alias("text"))
    learned = let(F.col("_s"), lambda s: F.transform("loss", lambda x: unescape(
        F.substring(F.get(s, x["turn"]), x["start"] - len(OPEN) + 1, x["end"] - x["start"]))))
    return rows.withColumns({"turns": F.transform("_s", turn), "learned": learned}).drop("_s")


def linear(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, replies) of conversations (conv_id, turn, role, text): each row replies to the one before.

    Rows come by turn, ties by role and then by a hash of the text; null turns come first. Equal rows are messages each.
    """
    key = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    rows = conversations.select(F.col("conv_id").alias("tree"), key.alias("k"), "role", "text")
    again = F.row_number().over(Window.partitionBy("tree", "k").orderBy("text")) - 1  # of rows that are equal but for a hash's collision
    texts = rows.withColumn("again", again).select("tree", F.struct("k.turn", "k.role", "k.hash", "again").alias("msg"), "role", "text")
    before = F.lag("msg").over(Window.partitionBy("tree").orderBy("msg"))
    return texts, texts.select("tree", "msg", before.alias("parent"), F.lit(0.0).alias("score"))
