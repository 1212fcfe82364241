"""How the filters of a pipeline interact: what each removes, alone and after others, in every order.

Each document fails some of the filters. The ids of those that fail the duplicate filter come from
a left-semi join of the table with itself, on hash, exact text and smaller id; they are united
with the ids that fail the others, and the documents of each combination of failures are
counted. These counts, at most 2^k a part, give every order of the k filters.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import Scratch, screen_of, screened, words

#: The failure conditions of (text, its words), by letter; the filter after them fails copies of a text of smaller id.
RULES = {
    "A": lambda t, w: F.size(w) < 100,
    "B": lambda t, w: 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
    "C": lambda t, w: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 10 * F.length(t),
    "D": lambda t, w: t.rlike("[#$%&*|]"),
}
COPIES = "E"


def failures(docs: DataFrame, scratch: Scratch, rules: dict = RULES) -> DataFrame:
    """(id, part, mask, n) for docs (id, part, text): bit i of mask is set if the rule i fails; the bit after, if a row of smaller id has the same text.

    Rows of one id, part and text are one row, counted in n. An id that is null is smaller than none.
    """
    texts = docs.select("id", "part", F.coalesce("text", F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    mask = sum(((F.when(f(F.col("t"), F.col("w")), 1 << i).otherwise(0)) for i, f in enumerate(rules.values())), F.lit(0))
    facts = scratch.table(texts.withColumn("w", words(F.col("t"))).select("id", "part", "h", mask.alias("mask")), "facts")
    several = facts.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("h")
    screen = scratch.table(screen_of(several, "h"), "screen")
    some = screened(texts, "h", screen)
    # one row stands for all of smaller id: that of the least
    first = scratch.table(some.groupBy("h", "t").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").drop("hi"), "first")
    a, b = some.alias("a"), first.alias("b")
    copies = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.t") == F.col("b.t")) & (F.col("b.lo") < F.col("a.id")), "left_semi")
    failed = copies.select("id", "part", "h", F.lit(1 << len(rules)).alias("mask"), F.lit(0).cast("long").alias("n"))
    return facts.withColumn("n", F.lit(1).cast("long")).unionByName(failed).groupBy("id", "part", "h").agg(
        F.bit_or("mask").alias("mask"), F.sum("n").alias("n")).drop("h")


def combinations_of(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each combination of failures, and those of them that are labelled good or toxic."""
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    return failed.join(marks, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def every_order(combos: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of the filters and step of it, from combinations (part, mask, n, good, toxic)."""
    steps = [(("".join(letters[i] for i in p), k + 1, 1 << p[k], sum(1 << i for i in p[:k]))) for p in permutations(range(len(letters))) for k in range(len(p))]
    table = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(own).alias("own"), F.lit(before).alias("before")) for o, k, own, before in steps))
    rows = combos.select("*", F.inline(table))  # a fixed number of rows for each combination
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    count = lambda cond, c="n": F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0)).cast("long")
    first = F.try_divide(F.lit(factorial(len(letters))), F.bit_count("mask"))  # of all orders, those in which one of the failing filters comes first
    return rows.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~gone).alias("kept"), count(fails & ~gone).alias("removed"), count(fails & gone).alias("redundant"), count(F.col("mask") == F.col("own")).alias("unique_fails"),
        count(fails & ~gone, "good").alias("good_lost"), count(fails & ~gone, "toxic").alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, F.col("n") * first.cast("long"))), F.lit(0)).cast("long").alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", rules: dict = RULES) -> DataFrame:
    """For each part, order of the filters and step: how many documents the step keeps and removes, what it would remove of those gone
    before, what only it removes, good and toxic documents lost here, and its share over all orders.

    Null texts are empty; a null part is ''. Rows that repeat an id and a text count each, and none of
    them fails for the other. Labels are read by doc_id, quality and toxic; of several labels of a document the greatest holds. Every part
    has a row for each order and step, with zeros; an empty table gives no rows. Other columns of either table are not read.
    Up to six filters, that of copies included: orders are k factorial.
    """
    if len(rules) > 5:
        raise ValueError("too many filters for all their orders")
    scratch = Scratch(docs.sparkSession, "audit")
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    combos = scratch.table(combinations_of(failures(own, scratch, rules), labels), "combinations")
    scratch.close(combos)
    return every_order(combos, "".join(rules) + COPIES)
