"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Rows are grouped by hash alone, which moves some tens of bytes a row. The texts of hashes that
several rows have are then compared: they are grouped by hash and text, copies inside a task
meet before the shuffle, and a hash that has two texts is a collision. Texts of other hashes
stay where they are: a bitmap of fixed size screens them out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulith.llm.common import SPACE, Scratch, join_on_hot_key, screen_of, screened


def one_spaced(text: Column) -> Column:
    """The text with each run of white space as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", form: Callable[[Column], Column] = one_spaced,
                 digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Every row with the row that stays of those with an equal text, under ``form``.

    Returns ``id_col``, keep_id (the least id of the group, null only if the group has no other), group_size, kept and
    text_sha256 (of the text under ``form``). Exactly one row of a group is kept: that of the least id, and of several rows of this
    id any one. Null texts are empty, and empty texts are equal. Empty tables give an empty result. Other columns are
    not read, so their names don't matter; texts may be of any length that a row can have.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    texts = docs.select(F.col(id_col).alias("id"), form(F.col(text_col)).alias("t")).withColumn("h", digest("t"))
    rows = scratch.table(texts.select("id", F.monotonically_increasing_id().alias("row"), "h", F.sha2("t", 256).alias("sha")), "rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = scratch.table(rows.groupBy("h").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    screen = scratch.table(screen_of(groups, "h"), "screen")
    distinct = screened(texts.select("h", "t"), "h", screen).groupBy("h", "t").agg(F.count("*").alias("n"))
    collided = scratch.table(distinct.groupBy("h").agg(F.count("*").alias("texts")).filter("texts > 1").select("h"), "collided")
    scratch.drop(screen)
    n = max(rows.count(), 1)
    if collided.isEmpty():
        scratch.close(rows, groups)
        out = join_on_hot_key(rows, groups, "h", "n", n).select("id", "row", "sha", "first", "n")
    else:
        own = scratch.table(texts.join(collided, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "own")
        apart = own.join(own.groupBy("h", "t").agg(first.alias("first"), F.count("*").alias("n")), ["h", "t"])
        others = join_on_hot_key(rows.join(collided, "h", "left_anti"), groups.join(collided, "h", "left_anti"), "h", "n", n)
        scratch.close(rows, groups, collided, own)
        out = others.select("id", "row", "sha", "first", "n").unionByName(apart.select("id", "row", F.sha2("t", 256).alias("sha"), "first", "n"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
                      F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      (F.col("n").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"))
