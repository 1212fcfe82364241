"""Splits and samples. Every draw is a function of a seed and a row's key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical, hash_order, or_missing, uniform
from tabulith.operators.profile import running_sums
from tabulith.sources.tables import scratch_path


def stratified_split(df: DataFrame, label: str, ratio: float, *, seed: int, key: str = "row_key") -> DataFrame:
    """Adds ``part``: 'test' for round(ratio * n) rows of each label, those of least hash (ties by key), else 'train'.

    The last test row of each label is searched: counts of the first four digits of the hash give the cell it is in, and only the rows of that cell, one
    in 65,536, are ranked. These last rows, one a label, are written to the shared folder, and what remains is a comparison in each row: no row is shuffled.
    """
    spark, cell = df.sparkSession, F.substring(hash_order(seed, key), 1, 4)
    size = df.groupBy(label, cell.alias("_c")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(label).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))  # 65,536 cells a label at most
    size = size.withColumn("_quota", F.round(F.lit(ratio) * F.sum("_n").over(Window.partitionBy(label)))).withColumn("_upto", upto)
    edge = size.filter((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_n") < F.col("_quota"))).select(
        F.col(label).alias("_l"), F.col("_c").alias("_z"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    rows = df.select(F.col(label).alias("_label"), F.col(key).alias("_key"), hash_order(seed, key).alias("_h"))
    rows = rows.join(F.broadcast(edge), F.col("_label").eqNullSafe(F.col("_l")) & (F.substring("_h", 1, 4) == F.col("_z")))  # a row for each label
    rank = F.row_number().over(Window.partitionBy("_label").orderBy("_h", "_key"))
    last = rows.withColumn("_r", rank).filter(F.col("_r") == F.col("_need")).select("_l", F.struct("_h", "_key").alias("_last"))
    path = scratch_path(spark, "split")
    last.write.parquet(path)
    last = spark.read.schema(last.schema).parquet(path)
    out = df.join(F.broadcast(last), F.col(label).eqNullSafe(F.col("_l")), "left")  # a label without test rows has none
    part = F.when(F.struct(hash_order(seed, key).alias("_h"), F.col(key).alias("_key")) <= F.col("_last"), "test").otherwise("train")
    return out.select(*df.columns, part.alias("part"))


def random_split(df: DataFrame, ratio: float, *, seed: int, key: str = "row_key") -> DataFrame:
    """Adds ``part``, 'test' with probability ``ratio``; no shuffle."""
    return df.withColumn("part", F.when(uniform(seed, key) < ratio, "test").otherwise("train"))


def sample_n(df: DataFrame, n: int, *, seed: int, key: str = "row_key") -> DataFrame:
    """``n`` rows, those of least hash (ties by key), or all if there are fewer.

    The hash that n rows are under is searched, not sorted for: a histogram of its first four digits gives the cell where the count passes n, one of
    the next four that cell's part; rows before are a filter, and only those of this part, one in 4 billion of the table, are put in order.
    """
    rows = df.withColumn("_h", hash_order(seed, key))
    below, prefix = 0, ""
    for digits in (4, 8):
        cell = F.substring("_h", 1, digits)
        counts = rows.filter(F.col("_h").startswith(prefix)).groupBy(cell.alias("cell")).agg(F.count("*").alias("c"))  # 65,536 rows at most
        upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).filter(F.col("upto") > n - below).agg(F.min(F.struct("cell", F.col("upto") - F.col("c"))).alias("x")).first()["x"]
        if hit is None:
            return df
        prefix, below = hit[0], below + hit[1]
    sure = rows.filter(F.col("_h") < prefix)
    rank = F.row_number().over(Window.partitionBy(F.substring("_h", 1, 8)).orderBy("_h", key))
    edge = rows.filter(F.col("_h").startswith(prefix)).withColumn("_r", rank).filter(F.col("_r") <= n - below).drop("_r")
    return sure.unionByName(edge).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, *, seed: int, key: str = "row_key") -> DataFrame:
    return df.filter(uniform(seed, key) < fraction)


def condition_tables(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, n, p, p_log, upto, upto_log): frequencies and log-frequencies of options, and their running sums."""
    kinds = dict(df.dtypes)
    long = df.select(*(or_missing(canonical(F.col(c), kinds[c])).alias(c) for c in columns)).unpivot([], columns, "feature", "category")
    counts = long.groupBy("feature", "category").agg(F.count("*").alias("n")).withColumn("_log", F.log(F.col("n") + 1))
    sums = running_sums(counts, ["feature"], [F.asc("category")], {"_upto": F.col("n"), "_upto_log": F.col("_log")})
    totals = sums.groupBy("feature").agg(F.sum("n").alias("_n"), F.sum("_log").alias("_all"), F.max("_upto_log").alias("_top"))
    return sums.join(F.broadcast(totals), "feature").select(  # a row for each column
        "feature", "category", "n", (F.col("n") / F.col("_n")).alias("p"), (F.col("_log") / F.col("_all")).alias("p_log"),
        (F.col("_upto") / F.col("_n")).alias("upto"), (F.col("_upto_log") / F.col("_top")).alias("upto_log"))


def guide(intervals: DataFrame, by: list[str], parts: str) -> DataFrame:
    """``intervals`` (by, lo, hi, ..) that tile [0, 1) in each ``by``, with ``cell``: one row for each of the ``parts`` equal cells that an interval meets.

    A number u is looked up by an equality on (by, floor(u * parts)) and lo <= u < hi. With as many cells as intervals
    there are under two rows a cell on average, however uneven the intervals are.
    """
    last = F.greatest(F.col("lo") * F.col(parts), F.least(F.ceil(F.col("hi") * F.col(parts)) - 1, F.col(parts) - 1))
    return intervals.withColumn("cell", F.explode(F.sequence(F.floor(F.least(F.col("lo") * F.col(parts), F.col(parts) - 1)).cast("int"), F.floor(last).cast("int"))))


def draw_conditions(spark, n: int, tables: DataFrame, columns: list[str], *, seed: int, weight: str = "upto", start: int = 0) -> DataFrame:
    """(draw, feature, category): a column uniformly, then an option by weight (``upto`` or ``upto_log``). Draws are numbered from ``start``.

    An option is found through a :func:`guide` with as many cells as the column has options, so that a draw costs the same however many there are.
    """
    draws = spark.range(start, start + n).withColumnRenamed("id", "draw")
    names = F.array(*(F.lit(c) for c in columns))
    draws = draws.select("draw", F.element_at(names, (F.floor(uniform(seed, "draw") * len(columns)) + 1).cast("int")).alias("feature"),
                         uniform(seed + 1, "draw").alias("u"))
    before = {"upto": "p", "upto_log": "p_log"}[weight]
    sizes = tables.groupBy("feature").agg(F.count("*").cast("int").alias("options"))
    top = F.when(F.col(weight) >= 1 - 1e-12, 1.0).otherwise(F.col(weight))
    ranges = tables.select("feature", "category", F.greatest(F.col(weight) - F.col(before), F.lit(0.0)).alias("lo"), top.alias("hi")).join(F.broadcast(sizes), "feature")
    # sums of shares are off by a rounding: cells reach a little further, and of two options that touch the draw the first above it counts
    wide = ranges.withColumns({"lo": F.greatest(F.col("lo") - 1e-9, F.lit(0.0))})
    found = guide(wide, ["feature"], "options").select("feature", "cell", "category", "hi")
    at = draws.join(F.broadcast(sizes), "feature").withColumn("cell", F.least(F.floor(F.col("u") * F.col("options")), F.col("options") - 1).cast("int"))  # a row for each column
    hit = at.join(found, ["feature", "cell"]).filter("hi > u")
    return hit.groupBy("draw", "feature").agg(F.min_by("category", "hi").alias("category"))


def conditional_rows(df: DataFrame, drawn: DataFrame, columns: list[str], *, seed: int, key: str = "row_key", parts: int = 64) -> DataFrame:
    """(draw, feature, category, key): for each drawn condition a uniform row that meets it, with replacement.

    Rows of an option are numbered in slices by hash; a draw picks a number among all rows of
    the option and finds its slice through a :func:`guide`, so no option is in one task and no draw meets all slices.
    """
    kinds = dict(df.dtypes)
    long = df.select(key, *(or_missing(canonical(F.col(c), kinds[c])).alias(c) for c in columns)).unpivot([key], columns, "feature", "category")
    long = long.withColumn("slice", F.floor(uniform(seed + 7, F.col(key)) * parts).cast("int"))
    numbered = long.withColumn("_r", F.row_number().over(Window.partitionBy("feature", "category", "slice").orderBy(key)))
    sizes = long.groupBy("feature", "category", "slice").agg(F.count("*").alias("n"))
    option = Window.partitionBy("feature", "category")  # a row for each slice
    sizes = sizes.withColumn("upto", F.sum("n").over(option.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(option))
    tiles = sizes.withColumns({"lo": (F.col("upto") - F.col("n")) / F.col("total"), "hi": F.col("upto") / F.col("total"), "cells": F.lit(parts)})
    tiles = guide(tiles, ["feature", "category"], "cells").select("feature", "category", "cell", "slice", "upto", "n")
    totals = sizes.groupBy("feature", "category").agg(F.max("total").alias("total"))
    pick = drawn.join(totals, ["feature", "category"]).withColumn("_k", F.floor(uniform(seed + 3, "draw") * F.col("total")) + 1)
    pick = pick.withColumn("cell", F.floor((F.col("_k") - 1) / F.col("total") * parts).cast("int")).join(tiles, ["feature", "category", "cell"])
    pick = pick.filter((F.col("_k") <= F.col("upto")) & (F.col("_k") > F.col("upto") - F.col("n"))).withColumn("_r", (F.col("_k") - F.col("upto") + F.col("n")).cast("int"))
    return pick.join(numbered, ["feature", "category", "slice", "_r"]).select("draw", "feature", "category", key)
