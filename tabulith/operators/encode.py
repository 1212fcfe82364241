"""Encodings: fitted on one table, applied to another, and inverted.

What a fit learns is a small table with a row for each column, category or mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical, let, or_missing, uniform
from tabulith.operators.profile import exact_quantiles, numbers, running_sums
from tabulith.sources.tables import scratch_path


def column_metadata(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature, lo, hi, categories): ranges, and categories from the most frequent on (ties by value)."""
    ranges = df.agg(*(x for c in numeric for x in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))))
    none = F.array().cast("array<string>")
    rows = ranges.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"),
                                                      none.alias("categories")) for c in numeric))).alias("x")).select("x.*")
    slots = category_slots(df, categorical).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("slot", "category"))).alias("c"))
    nothing = F.lit(None).cast("double")
    return rows.unionByName(slots.select("feature", nothing.alias("lo"), nothing.alias("hi"), F.col("c.category").alias("categories")))


def category_slots(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, n, slot): one-hot slots from 0 in descending frequency, ties by value."""
    kinds = dict(df.dtypes)
    long = df.select(*(or_missing(canonical(F.col(c), kinds[c])).alias(c) for c in columns)).unpivot([], columns, "feature", "category")
    counts = long.groupBy("feature", "category").agg(F.count("*").alias("n"))
    ranked = running_sums(counts, ["feature"], [F.desc("n"), F.asc("category")], {"slot": F.lit(1)})
    return ranked.withColumn("slot", (F.col("slot") - 1).cast("int"))


#: The first slots of a dictionary, those of the most frequent categories, that are joined by broadcast.
FREQUENT = 10_000


def join_dictionary(df: DataFrame, own: DataFrame, on: list[str], slot: str, n: int) -> DataFrame:
    """Left join of ``df`` to ``own``, which has one row for each ``on``, with no nulls, and ``n`` slots of a column at most.

    The FREQUENT first slots are joined by broadcast, so rows of a frequent category, which one task would get, are not shuffled. Only where there
    are more slots, rows that found nothing are shuffled to the rest, and the others are dealt by their number. A frequent category that a large
    dictionary lacks is left to Spark's skewed joins.
    """
    names = [c for c in own.columns if c not in on]
    out = df.join(F.broadcast(own.filter(F.col(slot) < FREQUENT)), on, "left")
    if n <= FREQUENT:
        return out
    rest = own.filter(F.col(slot) >= FREQUENT).select(*on, F.lit(0).cast("long").alias("_deal"), *(F.col(c).alias(f"_rest_{c}") for c in names))
    lacks = F.col(names[0]).isNull()
    for c in on:
        lacks = lacks & F.col(c).isNotNull()
    out = out.withColumn("_deal", F.when(lacks, F.lit(0)).otherwise(1 + F.monotonically_increasing_id()))
    kept = [c for c in out.columns if c not in (*names, "_deal")]
    return out.join(rest, [*on, "_deal"], "left").select(*kept, *(F.coalesce(c, f"_rest_{c}").alias(c) for c in names))


def _most(dictionary: DataFrame, slot: str) -> int:
    """One more than the greatest slot."""
    last = dictionary.agg(F.max(slot)).first()[0]
    return 0 if last is None else last + 1


def slot_encode(long: DataFrame, slots: DataFrame) -> DataFrame:
    """(.., feature, category) with ``hot``: 0/1 for each slot of the feature; zeros everywhere for unknown categories."""
    sized = slots.select("feature", "category", "slot").join(slots.groupBy("feature").agg(F.count("*").cast("int").alias("n_slots")), "feature")
    sizes = sized.select("feature", "n_slots").distinct()
    found = join_dictionary(long.join(F.broadcast(sizes), "feature"), sized.drop("n_slots"), ["feature", "category"], "slot", _most(slots, "slot"))  # a row for each column
    return found.withColumn("hot", _hot(F.col("slot"), F.col("n_slots"))).drop("slot", "n_slots")


def slot_decode(encoded: DataFrame, slots: DataFrame) -> DataFrame:
    """(.., feature, hot) with ``decoded``: the category of the greatest entry, the first of equals; null without one above 0."""
    best = F.when(F.array_max("hot") > 0, F.array_position("hot", F.array_max("hot")).cast("int") - 1)
    names = slots.select("feature", F.col("slot").alias("_slot"), F.col("category").alias("decoded"))
    return join_dictionary(encoded.withColumn("_slot", best), names, ["feature", "_slot"], "_slot", _most(slots, "slot")).drop("_slot")


def _hot(slot: Column, size: Column) -> Column:
    """``size`` entries, 1 at ``slot`` and 0 elsewhere; a null slot has no 1."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.coalesce((i == slot).cast("int"), F.lit(0)))


def log_apply(value: Column, least: Column) -> Column:
    """ln x for a positive minimum, ln(x + 1) for 0, ln(x - minimum + 1) below."""
    return F.when(least > 0, F.log(value)).when(least == 0, F.log(value + 1)).otherwise(F.log(value - least + 1))


def log_invert(value: Column, least: Column) -> Column:
    """The inverse, also for positive columns; what falls under 0 where the minimum was 0 is rounded up."""
    plain = F.exp(value) - 1
    return F.when(least > 0, F.exp(value)).when(least == 0, F.when(plain < 0, F.ceil(plain)).otherwise(plain)).otherwise(plain + least)


def label_dictionary(df: DataFrame, column: str) -> DataFrame:
    """(category, code): codes from 0 in ascending order of the category as text."""
    values = df.select(or_missing(canonical(F.col(column), dict(df.dtypes)[column])).alias("category")).distinct()
    return running_sums(values, [], [F.asc("category")], {"code": F.lit(1)}).withColumn("code", (F.col("code") - 1).cast("int"))


def label_encode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Adds ``<column>_code``; categories that the dictionary lacks get null."""
    key = or_missing(canonical(F.col(column), dict(df.dtypes)[column]))
    codes = dictionary.select(F.col("category").alias("_k"), F.col("code").alias(f"{column}_code"))
    return join_dictionary(df.withColumn("_k", key), codes, ["_k"], f"{column}_code", _most(dictionary, "code")).drop("_k")


def label_decode(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Adds ``<column>_label`` for the codes in ``<column>_code``; codes that the dictionary lacks, and null, get null."""
    names = dictionary.select(F.col("code").alias(f"{column}_code"), F.col("category").alias(f"{column}_label"))
    return join_dictionary(df, names, [f"{column}_code"], f"{column}_code", _most(dictionary, "code"))


def one_hot(df: DataFrame, columns: list[str], slots: DataFrame, key: str = "row_key") -> DataFrame:
    """(key, size, indices): each row's one-hot vector over all ``columns``, as the places of its ones among ``size`` entries.

    ``slots`` is a fitted dictionary (:func:`category_slots`); the slots of a column come after those of the columns before it. A
    category that wasn't fitted has no 1. Neither plan nor row grows with the number of categories, and rows of frequent ones are not shuffled.
    """
    kinds, at, places = dict(df.dtypes), 0, []
    sizes = {r.feature: r["count"] for r in slots.groupBy("feature").count().collect()}  # a row for each column
    out = df.select(key, *(or_missing(canonical(F.col(c), kinds[c])).alias(f"_x{i}") for i, c in enumerate(columns)))
    for i, c in enumerate(columns):
        own = slots.filter(F.col("feature") == c).select(F.col("category").alias(f"_x{i}"), F.col("slot").alias(f"_s{i}"))
        out = join_dictionary(out, own, [f"_x{i}"], f"_s{i}", sizes.get(c, 0))
        places.append((F.col(f"_s{i}") + at).cast("int"))
        at += sizes.get(c, 0)
    return out.select(key, F.lit(at).alias("size"), F.array_compact(F.array(*places)).alias("indices"))


def scale_stats(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row with min, max, mean and population deviation of each column."""
    return train.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in columns for n, f in (
        ("lo", F.min), ("hi", F.max), ("mean", F.avg), ("std", F.stddev_pop))))


def minmax(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """To [0, 1] by the fitted range; a range of 0 counts as 1."""
    width = lambda c: F.when(F.col(f"hi_{c}") > F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns),  # stats is one row
                                                   *(((F.col(c) - F.col(f"lo_{c}")) / width(c)).alias(c) for c in columns))


def standardize(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a deviation of 0 counts as 1."""
    std = lambda c: F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)
    return df.crossJoin(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns),
                                                   *(((F.col(c) - F.col(f"mean_{c}")) / std(c)).alias(c) for c in columns))


def range_scale(value: Column, lo: Column, hi: Column) -> Column:
    """To [-1, 1]; 0 where the range is a point."""
    return F.when(hi > lo, 2 * F.try_divide(value - lo, hi - lo) - 1).when(value.isNotNull(), 0.0)


def range_invert(value: Column, lo: Column, hi: Column) -> Column:
    """From [-1, 1], clipped to it."""
    return F.least(F.greatest((value + 1) / 2, F.lit(0.0)), F.lit(1.0)) * (hi - lo) + lo


def reject_out_of_range(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """Rows with every value in its range (nulls pass), and a row with the numbers of rows and of rejected rows."""
    ok = F.lit(True)
    for c, (lo, hi) in bounds.items():
        ok = ok & (F.col(c).isNull() | F.col(c).between(lo, hi))
    return df.filter(ok), df.agg(F.count("*").alias("n_rows"), F.sum((~ok).cast("bigint")).alias("n_rejected"))


def quantile_edges(real: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """(feature, edges): the distinct quantiles of each column, linearly interpolated and exact."""
    steps = [i / bins for i in range(bins + 1)]
    return exact_quantiles(real, columns, steps).select("feature", F.array_distinct("quantiles").alias("edges"))


def bin_by_edges(value: Column, edges: Column) -> Column:
    """How many interior edges are below the value, as text; with one edge at most bin 0; null is missing."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return or_missing(F.when(value.isNotNull(), F.when(F.size(edges) <= 1, 0).otherwise(F.size(F.filter(inner, lambda e: e < value)))).cast("string"))


# ---- mixtures of Gaussians -----------------------------------------------------------------

MODES = "feature string, mode int, weight double, mean double, std double"


def mode_cells(df: DataFrame, columns: list[str], cells: int) -> DataFrame:
    """(feature, cell, value, n): each column in ``cells`` equal-width cells, with the mean of its values in each and their number."""
    long = numbers(df, columns)
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    cell = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (cells - 1))).otherwise(0)
    return long.join(F.broadcast(span), "feature").groupBy("feature", cell.alias("cell")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def responsibilities(hist: DataFrame, arrays: DataFrame) -> DataFrame:
    """(feature, cell, value, n, mode, off, p, best) by mode arrays (feature, modes): the cell's distance from each mode's mean,
    the share of the mode in the cell, and the likeliest mode (the first of equals)."""
    logs = F.transform("modes", lambda x: F.log(x["weight"]) - F.log(x["std"]) - 0.5 * F.pow((F.col("value") - x["mean"]) / x["std"], F.lit(2)))
    rows = hist.join(F.broadcast(arrays), "feature").withColumn("l", logs).withColumn("top", F.array_max("l"))  # a row for each column
    rows = rows.withColumn("e", F.transform("l", lambda x: F.exp(x - F.col("top")))).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return rows.select("feature", "cell", "value", "n", (F.array_position("l", F.col("top")) - 1).cast("int").alias("best"), "sum", "modes", F.posexplode("e")).select(
        "feature", "cell", "value", "n", F.col("pos").alias("mode"), (F.col("value") - F.get("modes", F.col("pos"))["mean"]).alias("off"), (F.col("col") / F.col("sum")).alias("p"), "best")


def mode_fit(df: DataFrame, columns: list[str], *, k: int = 10, cells: int = 2000, rounds: int = 20, least_weight: float = 0.005) -> DataFrame:
    """(feature, mode, weight, mean, std) of a mixture of up to ``k`` Gaussians for each column.

    Expectation maximization in ``rounds`` rounds of an aggregate each: the modes, k rows a column, are broadcast to the cells of
    :func:`mode_cells`, and each mode's sums of weights, values and squares are partly summed where the cells are. It starts from exact quantiles. In the end
    modes of a weight of ``least_weight`` or less go, and those that no cell has as its likeliest; if that leaves none, the heaviest stays. This is
    plain EM with pruning, not a fit with a sparse prior: it may keep more modes than that would. A column without values has no modes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cells")
    made = mode_cells(df, columns, cells)
    made.write.parquet(path)
    hist = spark.read.schema(made.schema).parquet(path)
    spread = numbers(df, columns).groupBy("feature").agg(F.greatest(F.stddev_pop("value"), F.lit(1e-6)).alias("spread"))
    starts = exact_quantiles(df, columns, [(i + 0.5) / k for i in range(k)]).filter("quantiles IS NOT NULL").select("feature", F.array_distinct("quantiles").alias("q"))
    starts = starts.join(spread, "feature").select("feature", "spread", F.posexplode("q").alias("mode", "mean"), F.size("q").alias("k"))
    state = starts.select("feature", "mode", (1 / F.col("k")).alias("weight"), "mean", (F.col("spread") / F.col("k") + 1e-6).alias("std"), "spread").toPandas()  # k rows a column
    state = {(r.feature, r.mode): (r.weight, r.mean, r.std, r.spread) for r in state.itertuples()}

    def arrays() -> DataFrame:
        of: dict[str, list] = {}
        for (feature, mode), (weight, mean, std, _) in sorted(state.items()):
            of.setdefault(feature, []).append((mode, weight, mean, std))
        return spark.createDataFrame(list(of.items()), "feature string, modes array<struct<mode:int,weight:double,mean:double,std:double>>")

    r = F.col("p") * F.col("n")
    for _ in range(rounds):
        sums = responsibilities(hist, arrays()).groupBy("feature", "mode").agg(
            F.sum(r).alias("w"), F.sum(r * F.col("off")).alias("x"), F.sum(r * F.col("off") * F.col("off")).alias("xx"), F.sum("n").alias("all"))
        for s in sums.collect():  # k rows a column; sums around the old mean lose no digits to a large one
            (_, mean, _, spread), mass = state[s.feature, s.mode], s.w + 1e-12
            moved = s.x / mass
            state[s.feature, s.mode] = (mass / s["all"], mean + moved, max(max(s.xx / mass - moved * moved, 0.0) ** 0.5, 1e-3 * spread), spread)
    now = spark.createDataFrame([(f, m, w, mean, std) for (f, m), (w, mean, std, _) in state.items()], MODES)
    used = responsibilities(hist, arrays()).select("feature", F.col("best").alias("mode")).distinct().withColumn("used", F.lit(True))
    rows = now.join(F.broadcast(used), ["feature", "mode"], "left").withColumn("good", F.col("used").isNotNull() & (F.col("weight") > least_weight))
    own = Window.partitionBy("feature")  # k rows
    rows = rows.withColumn("any", F.max("good").over(own)).withColumn("heaviest", F.row_number().over(own.orderBy(F.desc("weight"), "mode")) == 1)
    rows = rows.filter("good OR (NOT any AND heaviest)")
    return rows.select("feature", (F.row_number().over(own.orderBy("mean", "mode")) - 1).cast("int").alias("mode"), (F.col("weight") / F.sum("weight").over(own)).alias("weight"), "mean", "std")


def mode_arrays(modes: DataFrame) -> DataFrame:
    """(feature, modes): the modes of each column as one array, by mode."""
    return modes.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("mode", "weight", "mean", "std"))).alias("modes"))


def mode_apply(long: DataFrame, arrays: DataFrame, *, key: str = "row_key", seed: int = 0) -> DataFrame:
    """(key, feature, value) to (key, feature, mode, u): a mode drawn by responsibility, and the value within it.

    Responsibilities get 1e-6 each and sum to 1; the draw is a hash of key and column. u is
    (value - mean) / (4 std), clipped to 0.99.
    """
    rows = long.join(F.broadcast(arrays), "feature")  # a row for each column
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    density = F.transform("modes", lambda m: m["weight"] / m["std"] * F.exp(-0.5 * F.pow((F.col("value") - m["mean"]) / m["std"], F.lit(2))))
    shares = let(density, lambda p: let(total(p), lambda t: F.transform(p, lambda x: F.when(t > 0, x / t).otherwise(0.0) + 1e-6)))
    draw = uniform(seed, F.concat_ws("|", key, "feature"))
    passed = let(shares, lambda p: let(draw * total(p), lambda u: F.aggregate(  # modes whose running sum the draw passes
        p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["n"] + (s["sum"] + x <= u).cast("int")).alias("n")), lambda s: s["n"])))
    rows = rows.withColumn("mode", F.least(passed, F.size("modes") - 1).cast("int"))
    m = F.element_at("modes", F.col("mode") + 1)
    u = (F.col("value") - m["mean"]) / (4 * m["std"])
    return rows.select(key, "feature", "mode", F.greatest(F.lit(-0.99), F.least(F.lit(0.99), u)).alias("u"))


def mode_one_hot(encoded: DataFrame, arrays: DataFrame) -> DataFrame:
    """(.., feature, mode) with ``hot``: 0/1 for each mode of the feature."""
    sizes = arrays.select("feature", F.size("modes").alias("_n"))
    return encoded.join(F.broadcast(sizes), "feature").withColumn("hot", _hot(F.col("mode"), F.col("_n"))).drop("_n")


def mode_invert(encoded: DataFrame, arrays: DataFrame) -> DataFrame:
    """(.., feature, mode, u) with ``value`` = 4 std u + mean of the mode."""
    rows = encoded.join(F.broadcast(arrays), "feature")
    m = F.element_at("modes", F.col("mode") + 1)
    return rows.withColumn("value", F.col("u") * 4 * m["std"] + m["mean"]).drop("modes")


def mixed_split(long: DataFrame, modal: dict[str, tuple[float, ...]]) -> DataFrame:
    """(.., feature, value) with ``point``: the place of the value in its column's point masses, else null."""
    point = F.lit(None).cast("int")
    for c, values in modal.items():
        for i, v in enumerate(values):
            point = F.when((F.col("feature") == c) & (F.col("value") == v), i).otherwise(point)
    return long.withColumn("point", point)


def mixed_fit(df: DataFrame, modal: dict[str, tuple[float, ...]], **options) -> DataFrame:
    """Mixtures of the columns of ``modal`` without their point masses."""
    rest = df.select(*(F.when(~F.col(c).isin(list(v)), F.col(c)).alias(c) for c, v in modal.items()))
    return mode_fit(rest, list(modal), **options)


def mixed_apply(long: DataFrame, modal: dict[str, tuple[float, ...]], rest: DataFrame, whole: DataFrame, *, key: str = "row_key", seed: int = 0) -> DataFrame:
    """(key, feature, value) to (key, feature, slot, u): point masses have the first slots, the modes of ``rest`` those after.

    A point mass is scaled by the nearest mode (least distance to its mean, the first of equals) of ``whole``, the
    mixture over all values; other values as in :func:`mode_apply`. Both are mode arrays. Null values give no row.
    """
    split = mixed_split(long.filter("value IS NOT NULL"), modal)
    modes = mode_apply(split.filter("point IS NULL").drop("point"), rest, key=key, seed=seed)
    nearest = F.array_min(F.transform("modes", lambda m: F.struct(F.abs(F.col("value") - m["mean"]).alias("far"), m["mode"].alias("mode"),
                                                                 m["mean"].alias("mean"), m["std"].alias("std"))))
    points = split.filter("point IS NOT NULL").join(F.broadcast(whole), "feature").withColumn("_m", nearest)
    u = (F.col("value") - F.col("_m.mean")) / (4 * F.col("_m.std"))
    points = points.select(key, "feature", F.col("point").alias("slot"), F.greatest(F.lit(-0.99), F.least(F.lit(0.99), u)).alias("u"))
    return points.unionByName(modes.select(key, "feature", (F.col("mode") + _points(modal)).cast("int").alias("slot"), "u"))


def mixed_invert(encoded: DataFrame, modal: dict[str, tuple[float, ...]], rest: DataFrame) -> DataFrame:
    """(.., feature, slot, u) with ``value``: the point mass of its slot, or 4 std u + mean of the mode."""
    point = F.lit(None).cast("double")
    for c, values in modal.items():
        for i, v in enumerate(values):
            point = F.when((F.col("feature") == c) & (F.col("slot") == i), F.lit(float(v))).otherwise(point)
    m = F.get("modes", F.col("slot") - _points(modal))
    return encoded.join(F.broadcast(rest), "feature").withColumn("value", F.coalesce(point, F.col("u") * 4 * m["std"] + m["mean"])).drop("modes")


def _points(modal: dict[str, tuple[float, ...]]) -> Column:
    """How many point masses the row's feature has."""
    n = F.lit(0)
    for c, values in modal.items():
        n = F.when(F.col("feature") == c, len(values)).otherwise(n)
    return n


def mode_permute(encoded: DataFrame, order: DataFrame) -> DataFrame:
    """(.., feature, mode) with ``mode`` replaced by its slot in the stored ``order`` of :func:`mode_reorder`; null if it has none."""
    return encoded.join(F.broadcast(order.select("feature", "mode", "slot")), ["feature", "mode"], "left").drop("mode")


def mode_restore(permuted: DataFrame, order: DataFrame) -> DataFrame:
    """The inverse: (.., feature, slot) with the mode that has this slot."""
    return permuted.join(F.broadcast(order.select("feature", "mode", "slot")), ["feature", "slot"], "left").drop("slot")


def mode_reorder(encoded: DataFrame) -> DataFrame:
    """(feature, mode, slot): slots of the modes in descending use, ties by mode. Computed once, when fitting."""
    rank = Window.partitionBy("feature").orderBy(F.desc("n"), "mode")
    return encoded.groupBy("feature", "mode").agg(F.count("*").alias("n")).withColumn("slot", (F.row_number().over(rank) - 1).cast("int"))
