"""Profiles of a table: missing values, distributions, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical, or_missing
from tabulith.sources.tables import scratch_path


def _null(df: DataFrame, c: str) -> Column:
    """Null, or for floats also NaN and infinities."""
    missing = F.col(c).isNull()
    return missing | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) if dict(df.dtypes)[c] in ("double", "float") else missing


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, n_missing, pct) of each column in one pass; infinities count as missing."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("_n"), *(F.coalesce(F.sum(_null(df, c).cast("bigint")), F.lit(0)).alias(c) for c in columns))
    return one.unpivot(["_n"], list(columns), "feature", "n_missing").select(
        "feature", "n_missing", F.when(F.col("_n") > 0, F.round(100.0 * F.col("n_missing") / F.col("_n"), 2)).alias("pct"))


def total_missing_pct(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing cells in percent of all cells."""
    columns = columns or df.columns
    return null_profile(df, columns).agg(F.sum("n_missing").alias("n_missing")).crossJoin(F.broadcast(df.agg(F.count("*").alias("n_rows")))).select(
        "n_missing", F.round(100.0 * F.col("n_missing") / (F.col("n_rows") * len(columns)), 6).alias("pct"))


def null_count(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Missing cells of a row."""
    return reduce(lambda a, b: a + b, (_null(df, c).cast("int") for c in columns or df.columns))


def rows_with_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """How many rows have a missing cell, and in percent. For samples, filter on :func:`null_count`."""
    hit = (null_count(df, columns) > 0).cast("bigint")
    return df.agg(F.count("*").alias("n_rows"), F.sum(hit).alias("n_with_null"), F.round(100.0 * F.sum(hit) / F.count("*"), 6).alias("pct"))


def sample_with_null(df: DataFrame, key: str, n: int, columns: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of least key that have a missing cell, with ``n_missing``: a look at them, as the count is :func:`rows_with_null`."""
    return df.withColumn("n_missing", null_count(df, columns)).filter("n_missing > 0").orderBy(key).limit(n)


def peek(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First and last ``n`` rows by a key, with ``at``: 'head' or 'tail'."""
    return df.orderBy(key).limit(n).withColumn("at", F.lit("head")).unionByName(
        df.orderBy(F.desc(key)).limit(n).withColumn("at", F.lit("tail")))


def value_distribution(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, feature, category, n, probability); a null is a category."""
    by, kinds = by or [], dict(df.dtypes)
    long = df.select(*by, *(or_missing(canonical(F.col(c), kinds[c])).alias(c) for c in columns)).unpivot(by, columns, "feature", "category")
    counts = long.groupBy(*by, "feature", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*by, "feature").agg(F.sum("n").alias("_of")).withColumnsRenamed({c: f"_{c}" for c in [*by, "feature"]})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "feature"]]
    return counts.join(F.broadcast(totals), same).select(*by, "feature", "category", "n", (F.col("n") / F.col("_of")).alias("probability"))  # a row for each column and group


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """The ``n`` most frequent values, ties by value; a null counts as a value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def histogram(df: DataFrame, columns: list[str], bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """(by, feature, bin, lo, width, n, density) of equal-width bins over each column's whole range, last bin closed.

    The range is shared by all groups of ``by``, so that bars of different groups line up.
    """
    by = by or []
    long = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(by, columns, "feature", "value").filter("value IS NOT NULL")
    span = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))  # a row for each column
    binned = long.join(F.broadcast(span), "feature").withColumn("width", (F.col("hi") - F.col("lo")) / bins).withColumn(
        "bin", F.when(F.col("width") > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.col("width")), F.lit(bins - 1))).otherwise(0).cast("int"))
    counts = binned.groupBy(*by, "feature", "bin", "lo", "width").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by, "feature"))
    return counts.withColumn("density", F.when(F.col("width") > 0, F.col("n") / (total * F.col("width"))))


def rare_class(df: DataFrame, label: str) -> DataFrame:
    """The least frequent label (ties: the smaller), its rows, and how many labels there are."""
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by(label, F.struct("n", label)).alias("rare_label"), F.min("n").alias("n_rows"), F.count("*").alias("n_classes"))


#: Ranks of a quantile sketch are right to one in so many.
SKETCH = 10_000
#: Half the width of the bracket around a quantile, as a share of the rows: the first that is over the sketch's error and two rows.
SLACKS = (0.0015, 0.02, 0.3, 1.0)


#: log2 of the ranges of a column, at most.
STEPS = 14


def range_bounds(long: DataFrame, parts: int | None = None) -> DataFrame:
    """(feature, bounds) of (feature, value): values that cut each feature into ranges of about as many rows, from a mergeable sketch.

    As many ranges as there are shuffle partitions, 64 at least and 2^STEPS at most. Equal bounds count once, so a value that fills several ranges is in one.
    """
    parts = min(1 << STEPS, max(2, parts or max(64, int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    inner = F.percentile_approx("value", [i / parts for i in range(1, parts)], SKETCH)
    return long.groupBy("feature").agg(F.array_distinct(inner).alias("bounds"))


def range_of(value: Column, bounds: Column) -> Column:
    """The number of the value's range: how many bounds, which ascend and are under 2^STEPS, are not above it. A binary search: its time doesn't grow with the ranges."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(STEPS))))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at))


def numbers(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, feature, value): the values of the columns that are no null, one to a row."""
    by = by or []
    return df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(by, columns, "feature", "value").filter("value IS NOT NULL")


def running_counts(df: DataFrame, columns: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """(by, feature, value, n, upto, total): counts of each value and of values up to it.

    A two-pass prefix sum: distinct values are counted, dealt to balanced ranges (:func:`range_bounds`),
    and summed inside the ranges; the totals of the ranges before are added. No column is in one task, however its values lie.
    """
    by = by or []
    long = numbers(df, columns, by)
    counts = long.groupBy(*by, "feature", "value").agg(F.count("*").alias("n")).join(F.broadcast(range_bounds(long, parts)), "feature")  # a row for each column
    counts = counts.withColumn("_part", range_of(F.col("value"), F.col("bounds"))).drop("bounds")
    ranges = counts.groupBy(*by, "feature", "_part").agg(F.sum("n").alias("_of"))  # a row for each range of a column
    before = F.coalesce(F.sum("_of").over(Window.partitionBy(*by, "feature").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).withColumn("total", F.sum("_of").over(Window.partitionBy(*by, "feature"))).drop("_of")
    inside = F.sum("n").over(Window.partitionBy(*by, "feature", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_in", inside).join(F.broadcast(ranges), [*by, "feature", "_part"]).select(
        *by, "feature", "value", "n", (F.col("_in") + F.col("_before")).alias("upto"), "total")


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """(feature, quantiles): exact quantiles of each column, interpolated linearly between neighbours; null without values.

    A selection by brackets, in two scans. Of each quantile a sketch gives bounds that it is surely between; then values in a
    bracket are gathered, some per mille of all in a large table, and those outside only counted. So no distinct values are shuffled,
    and one task holds those of one bracket. If a sketch were ten times further off than it says, the query ends with an error.
    """
    at = lambda p, d: min(1.0, max(0.0, p + d))
    order = sorted(range(len(shares)), key=lambda i: shares[i])
    points = [[[at(shares[i], d) for i in order] for d in (-slack, slack)] for slack in SLACKS]
    number = {c: F.col(c).cast("double") for c in columns}
    row = df.agg(*(x for k, c in enumerate(columns) for x in (  # the bounds of the brackets: one row
        F.percentile_approx(number[c], [p for two in points for side in two for p in side], SKETCH).alias(f"q{k}"), F.count(number[c]).alias(f"n{k}"),
        F.min(number[c]).alias(f"lo{k}"), F.max(number[c]).alias(f"hi{k}")))).first()
    spark, k, dealt = df.sparkSession, len(shares), []
    for j, c in enumerate(columns):
        if not row[f"n{j}"]:
            continue
        use = next(i for i, slack in enumerate(SLACKS) if slack == 1.0 or slack >= 10 / SKETCH + 2 / row[f"n{j}"])
        found = row[f"q{j}"][2 * k * use:]
        los = [row[f"lo{j}"] if p == 0.0 else x for p, x in zip(points[use][0], found, strict=False)]
        his = [row[f"hi{j}"] if p == 1.0 else x for p, x in zip(points[use][1], found[k:], strict=False)]
        held = None  # the cell of a value is how many brackets begin up to it; in a cell, what is in a bracket comes before what isn't
        for i in reversed(range(k)):
            if i == k - 1 or los[i] < los[i + 1]:
                inside = F.struct(F.lit(i + 1).alias("cell"), F.when(number[c] <= max(his[:i + 1]), number[c]).alias("value"))
                held = F.when(number[c] >= los[i], inside) if held is None else held.when(number[c] >= los[i], inside)
        held = held.when(number[c].isNotNull(), F.struct(F.lit(0).alias("cell"), F.lit(None).cast("double").alias("value")))
        dealt.append(F.struct(F.lit(c).alias("feature"), held.alias("x")))
    nothing = F.array().cast("array<struct<feature:string,x:struct<cell:int,value:double>>>")
    rows = df.select(F.inline(F.array(*dealt) if dealt else nothing)).filter("x IS NOT NULL").select("feature", "x.cell", "x.value")
    counts = rows.groupBy("feature", "cell", "value").agg(F.count("*").alias("n"))
    cells = counts.groupBy("feature", "cell").agg(F.sum("n").alias("_of"))  # a row for each quantile
    before = F.coalesce(F.sum("_of").over(Window.partitionBy("feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).withColumn("total", F.sum("_of").over(Window.partitionBy("feature"))).drop("_of")
    inside = F.sum("n").over(Window.partitionBy("feature", "cell").orderBy(F.asc_nulls_last("value")).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("_in", inside).join(F.broadcast(cells), ["feature", "cell"]).withColumn("upto", F.col("_in") + F.col("_before"))
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at")) for i, p in enumerate(shares)))
    here = lambda at: (F.col("upto") - F.col("n") <= at) & (at < F.col("upto"))
    near = counts.select("feature", "value", "n", "upto", F.inline(F.filter(wanted, lambda w: here(F.floor(w["at"])) | here(F.ceil(w["at"])))))
    value = F.when(F.col("value").isNotNull(), F.col("value")).otherwise(F.raise_error(F.lit("a quantile is outside its bracket")).cast("double"))
    two = near.withColumn("value", value).groupBy("feature", "i").agg(F.max(F.when(here(F.floor("at")), F.col("value"))).alias("a"), F.max(F.when(here(F.ceil("at")), F.col("value"))).alias("b"),
                                                                      F.max(F.col("at") - F.floor("at")).alias("over"))  # two rows at most
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("over"))
    found = two.select("feature", F.struct("i", value.alias("v")).alias("q")).groupBy("feature").agg(F.array_sort(F.collect_list("q"))["v"].alias("quantiles"))
    return spark.createDataFrame([(c,) for c in columns], "feature string").join(found, "feature", "left")


def running_sums(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum over the rows up to this one, by ``order`` within each ``by``.

    Rows are dealt to ranges of (by, order) and summed inside them; the totals of the ranges before are added. So a group of any size, or
    a whole table (no ``by``), is in as many tasks as there are ranges. The order must tell rows apart. The dealt rows are written to the shared folder.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by, *order).withColumn("_p", F.spark_partition_id())
    path = scratch_path(spark, "ranges")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path)
    whole = [F.lit(0)] if not by else by
    totals = dealt.groupBy(*by, "_p").agg(*(F.sum(x).alias(f"_of_{c}") for c, x in sums.items()))  # a row for each range of a group
    earlier = Window.partitionBy(*whole).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*(F.col(c).alias(f"_{c}") for c in [*by, "_p"]), *(F.coalesce(F.sum(f"_of_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumns({f"_in_{c}": F.sum(x).over(inside) for c, x in sums.items()})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*by, "_p"]]
    return rows.join(F.broadcast(totals), same).select(*df.columns, *((F.col(f"_in_{c}") + F.col(f"_before_{c}")).alias(c) for c in sums))


def ecdf(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, feature, value, f): the share of values up to each value."""
    return running_counts(df, columns, by).withColumn("f", F.col("upto") / F.col("total"))


def metrics_wide(long: DataFrame, metrics: list[str]) -> DataFrame:
    """One row for each run, one column for each of ``metrics``."""
    return long.groupBy("run").pivot("metric", metrics).agg(F.first("value"))


def average_over_runs(long: DataFrame) -> DataFrame:
    """Mean and sample deviation over runs, with how many runs there are and how many differ."""
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.count_distinct("run").alias("n_runs"),
                                      F.count_distinct("value").alias("n_distinct"))


def equal_runs(long: DataFrame) -> DataFrame:
    """(run, same_as): the least run that equals this one in every metric, itself if there is none; nulls equal nulls."""
    runs = long.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("metric", "value"))).alias("metrics"))  # the metrics of one run
    return runs.select("run", F.min("run").over(Window.partitionBy("metrics")).alias("same_as"))


def weighted_rollup(importance: DataFrame, layout: DataFrame, label: str | None = None) -> DataFrame:
    """Importance of encoded columns (role, weight) summed to source columns by ``layout`` (role, feature)."""
    out = importance.join(layout, "role").groupBy("feature").agg(F.sum("weight").alias("weight"))
    return out.filter(F.col("feature") != label) if label else out


def metric_summary(scores: DataFrame, by: list[str]) -> DataFrame:
    """Mean, median, largest value and its feature, for each group of ``by``; ties to the smaller name."""
    return scores.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        F.avg("value").alias("mean"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("largest"),
        F.min_by("feature", F.struct(-F.col("value"), F.col("feature"))).alias("worst"), F.count("*").alias("n_features"))
