"""How far a synthetic table is from the real one. Inputs have ``side`` ('real' or 'syn') and ``run``."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulith.functions.columns import or_missing
from tabulith.operators.encode import bin_by_edges, quantile_edges
from tabulith.operators.profile import exact_quantiles, metric_summary, numbers, range_bounds, range_of, value_distribution

#: Sets of one grouping-sets query.
SETS_AT_ONCE = 40


def categorical_distributions(both: DataFrame, columns: list[str]) -> DataFrame:
    """(run, feature, category, p_real, p_syn) for each synthetic run, over the union of categories, 0 where absent."""
    d = value_distribution(both, columns, ["side", "run"])
    real = d.filter("side = 'real'").select("feature", "category", F.col("probability").alias("p_real"))
    syn = d.filter("side = 'syn'").select("run", "feature", "category", F.col("probability").alias("p_syn"))
    runs = syn.select("run", "feature").distinct()
    return runs.join(real, "feature").join(syn, ["run", "feature", "category"], "full").na.fill(0.0, ["p_real", "p_syn"])


def jsd(both: DataFrame, columns: list[str]) -> DataFrame:
    """(run, feature, value): Jensen-Shannon distance, base 2: 0 for equal, 1 for disjoint distributions."""
    m = (F.col("p_real") + F.col("p_syn")) / 2
    half = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)
    return categorical_distributions(both, columns).groupBy("run", "feature").agg(
        F.sqrt(F.greatest(F.lit(0.0), F.sum(half("p_real") + half("p_syn")) / 2)).alias("value"))


def wasserstein(both: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """(run, feature, value): the area between both ECDFs, in units of the real range (1 where that is 0).

    Signed counts of real and synthetic values are summed in two passes: inside balanced ranges of the
    values, and over the ranges before. Null where a side has no values.
    """
    long = numbers(both, columns, ["side", "run"])
    counts = long.groupBy("side", "run", "feature", F.col("value").alias("v")).agg(F.count("*").alias("n"))
    runs = both.filter("side = 'syn'").select("run").distinct()
    real = counts.filter("side = 'real'").drop("run").crossJoin(F.broadcast(runs))  # runs: a row for each synthetic file
    points = real.select("run", "feature", "v", F.col("n").alias("r"), F.lit(0).cast("long").alias("s")).unionByName(
        counts.filter("side = 'syn'").select("run", "feature", "v", F.lit(0).cast("long").alias("r"), F.col("n").alias("s")))
    points = points.groupBy("run", "feature", "v").agg(F.sum("r").alias("r"), F.sum("s").alias("s"))
    sums = points.groupBy("run", "feature").agg(F.sum("r").alias("nr"), F.sum("s").alias("ns"),
                                                F.min(F.when(F.col("r") > 0, F.col("v"))).alias("rlo"), F.max(F.when(F.col("r") > 0, F.col("v"))).alias("rhi"))
    rows = points.join(F.broadcast(sums), ["run", "feature"]).join(F.broadcast(range_bounds(long, parts)), "feature")  # a row for each column and run
    rows = rows.withColumn("part", range_of(F.col("v"), F.col("bounds"))).drop("bounds")
    diff = F.try_divide("r", "nr") - F.try_divide("s", "ns")
    in_order = Window.partitionBy("run", "feature", "part").orderBy("v")
    rows = rows.withColumn("d", F.sum(diff).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("v").over(in_order))
    ranges = rows.groupBy("run", "feature", "part").agg(F.sum(diff).alias("sum"), F.min("v").alias("first"))
    by_part = Window.partitionBy("run", "feature").orderBy("part")
    ranges = ranges.select("run", "feature", "part", F.coalesce(F.sum("sum").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
                           F.lead("first").over(by_part).alias("after"))
    area = F.abs(F.col("d") + F.col("before")) * (F.coalesce("next", "after", "v") - F.col("v"))
    width = F.when(F.col("rhi") > F.col("rlo"), F.col("rhi") - F.col("rlo")).otherwise(1.0)
    return rows.join(F.broadcast(ranges), ["run", "feature", "part"]).groupBy("run", "feature").agg(
        F.when((F.max("nr") > 0) & (F.max("ns") > 0), F.sum(area) / F.max(width)).alias("value"))


def tail_divergence(both: DataFrame, columns: list[str], *, tau: float = 0.9, grid: int = 200) -> DataFrame:
    """(run, feature, value, status): the largest distance of both ECDFs on a grid from the real tau-quantile to the real maximum.

    Null with status 'degenerate_tail' where the quantile is the maximum, and 'no_data' where a side
    has no values: nothing was measured there. Nulls in a column are left out. Values are dealt to
    grid cells and only these are summed, so nothing is sorted.
    """
    real = both.filter("side = 'real'")
    edge = exact_quantiles(real, columns, [tau, 1.0]).select("feature", F.col("quantiles")[0].alias("q"), F.col("quantiles")[1].alias("top"))
    long = both.select("side", "run", *columns).unpivot(["side", "run"], columns, "feature", "v").filter("v IS NOT NULL").join(F.broadcast(edge), "feature")
    step = (F.col("top") - F.col("q")) / (grid - 1)
    cell = F.when(F.col("top") > F.col("q"), F.greatest(F.lit(0), F.ceil(F.round((F.col("v") - F.col("q")) / step, 9)))).otherwise(0).cast("int")
    counts = long.groupBy("side", "run", "feature", cell.alias("cell")).agg(F.count("*").alias("n"))
    f = F.sum("n").over(Window.partitionBy("side", "run", "feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(
        Window.partitionBy("side", "run", "feature"))
    steps = both.sparkSession.range(grid).select(F.col("id").cast("int").alias("cell"))
    keys = counts.select("side", "run", "feature").distinct()
    full = keys.crossJoin(F.broadcast(steps)).join(counts.withColumn("f", f), ["side", "run", "feature", "cell"], "left")  # grid rows for each column and run
    at = F.coalesce(F.last("f", True).over(Window.partitionBy("side", "run", "feature").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    full = full.select("side", "run", "feature", "cell", at.alias("f"))
    gap = full.filter("side = 'syn'").join(full.filter("side = 'real'").select("feature", "cell", F.col("f").alias("fr")), ["feature", "cell"])
    worst = gap.groupBy("run", "feature").agg(F.max(F.abs(F.col("f") - F.col("fr"))).alias("d"))
    runs = both.filter("side = 'syn'").select("run").distinct()
    out = runs.crossJoin(F.broadcast(edge)).join(worst, ["run", "feature"], "left")
    status = F.when(F.col("top").isNull() | F.col("d").isNull(), "no_data").when(F.col("q") >= F.col("top"), "degenerate_tail").otherwise("ok")
    return out.select("run", "feature", F.when(status == "ok", F.col("d")).alias("value"), status.alias("status"))


def tail_divergence_mean(scores: DataFrame, label: str | None = None) -> DataFrame:
    """(run, value, n_used, n_left_out) over the columns that were measured, without the label."""
    rows = scores.filter(F.col("feature") != label) if label else scores
    return rows.groupBy("run").agg(F.avg("value").alias("value"), F.count("value").alias("n_used"), F.sum(F.col("value").isNull().cast("bigint")).alias("n_left_out"))


def support_subsets(columns: list[str], k: int, most: int = 100) -> list[tuple[str, ...]]:
    """The k-combinations of columns; where there are more than ``most``, those of least digest of their names."""
    import hashlib

    found = list(combinations(columns, k))
    return found if len(found) <= most else sorted(found, key=lambda s: hashlib.md5("|".join(s).encode()).hexdigest())[:most]


def support_coverage(both: DataFrame, numeric: list[str], categorical: list[str], *, k: int = 2, bins: int = 10, rare: float = 0.05,
                     min_rare_count: int = 1, max_rare_count: int | None = None, most: int = 100) -> DataFrame:
    """(run, subset, n_real, n_rare, n_covered, value): the share of rare real combinations that a synthetic run has.

    Numbers are binned by real quantiles, and combinations of ``k`` columns counted; a combination is
    rare if its share of real rows is ``rare`` at most, its count ``min_rare_count`` at least and, if
    given, ``max_rare_count`` at most.
    Rows are first reduced to distinct binned rows with counts; subsets go through in batches of
    grouping sets. value is null where no combination is rare.
    """
    names = [*numeric, *categorical]
    binned = both
    if numeric:
        edges = quantile_edges(both.filter("side = 'real'"), numeric, bins)
        one = edges.groupBy().pivot("feature", numeric).agg(F.first("edges"))  # one row
        binned = both.crossJoin(F.broadcast(one.select(*(F.col(c).alias(f"_e_{c}") for c in numeric))))
    binned = binned.select("side", "run", *(bin_by_edges(F.col(c), F.col(f"_e_{c}")).alias(c) for c in numeric),
                           *(or_missing(F.col(c).cast("string")).alias(c) for c in categorical))
    distinct = binned.groupBy("side", "run", *names).agg(F.count("*").alias("n"))
    subsets, out = support_subsets(names, k, most), None
    for i in range(0, len(subsets), SETS_AT_ONCE):
        part = subsets[i:i + SETS_AT_ONCE]
        combo = F.concat_ws("|", *(F.coalesce(c, F.lit("*")) for c in names))
        subset = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in names))
        sets = distinct.groupingSets([["side", "run", *s] for s in part], "side", "run", *names).agg(F.sum("n").alias("n"), subset.alias("subset")).select(
            "side", "run", "subset", combo.alias("combo"), "n")
        out = sets if out is None else out.unionByName(sets)
    real = out.filter("side = 'real'").withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("subset")))
    is_rare = (F.col("share") <= rare) & F.col("n").between(min_rare_count, max_rare_count or (1 << 62))
    real = real.select("subset", "combo", is_rare.alias("is_rare"))
    runs = both.filter("side = 'syn'").select("run").distinct()
    syn = out.filter("side = 'syn'").select("run", "subset", "combo", F.lit(True).alias("has"))
    hit = real.crossJoin(F.broadcast(runs)).join(syn, ["run", "subset", "combo"], "left")
    n = lambda c: F.sum(c.cast("bigint"))
    return hit.groupBy("run", "subset").agg(F.count("*").alias("n_real"), n(F.col("is_rare")).alias("n_rare"),
                                            n(F.col("is_rare") & F.col("has").isNotNull()).alias("n_covered")).withColumn(
        "value", F.when(F.col("n_rare") > 0, F.col("n_covered") / F.col("n_rare")))


def support_summary(coverage: DataFrame) -> DataFrame:
    """(run, mean, std, n_valid, rare_share) over the subsets that have rare combinations."""
    return coverage.groupBy("run").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_valid"),
                                       (F.sum("n_rare") / F.sum("n_real")).alias("rare_share"))


def association_matrix(df: DataFrame, numeric: list[str], categorical: list[str], by: list[str]) -> DataFrame:
    """(by, a, b, value) for a < b: Pearson for numbers, Cramer's V (bias-corrected) for categories, correlation ratio for mixed pairs.

    Rows with a null in a pair are left out for numbers; a null category is a category. Null where it
    isn't defined: a column that is constant or empty. Without a pair of columns there are no rows. A scan for each kind
    of pair, three in all, for any number of columns.
    """
    cats = df.withColumns({c: or_missing(F.col(c).cast("string")) for c in categorical})
    pairs = [(a, b, f"{a}|{b}") for a, b in combinations(sorted(numeric), 2)]
    out = cats.select(*by, F.lit("").alias("pair"), F.lit(None).cast("double").alias("value")).filter("false")
    if pairs:
        pearson = cats.groupBy(*by).agg(*(F.corr(a, b).alias(name) for a, b, name in pairs))
        out = out.unionByName(pearson.unpivot(by, [name for *_, name in pairs], "pair", "value"))
    if len(categorical) > 1:  # the contingency tables of all pairs, counted in one scan
        each = F.array(*(F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(sorted(categorical), 2)))
        tables = cats.select(*by, F.inline(each)).groupBy(*by, "pair", "x", "y").agg(F.count("*").alias("n"))
        w = lambda *c: Window.partitionBy(*by, "pair", *c)
        t = tables.withColumns({"nx": F.sum("n").over(w("x")), "ny": F.sum("n").over(w("y")), "nn": F.sum("n").over(w())})
        g = t.groupBy(*by, "pair").agg((F.sum(F.col("n") * F.col("n") / (F.col("nx") * F.col("ny"))) - 1).alias("phi2"), F.max("nn").alias("nn"),
                                       F.count_distinct("x").alias("r"), F.count_distinct("y").alias("c"))
        phi = F.greatest(F.lit(0.0), F.col("phi2") - F.try_divide((F.col("r") - 1) * (F.col("c") - 1), F.col("nn") - 1))
        rc, cc = (F.col(x) - F.try_divide(F.pow(F.col(x) - 1, F.lit(2)), F.col("nn") - 1) for x in ("r", "c"))
        least = F.least(rc, cc) - 1
        out = out.unionByName(g.select(*by, "pair", F.when(least > 0, F.sqrt(phi / least)).otherwise(0.0).alias("value")))
    if categorical and numeric:  # sums of all numbers for each category of each column, in one scan
        own = F.inline(F.array(*(F.struct(F.lit(c).alias("_c"), F.col(c).alias("_x")) for c in categorical)))
        groups = cats.select(*by, *(F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(numeric)), own).groupBy(*by, "_c", "_x").agg(*(
            x for i in range(len(numeric)) for x in (F.count(f"_v{i}").alias(f"n{i}"), F.sum(f"_v{i}").alias(f"s{i}"), F.sum(F.col(f"_v{i}") * F.col(f"_v{i}")).alias(f"q{i}"))))
        mean = lambda i: F.try_divide(F.pow(F.sum(f"s{i}"), F.lit(2)), F.sum(f"n{i}"))
        among = lambda i: F.sum(F.try_divide(F.col(f"s{i}") * F.col(f"s{i}"), F.col(f"n{i}"))) - mean(i)
        share = lambda i: F.try_divide(among(i), F.sum(f"q{i}") - mean(i))
        eta = lambda i: F.when(share(i).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), share(i))))
        rows = groups.groupBy(*by, "_c").agg(*(eta(i).alias(f"e{i}") for i in range(len(numeric))))
        long = rows.select(*by, "_c", F.inline(F.array(*(F.struct(F.lit(v).alias("_n"), F.col(f"e{i}").alias("value")) for i, v in enumerate(numeric)))))
        out = out.unionByName(long.select(*by, F.array_join(F.array_sort(F.array("_c", "_n")), "|").alias("pair"), "value"))
    return out.select(*by, F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "value")


def association_distance(both: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(run, value): the Frobenius norm of the difference of both association matrices."""
    m = association_matrix(both, numeric, categorical, ["side", "run"])
    real = m.filter("side = 'real'").select("a", "b", F.col("value").alias("r"))
    gap: Column = F.coalesce("value", F.lit(0.0)) - F.coalesce("r", F.lit(0.0))
    return m.filter("side = 'syn'").join(real, ["a", "b"]).groupBy("run").agg(F.sqrt(2 * F.sum(gap * gap)).alias("value"))  # both triangles


def fidelity_summary(both: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row for each run: summaries of Jensen-Shannon and Wasserstein distances, and the association distance."""
    name = lambda df, p: df.select("run", *(F.col(c).alias(f"{p}_{c}") for c in ("mean", "median", "largest", "worst")))
    j, w = metric_summary(jsd(both, categorical), ["run"]), metric_summary(wasserstein(both, numeric), ["run"])
    return name(j, "jsd").join(name(w, "w1"), "run").join(association_distance(both, numeric, categorical).withColumnRenamed("value", "association"), "run")
