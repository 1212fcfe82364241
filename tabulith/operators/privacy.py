"""How near synthetic rows come to real ones, and what a ledger of noise adds up to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical
from tabulith.operators.neighbours import PivotIndex, nearest_two
from tabulith.operators.profile import exact_quantiles
from tabulith.operators.sample import sample_fraction
from tabulith.sources.tables import scratch_path

__all__ = ["PivotIndex", "nearest_two"]
EPSILON = 2.220446049250313e-16


def drop_all_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose ``columns`` no other row repeats: every copy of a repeated row goes."""
    once = df.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"o.{c}")) for c in columns]
    return df.alias("x").join(once.alias("o"), on, "left_semi")


def dcr_nndr(nearest: DataFrame, share: float = 0.05) -> DataFrame:
    """(dcr, nndr, n): the 5th percentiles of the nearest distance, and of its ratio to the second nearest, exact and without one task for all."""
    rows = nearest.select("d1", (F.col("d1") / F.greatest(F.col("d2"), F.lit(EPSILON))).alias("ratio"))
    q = exact_quantiles(rows, ["d1", "ratio"], [share]).groupBy().pivot("feature", ["d1", "ratio"]).agg(F.first("quantiles")[0])  # one row
    return q.crossJoin(F.broadcast(nearest.agg(F.count("*").alias("n")))).select(F.col("d1").alias("dcr"), F.col("ratio").alias("nndr"), "n")


def category_weights(real: DataFrame, syn: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, category, slot, weight): every category of either table, with a number and what it adds to a standardized one-hot vector.

    Standardized by the real table, two rows of categories a and b of a column differ in the coordinates of a and b only, by one over
    the real deviation of each: so a row needs its slot and weight, and no vector is as wide as there are categories. A deviation of 0 counts as 1.
    The numbers come from the written table, so no task numbers all categories.
    """
    kinds = dict(real.dtypes)
    long = lambda df, side: df.select(*(canonical(F.col(c), kinds[c]).alias(c) for c in columns)).unpivot([], columns, "feature", "category").withColumn("_real", F.lit(side))
    counts = long(real, 1).unionByName(long(syn, 0)).groupBy("feature", "category").agg(F.sum("_real").alias("n")).filter("category IS NOT NULL")
    p = F.col("n") / F.greatest(F.col("_all"), F.lit(1))
    std = F.sqrt(p * (1 - p))
    out = counts.crossJoin(F.broadcast(real.agg(F.count("*").alias("_all")))).select(  # one row
        "feature", "category", F.monotonically_increasing_id().cast("double").alias("slot"), F.when(std > 0, 1 / std).otherwise(1.0).alias("weight"))
    path = scratch_path(real.sparkSession, "categories")
    out.write.parquet(path)
    return real.sparkSession.read.schema(out.schema).parquet(path)


def privacy_vectors(real: DataFrame, syn: DataFrame, numeric: list[str], categorical: list[str], key: str = "row_key") -> tuple[DataFrame, DataFrame]:
    """Both tables as (key, vector) for :func:`nearest_two` with as many ``categories``: numbers standardized by the real table, nulls as 0, then slot and weight of each category.

    Distances are those of standardized one-hot vectors over the categories of both tables; a null category has no 1.
    """
    weights = category_weights(real, syn, categorical) if categorical else None
    stats = real.agg(*(f(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"{n}_{c}") for c in numeric for n, f in (("mean", F.avg), ("std", F.stddev_pop)))) if numeric else None
    if numeric:  # read back, so that sums in another order can't tell equal rows of two scans apart
        path = scratch_path(real.sparkSession, "stats")
        stats.write.parquet(path)
        stats = real.sparkSession.read.schema(stats.schema).parquet(path)
    kinds, encoded = dict(real.dtypes), []
    for df in (real, syn):
        out = df.crossJoin(F.broadcast(stats)) if numeric else df  # one row
        std = lambda c: F.when(F.col(f"std_{c}") > 0, F.col(f"std_{c}")).otherwise(1.0)
        scaled = [((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"mean_{c}")) / std(c)).alias(f"_x{i}") for i, c in enumerate(numeric)]
        out = out.select(key, *scaled, *(canonical(F.col(c), kinds[c]).alias(f"_c{i}") for i, c in enumerate(categorical)))
        names = [f"_x{i}" for i in range(len(numeric))]
        for i, c in enumerate(categorical):
            own = weights.filter(F.col("feature") == c).select(F.col("category").alias(f"_c{i}"), F.col("slot").alias(f"_s{i}"), F.col("weight").alias(f"_w{i}"))
            out = out.join(own, f"_c{i}", "left").withColumns({f"_s{i}": F.coalesce(f"_s{i}", F.lit(-1.0)), f"_w{i}": F.coalesce(f"_w{i}", F.lit(0.0))})
            names += [f"_s{i}", f"_w{i}"]
        encoded.append(out.select(key, F.array(*names).cast("array<double>").alias("vector")))
    return encoded[0], encoded[1]


def privacy_report(real: DataFrame, syn: DataFrame, numeric: list[str], categorical: list[str], *, key: str = "row_key", fraction: float | None = None,
                   unique_only: bool = False, seed: int = 0) -> DataFrame:
    """(direction, dcr, nndr, n, n_copies, fraction) for real to syn, syn to real, real to real and syn to syn.

    All rows by default. With a ``fraction``, which the result records, that share of each side, by a hash of the
    key, is asked for its neighbours among all rows. n_copies counts rows at distance 0. Under three rows is an error.
    """
    names = [*numeric, *categorical]
    if unique_only:
        real, syn = drop_all_duplicates(real, names), drop_all_duplicates(syn, names)
    if min(real.limit(3).count(), syn.limit(3).count()) < 3:
        raise ValueError("a side has under three rows")
    r, s = privacy_vectors(real, syn, numeric, categorical, key)
    of_r, of_s = (PivotIndex.build(x, key=key, categories=len(categorical)) for x in (r, s))
    out = None
    for name, q, index, same in (("real_syn", r, of_s, False), ("syn_real", s, of_r, False), ("real_real", r, of_r, True), ("syn_syn", s, of_s, True)):
        q = q if fraction is None else sample_fraction(q, fraction, seed=seed, key=key)
        near = nearest_two(q, index, key=key, exclude_self=same)
        copies = near.agg(F.coalesce(F.sum((F.col("d1") < 1e-9).cast("bigint")), F.lit(0)).alias("n_copies"))
        row = dcr_nndr(near).crossJoin(F.broadcast(copies)).select(F.lit(name).alias("direction"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out.withColumn("fraction", F.lit(fraction).cast("double"))


def combine_noise(sources: DataFrame, key: str = "step_id") -> DataFrame:
    """(key, q, noise_stddev, l2_bound) for steps with a row for each source of noise: one row a step, of bound 1.

    Sources of one step count as one: its inverse square noise multiplier is the sum of theirs.
    A source without noise leaves the step without.
    """
    z = F.col("noise_stddev") / F.col("l2_bound")
    whole = F.when(F.min(z) > 0, 1 / F.sqrt(F.sum(F.try_divide(F.lit(1.0), z * z)))).otherwise(0.0)
    return sources.groupBy(key, "q").agg(whole.alias("noise_stddev"), F.lit(1.0).alias("l2_bound"))


def rdp_compose(ledger: DataFrame, orders: list[int]) -> DataFrame:
    """(alpha, rdp): Renyi differential privacy of a ledger (q, noise_stddev, l2_bound) at integer orders.

    Equal steps are grouped first, so the work follows the number of kinds of steps. For a
    sampling rate q in (0, 1) the moment is a sum over binomial terms, summed as logarithms.
    A step without noise spends without bound.
    """
    kinds = ledger.groupBy("q", (F.col("noise_stddev") / F.col("l2_bound")).alias("z")).agg(F.count("*").alias("steps"))
    # orders and their terms: a table of a fixed, small size
    terms = [(a, i, float(_log_binomial(a, i))) for a in orders for i in range(a + 1)]
    table = ledger.sparkSession.createDataFrame(terms, "alpha int, i int, log_binomial double")
    t = kinds.crossJoin(F.broadcast(table)).withColumn("term", F.col("log_binomial") + F.when(F.col("i") > 0, F.col("i") * F.log("q")).otherwise(0.0) + F.when(
        F.col("i") < F.col("alpha"), (F.col("alpha") - F.col("i")) * F.log1p(-F.col("q"))).otherwise(0.0) + F.try_divide(F.col("i") * F.col("i") - F.col("i"), 2 * F.col("z") * F.col("z")))
    most = t.groupBy("q", "z", "steps", "alpha").agg(F.max("term").alias("m"), F.collect_list("term").alias("ts"))  # alpha + 1 terms
    log_a = F.col("m") + F.log(F.aggregate("ts", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m"))))
    rdp = F.when(F.col("q") == 0, 0.0).when(F.col("z") == 0, float("inf")).when(F.col("q") == 1, F.try_divide(F.col("alpha"), 2 * F.col("z") * F.col("z"))).otherwise(log_a / (F.col("alpha") - 1))
    return most.groupBy("alpha").agg(F.sum(rdp * F.col("steps")).alias("rdp"))


def _log_binomial(n: int, k: int) -> float:
    from math import lgamma

    return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)


def privacy_spent(rdp: DataFrame, *, delta: float | None = None, epsilon: float | None = None) -> DataFrame:
    """(epsilon, delta, best_alpha) from (alpha, rdp) for a given delta or a given epsilon, exactly one of them."""
    if (delta is None) == (epsilon is None):
        raise ValueError("give exactly one of delta and epsilon")
    if delta is not None:
        eps = F.col("rdp") - F.log(F.lit(delta)) / (F.col("alpha") - 1)
        return rdp.agg(F.min(eps).alias("epsilon"), F.min_by("alpha", eps).alias("best_alpha")).select("epsilon", F.lit(delta).alias("delta"), "best_alpha")
    x = (F.col("rdp") - epsilon) * (F.col("alpha") - 1)
    return rdp.agg(F.exp(F.least(F.lit(0.0), F.min(x))).alias("delta"), F.min_by("alpha", x).alias("best_alpha")).select(F.lit(epsilon).alias("epsilon"), "delta", "best_alpha")
