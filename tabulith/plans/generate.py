"""Rows drawn from fitted marginals.

This keeps the distribution of each column within a class and no dependence beyond the class. It is
a baseline to hold other generators against, not a generative network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.functions.columns import let, uniform
from tabulith.operators.encode import mode_arrays, mode_fit
from tabulith.operators.sample import condition_tables, draw_conditions, sample_n
from tabulith.sources.tables import scratch_path


#: Stands between a class and a column or a category in a name.
BETWEEN = "\x1f"


@dataclass(frozen=True)
class Sampler:
    """What :func:`fit_sampler` learned: tables with a row for each class, class and column, or category."""

    label: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    classes: DataFrame
    modes: DataFrame
    options: DataFrame
    bounds: dict[str, tuple[float, float]]


def fit_sampler(real: DataFrame, label: str, numeric: list[str], categorical: list[str]) -> Sampler:
    """Class frequencies, and for each class the modes of its numbers and the frequencies of its categories."""
    wide = real.select(F.col(label).alias("_class"), *numeric)
    long = wide.unpivot(["_class"], numeric, "name", "v").select(F.concat_ws(BETWEEN, "_class", "name").alias("f"), "v")
    names = [r.f for r in long.select("f").distinct().collect()]  # classes times columns
    per_class = real.select(*(F.when(F.col(label) == n.split(BETWEEN)[0], F.col(n.split(BETWEEN)[1])).alias(n) for n in names))
    modes = mode_arrays(mode_fit(per_class, names))
    cats = real.select(*(F.concat_ws(BETWEEN, F.col(label), F.coalesce(c, F.lit("__MISSING__"))).alias(c) for c in categorical))
    options = condition_tables(cats, categorical).select("feature", F.substring_index("category", BETWEEN, 1).alias("class"),
                                                         F.substring_index("category", BETWEEN, -1).alias("category"), "n")
    row = real.agg(*(f(c).alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max)))).first()
    return Sampler(label, tuple(numeric), tuple(categorical), condition_tables(real, [label]), modes, options,
                   {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in numeric})


def _draw(s: Sampler, n: int, seed: int, start: int = 0) -> DataFrame:
    spark = s.modes.sparkSession
    rows = draw_conditions(spark, n, s.classes, [s.label], seed=seed, start=start).select("draw", F.col("category").alias(s.label))
    for k, c in enumerate(s.numeric):
        base = seed + 10 * (k + 1)
        modes = s.modes.filter(F.substring_index("feature", BETWEEN, -1) == c).select(F.substring_index("feature", BETWEEN, 1).alias(s.label), "modes")
        modes = modes.withColumn("upto", F.transform("modes", lambda m: F.aggregate(F.filter("modes", lambda x: x["mode"] <= m["mode"]), F.lit(0.0), lambda a, x: a + x["weight"])))
        rows = rows.join(F.broadcast(modes), s.label)  # a row for each class
        u0, u1, u2 = (uniform(base + i, "draw") for i in range(3))
        normal = F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * u2)
        below = let(u0, lambda u: F.size(F.filter("upto", lambda w: w <= u)))
        m = F.element_at("modes", F.least(below, F.size("modes") - 1) + 1)
        rows = rows.withColumn(c, let(m, lambda x: x["mean"] + x["std"] * normal)).drop("modes", "upto")
    for k, c in enumerate(s.categorical):
        options = s.options.filter(F.col("feature") == c).groupBy(F.col("class").alias(s.label)).agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("o"))
        options = options.withColumn("upto", F.transform("o", lambda x: F.aggregate(F.filter("o", lambda y: y["category"] <= x["category"]), F.lit(0).cast("long"), lambda a, y: a + y["n"])))
        rows = rows.join(F.broadcast(options), s.label)
        below = let(uniform(seed + 1000 + k, "draw") * F.element_at("upto", -1), lambda u: F.size(F.filter("upto", lambda w: w <= u)))
        rows = rows.withColumn(c, F.element_at("o", F.least(below, F.size("o") - 1) + 1)["category"]).drop("o", "upto")
    return rows


def generate_rows(s: Sampler, n: int, *, seed: int) -> DataFrame:
    """Exactly ``n`` rows within the fitted ranges: draws outside are rejected, and only what lacks is drawn anew.

    Each round draws what the share accepted so far makes likely to be enough, at most 64 times what lacks, and is a table in the shared
    folder; draws are numbered on, so no round repeats another. Of the last round the draws of least hash fill up to n. An error if a
    thousand draws for each row gave none.
    """
    ok = F.lit(True)
    for c, (lo, hi) in s.bounds.items():
        ok = ok & F.col(c).between(lo, hi)
    spark, out, lacking, tried, taken = s.modes.sparkSession, None, n, 0, 0
    while lacking > 0 or out is None:
        share = taken / tried if taken else 1.0 if not tried else 1 / 64
        want = min(int(1.1 * lacking / share), 64 * lacking) + 100
        rows = _draw(s, want, seed, tried)
        path = scratch_path(spark, "drawn")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path).filter(ok)  # not before: each bound would draw its column again
        got = rows.count()
        tried, taken = tried + want, taken + got
        if got > lacking:
            rows = sample_n(rows, lacking, seed=seed, key="draw")
        out, lacking = rows if out is None else out.unionByName(rows), lacking - min(got, lacking)
        if not taken and tried > 1000 * n:
            raise ValueError(f"none of {tried} draws is within the fitted ranges")
    return out.drop("draw")
