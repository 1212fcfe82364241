"""Samples of an exact size, weighted draws, numbering without one task, mixtures, and rows drawn until there are enough."""

import hashlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.operators import encode, profile, sample
from tabulith.plans.generate import fit_sampler, generate_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [0, 1, 700, 4999, 5000, 9000])
def test_exactly_n_rows_without_a_sort(spark, n):
    df = spark.range(5000).select(F.concat(F.lit("r"), "id").alias("row_key"))
    out = sample.sample_n(df, n, seed=5)
    want = sorted((f"r{i}" for i in range(5000)), key=lambda k: hashlib.md5(f"5|{k}".encode()).hexdigest())[:n]
    assert sorted(r.row_key for r in out.collect()) == sorted(want)
    assert "TakeOrdered" not in plan(out) and "GlobalLimit" not in plan(out) and out.columns == ["row_key"]


def test_a_sample_of_equal_keys_is_exact(spark):
    df = spark.range(900).select(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("row_key"))
    assert [sample.sample_n(df, n, seed=1).count() for n in (100, 450, 800)] == [100, 450, 800]


def test_running_sums_of_one_hot_group(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, "a").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), "id")
    got = profile.running_sums(df, ["g"], [F.desc("id")], {"place": F.lit(1), "sum": F.col("id")}).toPandas()
    for _, own in got.groupby("g"):
        own = own.sort_values("id", ascending=False)
        assert own["place"].tolist() == list(range(1, len(own) + 1)) and own["sum"].tolist() == own["id"].cumsum().tolist()
    assert profile.running_sums(df.limit(0), [], [F.asc("id")], {"n": F.lit(1)}).count() == 0


def test_labels_are_numbered_in_order(spark):
    df = spark.range(3000).select((F.col("id") % 700).cast("string").alias("c"))
    got = {r.category: r.code for r in encode.label_dictionary(df, "c").collect()}
    assert got == {c: i for i, c in enumerate(sorted(map(str, range(700))))}


def test_balanced_ranges_of_a_heavy_tail(spark):
    df = spark.range(20_000).select(F.pow(F.lit(10.0), F.col("id") % 20_000 / 1000.0).alias("x"))
    long = profile.numbers(df, ["x"])
    bounds = profile.range_bounds(long, 64)
    sizes = [r["count"] for r in long.join(bounds, "feature").groupBy(profile.range_of(F.col("value"), F.col("bounds"))).count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * sum(sizes) / len(sizes)
    last = profile.running_counts(df, ["x"]).filter("upto = total").collect()
    assert len(last) == 1 and last[0].total == 20_000


def test_quantiles_shuffle_brackets_only(spark):
    df = spark.range(40_000).select((F.xxhash64("id") / 1e15).alias("x"))
    out = profile.exact_quantiles(df, ["x"], [0.05, 0.5])
    want = np.quantile(df.toPandas()["x"], [0.05, 0.5])
    assert np.allclose(out.first().quantiles, want)
    assert "percentile" not in plan(out)


def test_weighted_draws_follow_their_options(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4000).cast("string")).alias("c"), (F.col("id") % 2).cast("string").alias("d"))
    tables = sample.condition_tables(df, ["c", "d"])
    drawn = sample.draw_conditions(spark, 6000, tables, ["c", "d"], seed=3)
    assert drawn.count() == 6000 and drawn.select("draw").distinct().count() == 6000
    hot, of_c = drawn.filter("category = 'hot'").count(), drawn.filter("feature = 'c'").count()
    assert abs(hot / of_c - 1 / 3) < 0.04 and abs(of_c - 3000) < 200
    rows = sample.conditional_rows(df.withColumn("row_key", F.monotonically_increasing_id().cast("string")), drawn, ["c", "d"], seed=3)
    assert rows.count() == 6000 and "Explode" not in plan(drawn.select("draw")).split("Join")[0]


def test_mixture_finds_two_modes(spark):
    rng = np.random.RandomState(0)
    x = np.concatenate([rng.normal(0, 1, 3000), rng.normal(50, 2, 1000)])
    modes = encode.mode_fit(spark.createDataFrame([(float(v), 7.0, None) for v in x], "x double, same double, none double"), ["x", "same", "none"], k=2).collect()
    own = sorted((r for r in modes if r.feature == "x"), key=lambda r: r.mode)
    assert [round(r.mean) for r in own] == [0, 50] and own[0].weight == pytest.approx(0.75, abs=0.01) and own[1].std == pytest.approx(2, abs=0.2)
    assert [(r.feature, r.mean, r.weight) for r in modes if r.feature != "x"] == [("same", 7.0, 1.0)]
    assert encode.mode_fit(spark.createDataFrame([], "x double"), ["x"]).count() == 0


def test_rows_are_drawn_until_there_are_enough(spark):
    real = spark.range(600).select((F.col("id") % 97).cast("double").alias("x"), F.when(F.col("id") % 4 == 0, "u").otherwise("v").alias("label"), (F.col("id") % 3).cast("string").alias("c"))
    s = fit_sampler(real, "label", ["x"], ["c"])
    got = generate_rows(s, 500, seed=1).toPandas()
    assert len(got) == 500 and got["x"].between(0, 96).all() and set(got["c"]) == {"0", "1", "2"} and 0.15 < (got["label"] == "u").mean() < 0.35
    few = replace(s, bounds={"x": (40.0, 41.0)})  # about 1 % of the draws
    rare = generate_rows(few, 120, seed=1).toPandas()
    assert len(rare) == 120 and rare["x"].between(40, 41).all() and rare["x"].nunique() == 120
    with pytest.raises(ValueError, match="none of"):
        generate_rows(replace(s, bounds={"x": (1e6, 2e6)}), 2, seed=1)
    assert generate_rows(s, 0, seed=1).count() == 0


def test_ranges_are_searched_in_time_that_hardly_grows_with_their_number(spark):
    import time

    def search(n, rows):
        bounds = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: (2 * i).cast("double")).alias("bounds"))
        return spark.range(rows).select((F.col("id") % (2 * n + 5)).cast("double").alias("v")).crossJoin(F.broadcast(bounds)).withColumn("part", profile.range_of(F.col("v"), F.col("bounds")))

    assert all(r.part == min(int(r.v // 2), n) for n in (1, 2, 63, 64, 1000) for r in search(n, 2 * n + 5).select("v", "part").collect())
    assert spark.range(1).select(profile.range_of(F.lit(1.0), F.array().cast("array<double>")).alias("p")).first().p == 0
    took = []
    for n in (60, 60, 6000):
        began = time.time()
        search(n, 40_000).agg(F.sum("part")).collect()
        took.append(time.time() - began)
    assert took[2] < 5 * took[1] + 1
