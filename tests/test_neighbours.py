"""Nearest neighbours by pivots against brute force, and how much the index skips."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.operators import neighbours, privacy
from tabulith.operators.neighbours import PivotIndex, nearest_two


def table(spark, x, name="k"):
    return spark.createDataFrame([(f"{name}{i}", v) for i, v in enumerate(x.tolist())], "row_key string, vector array<double>")


def check(got, x, base, ids, same):
    for i in ids:
        d = np.sqrt(((base - x[i]) ** 2).sum(1))
        assert np.allclose(got[f"k{i}"], np.sort(np.delete(d, i) if same else d)[:2])


@pytest.mark.parametrize("same", [True, False])
def test_clustered_rows_skip_most_pairs(spark, monkeypatch, same):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.RandomState(1)
    x = rng.randn(60, 3)[rng.randint(0, 60, 6000)] * 20 + rng.randn(6000, 3)
    df = table(spark, x)
    asked = df.filter(F.pmod(F.xxhash64("row_key"), F.lit(20)) == 0)
    index = PivotIndex.build(df)
    got = {r.row_key: (r.d1, r.d2) for r in nearest_two(asked, index, exclude_self=same).collect()}
    check(got, x, x, [int(k[1:]) for k in got], same)
    n = asked.count()
    q = asked.select(F.col("row_key").alias("key"), F.col("vector").alias("v"))
    first = index.visits(q, same)
    d2 = nearest_two(asked, index, exclude_self=same).select(F.col("row_key").alias("key"), F.col("d2").alias("bound"))
    more = index.visits(first.select("key", "v", "block").join(d2, "key").select("key", "v", F.col("block").alias("first"), "bound"), seen=True)
    read = sum(r.n for r in first.select("n").union(more.select("n")).collect())
    assert len(got) == n > 200 and read < 0.2 * n * len(x)
    assert max(index.size) <= 64 and index.size.sum() == 6000


def test_a_third_of_the_rows_are_one_point(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.RandomState(2)
    x = np.concatenate([np.full((200, 2), 0.5), rng.rand(400, 2)])
    df = table(spark, x)
    got = {r.row_key: (r.d1, r.d2) for r in nearest_two(df, df.repartition(5), exclude_self=True).collect()}
    check(got, x, x, range(600), True)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_bases(spark, n):
    x = np.arange(8.0).reshape(4, 2)
    got = {r.row_key: (r.d1, r.d2) for r in nearest_two(table(spark, x), table(spark, x[:n], "b")).collect()}
    for i in range(4):
        d = [*np.sort(np.sqrt(((x[:n] - x[i]) ** 2).sum(1)))[:2].tolist(), None, None][:2]
        assert got[f"k{i}"] == pytest.approx(tuple(d), nan_ok=True)
    assert nearest_two(table(spark, x).limit(0), table(spark, x)).count() == 0


def test_fifty_thousand_categories(spark):
    real = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("row_key"), (F.col("id") % 97).cast("double").alias("v"),
                                      F.when(F.col("id") % 1000 == 7, None).when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50_000).cast("string")).alias("c"))
    syn = real.limit(10).withColumn("c", F.lit("only here"))
    a, b = privacy.privacy_vectors(real, syn, ["v"], ["c"])
    assert len(a.first().vector) == 3
    asked = a.filter("row_key in ('k0', 'k7', 'k8', 'k49999', 'k50001', 'k101')")
    got = {r.row_key: (r.d1, r.d2) for r in nearest_two(asked, a, categories=1, exclude_self=True).collect()}
    rows = real.toPandas()
    share = rows["c"].value_counts() / len(rows)
    std = np.sqrt(share * (1 - share))
    w = (1 / rows["c"].map(std)).fillna(0).to_numpy()
    v = rows["v"].to_numpy() / rows["v"].to_numpy().std()
    c = rows["c"].fillna("").to_numpy()
    for key, d in got.items():
        i = int(key[1:])
        far = np.sqrt((v - v[i]) ** 2 + (c != c[i]) * (w**2 + w[i] ** 2))
        assert np.allclose(d, np.sort(np.delete(far, i))[:2]), key
    assert len(got) == 6 and nearest_two(b, a, categories=1).filter("d1 < 1e-9").count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_copies_are_met_once(spark, monkeypatch, same):
    """Six thousand rows of 60 vectors, and single ones, twins and triplets: no block holds more than three rows of a vector, and each row gets its own answer."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    rng = np.random.RandomState(4)
    x = np.concatenate([rng.randn(60, 3)[np.arange(6000) % 60], np.repeat(rng.randn(12, 3) * 5, [1, 2, 3] * 4, axis=0)])
    df = table(spark, x)
    index = PivotIndex.build(df)
    assert index.size.sum() == 60 * 3 + 24
    got = {r.row_key: (r.d1, r.d2) for r in nearest_two(df, index, exclude_self=same).collect()}
    assert len(got) == len(x)
    check(got, x, x, [*range(0, 6000, 97), *range(6000, 6024)], same)
