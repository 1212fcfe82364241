"""Copies of a row cost as one, and fits over counts are those over rows."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tabulith.operators import sample, utility


@pytest.mark.parametrize("model", ["tree", "logistic", "forest"])
def test_a_model_is_fitted_on_different_rows(spark, monkeypatch, model):
    seen, make = [], utility.CLASSIFIERS[model]

    def watched(*args):
        est = make(*args)
        fit = est._fit
        est._fit = lambda rows: seen.append((rows.count(), rows.agg(F.sum("_w")).first()[0] if "_w" in rows.columns else None)) or fit(rows)
        est.copy = lambda extra=None: est
        return est

    monkeypatch.setitem(utility.CLASSIFIERS, model, watched)
    rows = spark.range(4000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 8).cast("double").alias("x"), F.lit("c").alias("c"), F.when(F.col("id") % 8 < 3, "a").otherwise("b").alias("label"))
    pred = utility.predict_classes(rows, rows, "label", ["x"], ["c"], model, trees=5)
    assert utility.multiclass_metrics(pred, "row_key").first().accuracy == 100
    assert seen == [(8 * utility.FOREST_PARTS if model == "forest" else 8, 4000.0)]


@pytest.mark.parametrize("model", ["ols", "ridge", "lasso"])
def test_lines_through_means_are_those_through_rows(spark, model):
    x = (F.col("id") % 5).cast("double")
    rows = spark.range(500).select(F.col("id").cast("string").alias("row_key"), x.alias("x"), (3 * x + F.pmod(F.xxhash64("id"), F.lit(100)) / 10).alias("v"))
    got = {r.row_key: r.y_hat for r in utility.train_regressor(rows, rows, "v", ["x"], [], model).collect()}
    ready = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows.withColumn("y", F.col("v")))
    want = {r.row_key: r.prediction for r in utility.REGRESSORS[model]().fit(ready).transform(ready).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(got) == 500


def test_a_split_shuffles_no_row_and_has_its_quotas(spark):
    rows = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("row_key"), F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").when(F.col("id") > 2990, F.lit(None)).otherwise("c").alias("label"))
    out = sample.stratified_split(rows, "label", 0.3, seed=3)
    got = {(r.label, r.part): r["count"] for r in out.groupBy("label", "part").count().collect()}
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert all(got.get((c, "test"), 0) == round(0.3 * k) and got[(c, "train")] == k - round(0.3 * k) for c, k in n.items()) and set(n) == {"a", "b", "c", None}
    assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
