"""Models of several classes, of numbers, and the detector, on tables whose classes are apart."""

import pytest
from pyspark.sql import functions as F

from tabulith.operators import utility


@pytest.fixture(scope="module")
def split(spark):
    rows = spark.range(900).select(F.concat(F.lit("r"), "id").alias("row_key"), F.when(F.col("id") % 9 == 0, "rare").when(F.col("id") % 3 == 1, "a").otherwise("b").alias("label"), F.col("id"))
    noise = (F.xxhash64("id") % 100) / 100.0
    x = F.when(F.col("label") == "rare", 20.0).when(F.col("label") == "a", 0.0).otherwise(10.0) + noise
    rows = rows.withColumns({"x": x, "w": F.when(F.col("id") % 11 == 0, None).otherwise(noise), "c": F.substring("label", 1, 1), "y": 3 * x + 2})
    return rows.withColumn("part", F.when(F.col("id") % 4 == 0, "test").otherwise("train")).drop("id").persist()


def fake(split, flip: bool):
    """One synthetic run like the real table, and one with two labels exchanged."""
    one = split.drop("part").withColumn("row_key", F.concat(F.lit("s"), "row_key"))
    other = one.withColumn("label", F.when(F.col("label") == "a", "b").when(F.col("label") == "b", "a").otherwise(F.col("label"))).withColumn("y", -F.col("y"))
    return one.withColumn("run", F.lit(1)).unionByName(other.withColumn("run", F.lit(2))) if flip else one.withColumn("run", F.lit(1))


@pytest.mark.parametrize("model", ["logistic", "tree", "forest", "mlp"])
def test_classes_apart_are_told_apart(split, model):
    pred = utility.predict_classes(split.filter("part = 'train'"), split.filter("part = 'test'"), "label", ["x", "w"], ["c"], model)
    assert pred.count() == 3 * 225 and pred.groupBy("row_key").agg(F.sum("prob").alias("p")).filter("abs(p - 1) > 1e-6").count() == 0
    m = utility.multiclass_metrics(pred, "row_key").first()
    assert m.accuracy > 99 and m.auc > 0.99 and m.f1 > 0.99


def test_gaps_of_a_good_and_a_wrong_run(split):
    got = {r.run: r for r in utility.class_gap(split, fake(split, True), "label", ["x"], ["c"], ["tree"]).collect()}
    assert got[0].accuracy == 100 and got[1].gap_accuracy == 0 and got[2].gap_accuracy > 60
    gaps = utility.regression_gap(split, fake(split, True), "y", ["x"], [], ["ols"])
    mean = utility.mean_gap(gaps).first()
    by = {r.run: r for r in gaps.collect()}
    assert by[0].r2 == pytest.approx(1) and by[1].gap_r2 == pytest.approx(0, abs=1e-6) and mean.n_runs == 2 and mean.gap_r2 == pytest.approx((by[1].gap_r2 + by[2].gap_r2) / 2)


@pytest.mark.parametrize("model", ["ols", "ridge", "lasso"])
def test_a_line_is_found(split, model):
    m = utility.regression_metrics(utility.train_regressor(split.filter("part = 'train'"), split.filter("part = 'test'"), "y", ["x"], [], model)).first()
    assert m.r2 > 0.95


def test_the_rare_class_is_found_if_its_rows_are_like_real_ones(split):
    got = {r.arm: r for r in utility.rare_event_recall(split, fake(split, False).withColumn("label", F.when(F.col("label") == "rare", "b").otherwise(F.col("label"))), "label", ["x"], [], trees=10).collect()}
    assert got["real"].recall == 1 and got["syn"].recall == 0 and got["real"].n_rare == got["syn"].n_rare == 25 and got["real"].rare_label == "rare"


def test_one_shifted_column_gives_a_table_away(split):
    real, syn = split.drop("part"), fake(split, False).drop("run").withColumn("w", F.col("w") + 5)
    report = utility.detector_report(real, syn, ["x", "w"], ["c"], trees=10).first()
    assert report.auc > 0.95 and report.ap > 0.95 and (report.n_real, report.n_syn, report.n_features) == (900, 900, 3) and report.n_encoded >= 5
    loss = {r.feature: r.weight for r in utility.detector_importance(real, syn, ["x", "w"], ["c"]).collect()}
    assert max(loss, key=loss.get) == "w" and loss["w"] > 0.3 and abs(loss["x"]) < 0.1
