"""Defined behaviour in the cases that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from tabulith.functions.columns import canonical
from tabulith.operators import clean, encode, fidelity, neighbours, privacy, profile, sample, utility


def two(spark, real, syn, name="x", kind="double"):
    rows = [("real", 0, v) for v in real] + [("syn", 1, v) for v in syn]
    return spark.createDataFrame(rows, f"side string, run int, {name} {kind}")


def value(df, c="value"):
    return df.first()[c]


def test_identical_tables_have_no_distance(spark):
    both = two(spark, [1.0, 2.0, 2.0, 9.0], [9.0, 2.0, 1.0, 2.0])
    assert value(fidelity.wasserstein(both, ["x"])) == pytest.approx(0)
    assert value(fidelity.tail_divergence(both, ["x"], tau=0.5)) == pytest.approx(0)


def test_disjoint_categories_are_one_apart(spark):
    assert value(fidelity.jsd(two(spark, ["a", "a"], ["b", None], kind="string"), ["x"])) == pytest.approx(1)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_wasserstein_of_a_shift_is_the_shift_over_the_range(spark, parts):
    xs = [float(i) for i in range(11)]
    assert value(fidelity.wasserstein(two(spark, xs, [x + 3 for x in xs]), ["x"], parts)) == pytest.approx(0.3)


def test_an_unmeasured_tail_is_no_perfect_score(spark):
    capped = fidelity.tail_divergence(two(spark, [1.0, 5.0, 5.0, 5.0], [1.0, 2.0]), ["x"], tau=0.5).first()
    assert (capped["value"], capped["status"]) == (None, "degenerate_tail")
    empty = fidelity.tail_divergence(two(spark, [1.0, 2.0], [None, None]), ["x"], tau=0.5).first()
    assert (empty["value"], empty["status"]) == (None, "no_data")
    means = fidelity.tail_divergence_mean(fidelity.tail_divergence(two(spark, [1.0, 5.0, 5.0, 5.0], [1.0]), ["x"], tau=0.5)).first()
    assert (means["n_used"], means["n_left_out"]) == (0, 1)


def test_nulls_in_a_column_are_left_out_of_the_tail(spark):
    full = value(fidelity.tail_divergence(two(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0]), ["x"], tau=0.5))
    holes = value(fidelity.tail_divergence(two(spark, [1.0, 2.0, None, 3.0, 4.0], [None, 1.0, 2.0]), ["x"], tau=0.5))
    assert holes == pytest.approx(full) and holes > 0


def test_one_and_one_point_zero_are_one_category(spark):
    df = spark.sql("SELECT 1 AS i, CAST(1 AS DOUBLE) AS d, CAST(1.5 AS DOUBLE) AS h")
    assert tuple(df.select(canonical(F.col("i"), "int"), canonical(F.col("d"), "double"), canonical(F.col("h"), "double")).first()) == ("1", "1", "1.5")


@pytest.mark.parametrize("xs", [[3.0, 7.5], [0.0, 2.0], [-4.0, 0.0, 6.0]])
def test_log_round_trip(spark, xs):
    df, least = spark.createDataFrame([(x,) for x in xs], "x double"), F.lit(min(xs))
    back = df.select("x", encode.log_invert(encode.log_apply(F.col("x"), least), least).alias("y")).collect()
    assert all(r.y == pytest.approx(r.x) for r in back)


def test_a_spec_is_never_changed(spark):
    spec = clean.TableSpec(numeric=("x",), mixed={"x": (0.0,)})
    df = spark.createDataFrame([(None,), (0.0,)], "x double")
    once = clean.null_to_sentinel(df, spec)[1]
    assert spec.mixed == {"x": (0.0,)} and clean.null_to_sentinel(df, once)[1].mixed == {"x": (0.0, clean.NUMBER_SENTINEL)}


def test_infinities_and_nan_count_as_missing(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (1.0,)], "x double")
    assert value(profile.null_profile(df), "n_missing") == 3


def test_align(spark):
    a, b = spark.sql("SELECT 1 AS x, 2 AS y"), spark.sql("SELECT 1 AS x, 3 AS z")
    with pytest.raises(ValueError, match="differ"):
        clean.align(a, b, "strict")
    with pytest.raises(ValueError, match="missing"):
        clean.align(a, b, "require")
    real, syn, names = clean.align(a, b, "shared")
    assert real.columns == syn.columns == ["x"] and names == ["y", "z"]
    assert clean.align(a, b, "fill0")[1].first().y == 0


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("row_key"), (F.col("id") % 3).alias("label"))
    parts = [{r.row_key for r in sample.stratified_split(x, "label", 0.25, seed=1).filter("part = 'test'").collect()} for x in (df.repartition(1), df.repartition(13))]
    assert parts[0] == parts[1] and len(parts[0]) in range(248, 253)


def test_privacy_sees_exact_copies(spark):
    real = spark.createDataFrame([(str(i), float(i), float(i % 7)) for i in range(40)], "row_key string, a double, b double")
    syn = real.limit(5).withColumn("row_key", F.concat(F.lit("s"), "row_key")).unionByName(
        spark.createDataFrame([("t1", 100.0, 3.0)], "row_key string, a double, b double"))
    report = {r.direction: r for r in privacy.privacy_report(real, syn, ["a", "b"], []).collect()}
    assert report["syn_real"].n_copies == 5 and report["real_syn"].n_copies == 5 and report["real_real"].n_copies == 0
    with pytest.raises(ValueError, match="three rows"):
        privacy.privacy_report(real.limit(2), syn, ["a", "b"], [])


def test_nearest_two_has_no_largest_base(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    at = lambda i: (i * 37 % 101) / 10
    df = spark.createDataFrame([(str(i), [at(i), at(3 * i + 1)]) for i in range(40)], "row_key string, vector array<double>")
    got = {r.row_key: (r.d1, r.d2) for r in privacy.nearest_two(df.filter("row_key % 5 = 0"), df, exclude_self=True).collect()}
    for k in range(0, 40, 5):
        d = sorted(((at(k) - at(i)) ** 2 + (at(3 * k + 1) - at(3 * i + 1)) ** 2) ** 0.5 for i in range(40) if i != k)
        assert got[str(k)] == pytest.approx(tuple(d[:2]))
    assert len(got) == 8


def test_exactly_one_privacy_target(spark):
    with pytest.raises(ValueError, match="exactly one"):
        privacy.privacy_spent(spark.sql("SELECT 2 AS alpha, 1.0D AS rdp"))


def test_mode_fit_finds_two_humps(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.randn(1)).otherwise(20 + F.randn(2)).alias("x"))
    means = [r["mean"] for r in encode.mode_fit(df, ["x"], k=2).collect()]
    assert len(means) == 2 and min(means) == pytest.approx(0, abs=0.5) and max(means) == pytest.approx(20, abs=0.5)


def test_detector_cannot_tell_halves_of_one_table_but_sees_a_shift(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("row_key"), F.rand(3).alias("a"), F.rand(4).alias("b"))
    half, other = df.filter("row_key % 2 = 0"), df.filter("row_key % 2 = 1")
    auc = lambda x: utility.classification_metrics(utility.detector(half, x, ["a", "b"], [], model="tree")).first()["auc"]
    assert 0.35 < auc(other) < 0.65
    assert auc(other.withColumn("a", F.col("a") + 5)) > 0.95


def test_constant_empty_and_one_class_inputs_give_null_not_errors(spark):
    both = spark.createDataFrame([("real", 0, 1.0, 2.0, "a"), ("real", 0, 1.0, 3.0, "a"), ("syn", 1, None, 4.0, None)], "side string, run int, k double, v double, c string")
    w = {r.feature: r.value for r in fidelity.wasserstein(both, ["k", "v"]).collect()}
    assert w["k"] is None and w["v"] is not None
    m = {(r.a, r.b): r.value for r in fidelity.association_matrix(both.filter("side = 'real'"), ["k"], ["c"], ["side"]).collect()}
    assert m == {("c", "k"): None}
    assert fidelity.association_matrix(both, ["k"], [], ["side"]).count() == 0 == fidelity.association_matrix(both, [], ["c"], ["side"]).count()
    assert {(r.a, r.b) for r in fidelity.association_matrix(both, [], ["c", "side"], ["run"]).collect()} == {("c", "side")}
    pred = spark.createDataFrame([(0, 0.2, 1.0, 1.5), (0, 0.7, 1.0, 0.5)], "label int, prob double, y double, y_hat double")
    got = utility.classification_metrics(pred).first()
    assert got.auc is None and got.accuracy == 50
    assert utility.average_precision(pred).first().ap is None
    assert utility.regression_metrics(pred).first().r2 is None
    assert utility.classification_metrics(pred.limit(0)).first().accuracy is None
    scaled = pred.select(encode.range_scale(F.col("y"), F.lit(1.0), F.lit(1.0)).alias("z")).first().z
    assert scaled == 0.0
    ledger = spark.createDataFrame([(0.01, 0.0, 1.0), (0.01, 1.0, 1.0)], "q double, noise_stddev double, l2_bound double")
    assert {r.rdp for r in privacy.rdp_compose(ledger, [2, 4]).collect()} == {float("inf")}


def test_many_categories_and_nearest_two_equal_brute_force(spark):
    import numpy as np

    rows = [(f"k{i}", float(i % 50), str(i % 300)) for i in range(1500)]
    real = spark.createDataFrame(rows, "row_key string, v double, c string")
    a, _ = privacy.privacy_vectors(real, real.limit(5), ["v"], ["c"])
    assert len(a.first().vector) == 3  # a number, a slot and its weight
    rng = np.random.RandomState(3)
    x = rng.rand(300, 4)
    df = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)], "row_key string, vector array<double>")
    got = {r.row_key: (r.d1, r.d2) for r in privacy.nearest_two(df, df, exclude_self=True).collect()}
    for i in range(300):
        d = np.sort(np.delete(np.sqrt(((x - x[i]) ** 2).sum(1)), i))
        assert np.allclose(got[f"k{i}"], d[:2])


def test_quantiles_of_ties_nulls_and_constants(spark):
    import numpy as np

    values = [1.0, 1.0, 2.0, None, 5.0, 100.0, None]
    df = spark.createDataFrame([(v, 3.0, None) for v in values], "a double, b double, c double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.feature: r.quantiles for r in profile.exact_quantiles(df, ["a", "b", "c"], shares).collect()}
    assert np.allclose(got["a"], np.quantile([v for v in values if v is not None], shares))
    assert got["b"] == [3.0] * 5 and got["c"] is None
    assert {r.feature: r.quantiles for r in profile.exact_quantiles(df.limit(0), ["a"], shares).collect()} == {"a": None}


def test_slots_and_labels_of_unknown_categories(spark):
    fit = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "c string")
    slots = encode.category_slots(fit, ["c"])
    long = spark.createDataFrame([(1, "c", "x"), (2, "c", "new"), (3, "c", None)], "k int, feature string, category string")
    back = {r.k: (r.hot, r.decoded) for r in encode.slot_decode(encode.slot_encode(long, slots), slots).collect()}
    assert back == {1: ([1, 0, 0], "x"), 2: ([0, 0, 0], None), 3: ([0, 0, 0], None)}
    codes = encode.label_dictionary(fit, "c")
    rows = spark.createDataFrame([(0,), (9,), (None,)], "c_code int")
    assert sorted(((r.c_code, r.c_label) for r in encode.label_decode(rows, "c", codes).collect()), key=str) == [(0, "__MISSING__"), (9, None), (None, None)]


def test_mixed_values_come_back(spark):
    modal = {"a": (0.0, 7.0)}
    modes = spark.createDataFrame([("a", 0, 0.5, 10.0, 2.0), ("a", 1, 0.5, 50.0, 5.0)], encode.MODES)
    arrays = encode.mode_arrays(modes)
    long = spark.createDataFrame([("p", "a", 0.0), ("q", "a", 7.0), ("r", "a", 11.0), ("s", "a", 52.0), ("t", "a", None)], "row_key string, feature string, value double")
    there = encode.mixed_apply(long, modal, arrays, arrays)
    slots = {r.row_key: (r.slot, round(r.u, 6)) for r in there.collect()}
    assert slots["p"] == (0, -0.99) and slots["q"] == (1, -0.375) and slots["r"][0] == 2 and slots["s"][0] == 3 and "t" not in slots
    back = {r.row_key: round(r.value, 6) for r in encode.mixed_invert(there, modal, arrays).collect()}
    assert back == {"p": 0.0, "q": 7.0, "r": 11.0, "s": 52.0}
    assert encode.mixed_apply(long.limit(0), modal, arrays, arrays).count() == 0


def test_metrics_of_one_class_and_no_rows(spark):
    one = spark.createDataFrame([(1, "a", "a", 0.9), (1, "b", "a", 0.1), (2, "a", "a", 0.5), (2, "b", "a", 0.5)], "row_id int, class string, truth string, prob double")
    assert tuple(utility.multiclass_metrics(one).first()) == (100.0, None, 1.0)
    assert tuple(utility.multiclass_metrics(one.limit(0)).first()) == (None, None, None)


def test_noise_sources_of_a_step(spark):
    steps = spark.createDataFrame([(1, 0.1, 3.0, 1.0), (1, 0.1, 4.0, 1.0), (2, 0.1, 2.0, 2.0), (3, 0.1, 0.0, 1.0), (3, 0.1, 1.0, 1.0)], "step_id int, q double, noise_stddev double, l2_bound double")
    assert {r.step_id: round(r.noise_stddev, 6) for r in privacy.combine_noise(steps).collect()} == {1: 2.4, 2: 1.0, 3: 0.0}
