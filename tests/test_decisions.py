"""Decisions in which the library departs on purpose from what it was surveyed from."""

import pytest
from pyspark.sql import functions as F

from tabulith.operators import encode, fidelity, profile, utility


def test_the_label_is_no_column_of_the_mean_tail(spark):
    rows = [("real", 0, float(i), i) for i in range(20)] + [("syn", 1, float(i), 19) for i in range(20)]
    scores = fidelity.tail_divergence(spark.createDataFrame(rows, "side string, run int, x double, y int").withColumn("y", F.col("y").cast("double")), ["x", "y"], tau=0.5)
    both, left = fidelity.tail_divergence_mean(scores).first(), fidelity.tail_divergence_mean(scores, label="y").first()
    assert left.value == pytest.approx(0) and left.n_used == 1
    assert both.n_used == 2 and both.value > 0.1


def test_slots_are_those_stored_at_the_fit(spark):
    mode = lambda ms: spark.createDataFrame([("x", m) for m in ms], "feature string, mode int")
    order = encode.mode_reorder(mode([2, 2, 2, 0, 0, 1])).persist()
    assert {r.mode: r.slot for r in order.collect()} == {2: 0, 0: 1, 1: 2}
    new = mode([1, 1, 1, 1, 0])  # another order of use, which changes nothing
    for _ in range(2):
        permuted = encode.mode_permute(new, order)
        assert sorted(r.slot for r in permuted.collect()) == [1, 2, 2, 2, 2]
    assert sorted(r.mode for r in encode.mode_restore(permuted, order).collect()) == [0, 1, 1, 1, 1]
    assert encode.mode_permute(mode([7]), order).first().slot is None


def test_equal_runs_are_named_and_counted(spark):
    rows = [(1, "a", 0.5), (1, "b", None), (2, "a", 0.5), (2, "b", 1.0), (4, "b", None), (4, "a", 0.5), (5, "a", 0.5)]
    long = spark.createDataFrame(rows, "run int, metric string, value double")
    assert {r.run: r.same_as for r in profile.equal_runs(long).collect()} == {1: 1, 2: 2, 4: 1, 5: 5}
    mean = {r.metric: r for r in profile.average_over_runs(long).collect()}
    assert (mean["a"].n_runs, mean["a"].n_distinct) == (4, 1)
    assert profile.equal_runs(long.limit(0)).count() == 0


def test_both_arms_of_rare_recall_see_the_same_held_out_rows(spark):
    rows = [(f"r{i}", "rare" if i % 5 == 0 else "usual", float(i % 5 == 0), "test" if i % 3 == 0 else "train") for i in range(150)]
    split = spark.createDataFrame(rows, "row_key string, label string, x double, part string")
    syn = split.drop("part").withColumn("row_key", F.concat(F.lit("s"), "row_key"))
    want = sum(label == "rare" and part == "test" for _, label, _, part in rows)
    got = {r.arm: r for r in utility.rare_event_recall(split, syn, "label", ["x"], [], trees=5).collect()}
    assert set(got) == {"real", "syn"} and {r.n_rare for r in got.values()} == {want} and {r.recall for r in got.values()} == {1.0}


def test_the_share_of_rare_combinations_is_given_and_their_count_can_be_bounded(spark):
    real = [("real", 0, c, "u") for c, n in (("a", 90), ("b", 4), ("c", 2), ("d", 1)) for _ in range(n)]
    syn = [("syn", 1, c, "u") for c in ("a", "c")]
    both = spark.createDataFrame([*real, *syn], "side string, run int, c string, e string")
    cover = lambda **o: fidelity.support_coverage(both, [], ["c", "e"], **o)
    row = cover().first()
    assert (row.n_real, row.n_rare, row.n_covered) == (4, 3, 1) and fidelity.support_summary(cover()).first().rare_share == pytest.approx(0.75)
    row = cover(min_rare_count=2, max_rare_count=3).first()
    assert (row.n_rare, row.n_covered, row.value) == (1, 1, 1.0)
