"""Whole rows to vectors and back."""

import pytest
from pyspark.sql import functions as F

from tabulith.operators.rows import Block, RowEncoder, decode_rows, encode_rows, fit_rows


def test_a_fitted_encoder_brings_rows_back(spark):
    df = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("row_key"), F.when(F.col("id") % 17 == 0, None).otherwise((F.col("id") % 2) * 100 + (F.xxhash64("id") % 50) / 10).alias("m"),
                                  F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.xxhash64("id", F.lit(1)) % 70) / 7 + 30).alias("z"), (F.col("id") % 11).cast("int").alias("g"),
                                  F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 300).cast("string")).alias("c"), F.lit(4.0).alias("one"))
    enc = fit_rows(df, modes=["m"], mixed={"z": (0.0,)}, general=["g", "one"], categorical=["c"], k=4)
    coded = encode_rows(df, enc, seed=2)
    layout = enc.layout(spark).orderBy("start").collect()
    assert [r.start for r in layout] == [sum(x.width for x in layout[:i]) for i in range(len(layout))] and sum(r.width for r in layout) == enc.size == coded.first()["size"]
    assert {(r.column, r.role, r.kind) for r in layout} >= {("m", "value", "tanh"), ("m", "mode", "softmax"), ("z", "mixed", "softmax"), ("g", "value", "tanh"), ("c", "category", "softmax")}
    bad = coded.filter("size(indices) != size(array_distinct(indices)) OR indices != array_sort(indices) OR array_max(indices) >= size OR array_max(transform(values, v -> abs(v))) > 1")
    assert bad.count() == 0
    back = decode_rows(coded, enc).join(df.select("row_key", *(F.col(c).alias(f"{c}_") for c in ("m", "z", "g", "c", "one"))), "row_key").toPandas()
    assert len(back) == 2000 and (back["c"] == back["c_"].fillna("__MISSING__")).all() and (back["g"] - back["g_"]).abs().max() < 1e-9 and (back["one"] == 4.0).all()
    assert (back["m"].isna() == back["m_"].isna()).all() and ((back["m"] - back["m_"]).abs().dropna() < 1e-6).mean() > 0.99
    assert (back["z"][back["z_"] == 0] == 0).all() and (back["z"] - back["z_"]).abs().quantile(0.99) < 1e-6


def test_new_rows_have_what_was_fitted(spark):
    slots = spark.createDataFrame([("c", "x", 0), ("c", "y", 1)], "feature string, category string, slot int")
    enc = RowEncoder((Block("a", "mode", ((1.0, 10.0, 1.0),)), Block("b", "mixed", (), (5.0, 7.0), ((1.0, 6.0, 1.0),)), Block("c", "category", categories=2)), slots)
    rows = [("1", 10.5, 7.0, "y"), ("2", 1e9, 5.0, "new"), ("3", None, None, None), ("4", 9.0, 6.0, "x")]
    got = {r.row_key: (r.indices, [round(v, 6) for v in r["values"]]) for r in encode_rows(spark.createDataFrame(rows, "row_key string, a double, b double, c string"), enc).collect()}
    assert got == {"1": ([0, 1, 2, 4, 6], [0.125, 1.0, 0.25, 1.0, 1.0]), "2": ([0, 1, 2, 3], [0.99, 1.0, -0.25, 1.0]), "3": ([], []), "4": ([0, 1, 5], [-0.25, 1.0, 1.0])}
    back = {r.row_key: (r.a, r.b, r.c) for r in decode_rows(encode_rows(spark.createDataFrame(rows, "row_key string, a double, b double, c string"), enc), enc).collect()}
    assert back["1"] == (10.5, 7.0, "y") and back["3"] == (None, None, None) and back["4"] == (9.0, None, "x") and back["2"] == (pytest.approx(13.96), 5.0, None)


def test_rows_of_a_frequent_category_are_not_shuffled_and_rare_ones_found(spark, monkeypatch):
    from tabulith.operators import encode

    df = spark.range(3000).selectExpr("cast(id AS string) AS row_key", "CASE WHEN id % 50 > 0 THEN 'often' WHEN id % 100 = 0 THEN NULL ELSE concat('c', id % 1000) END AS c", "cast(id % 2 AS string) AS d")
    slots = encode.category_slots(df, ["c", "d"])
    names = {(r.feature, r.slot): r.category for r in slots.collect()}
    first = sum(f == "c" for f, _ in names)
    want = {r.row_key: (r.c or "__MISSING__", r.d) for r in df.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for frequent in (10_000, 2):
            monkeypatch.setattr(encode, "FREQUENT", frequent, raising=False)
            out = encode.one_hot(df, ["c", "d"], slots)
            assert {r.row_key: (names["c", r.indices[0]], names["d", r.indices[1] - first]) for r in out.collect()} == want
            encoder = RowEncoder((Block("c", "category", categories=first), Block("d", "category", categories=2)), slots)
            back = decode_rows(encode_rows(df, encoder), encoder)
            assert {r.row_key: (r.c, r.d) for r in back.collect()} == want
            plan = back._jdf.queryExecution().optimizedPlan().toString()
            joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
            assert len(joins) >= 4 and (frequent == 2 or all("strategy=broadcast" in line for line in joins))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
