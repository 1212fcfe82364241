"""The queries of the table operators over the given tables, and the SQL that each must agree with.

Numbers are rounded to six places on both sides. SQL is written from the definitions; queries
without SQL are randomized or train models.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.columns import or_missing, round_half_even, to_numeric, uniform
from tabulith.operators import clean, encode, fidelity, privacy, profile, sample, utility
from tabulith.sources import tables as t
from tabulith.sources.tables import CATEGORIES, NUMERIC, ledger, pair, predictions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NUM, CAT = list(NUMERIC), list(CATEGORIES)
#: Modes and bounds that queries apply where the fit itself is not what is compared.
FIXED_MODES = (("disc", ((0, 0.3, 0.01, 0.01), (1, 0.7, 0.06, 0.025))), ("qty", ((0, 0.5, 15.0, 8.0), (1, 0.5, 40.0, 9.0))))
SPARSE_PCT = 4.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def on_pair(select: str, **ctes: str) -> str:
    """SQL over the pair fixture, with further common tables."""
    parts = "".join(f", {name} AS MATERIALIZED ({sql})" for name, sql in ctes.items())
    return f"WITH pair AS ({t.PAIR_SQL}){parts} {select}"


def real_syn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = pair(spark, d)
    return p.filter("side = 'real'"), p.filter("side = 'syn'")


def u_sql(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}|' || {key}), 1, 13) AS BIGINT) / 4503599627370496.0)"


LONG_NUM = " UNION ALL ".join(f"SELECT row_key, side, run, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM pair WHERE {c} IS NOT NULL" for c in NUM)
LONG_CAT = " UNION ALL ".join(f"SELECT row_key, side, run, '{c}' AS feature, coalesce({c}, '__MISSING__') AS category FROM pair" for c in CAT)
PER_RUN = "SELECT run, 'mean_qty' AS metric, avg(qty) AS value FROM pair GROUP BY run UNION ALL SELECT run, 'mean_price', avg(price) FROM pair GROUP BY run"


def per_run(spark: SparkSession, d: str) -> DataFrame:
    g = pair(spark, d).groupBy("run").agg(F.avg("qty").alias("mean_qty"), F.avg("price").alias("mean_price"))
    return g.unpivot(["run"], ["mean_qty", "mean_price"], "metric", "value")


# ---- A: scans and sinks --------------------------------------------------------------------


@query("a1_scan_csv", "SELECT * FROM nation")
def a1(spark, d):
    base = spark.read.parquet(f"{d}/nation.parquet")
    path = t.scratch_path(spark, "csv")
    t.sink_csv(base, path)
    return t.scan_csv(spark, path, base.schema)


@query("a2_scan_replicas", on_pair("SELECT run, count(*) AS n_rows, round(sum(qty), 6) AS sum_qty FROM pair WHERE side = 'syn' GROUP BY run"))
def a2(spark, d):
    syn, root = real_syn(spark, d)[1].select("row_key", "qty", "run"), t.scratch_path(spark, "replicas")
    for r in (1, 2, 3):
        t.sink_csv(syn.filter(F.col("run") == r).drop("run"), f"{root}/fake_{r}")
    rows = t.scan_replicas(spark, f"{root}/fake_*", "row_key string, qty double", r"fake_(\d+)", [1, 2, 3])
    return rounded(rows.groupBy("run").agg(F.count("*").alias("n_rows"), F.sum("qty").alias("sum_qty")))


@query("a3_sink_csv", "SELECT count(*) AS n_rows, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer")
def a3(spark, d):
    base, path = spark.read.parquet(f"{d}/customer.parquet"), t.scratch_path(spark, "sink")
    t.sink_csv(base, path)
    return t.scan_csv(spark, path, base.schema).agg(F.count("*").alias("n_rows"), F.sum("c_custkey").cast("bigint").alias("keys"))


@query("a4_sink_metrics", on_pair(f"SELECT run, metric, 'all' AS feature, round(value, 6) AS value FROM ({PER_RUN})"))
def a4(spark, d):
    path = t.scratch_path(spark, "metrics")
    t.sink_metrics(per_run(spark, d).withColumn("feature", F.lit("all")), path)
    return rounded(spark.read.parquet(path))


@query("a5_metrics_wide", on_pair("SELECT run, round(avg(price), 6) AS mean_price, round(avg(qty), 6) AS mean_qty FROM pair GROUP BY run"))
def a5(spark, d):
    return rounded(profile.metrics_wide(per_run(spark, d), ["mean_price", "mean_qty"]))


@query("a6_average_over_runs", on_pair(f"SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(DISTINCT run) AS n_runs, "
                                       f"count(DISTINCT value) AS n_distinct FROM ({PER_RUN}) WHERE run > 0 GROUP BY metric"))
def a6(spark, d):
    return rounded(profile.average_over_runs(per_run(spark, d).filter("run > 0")))


@query("a6_equal_runs", on_pair(f"SELECT run, min(run) OVER (PARTITION BY metrics) AS same_as FROM (SELECT run, list(struct_pack(m := metric, v := value) ORDER BY metric) AS metrics "
                                f"FROM ({PER_RUN}) WHERE run > 0 GROUP BY run)"))
def a6_equal(spark, d):
    return profile.equal_runs(per_run(spark, d).filter("run > 0"))


# ---- B: schema work ------------------------------------------------------------------------


def _aligned(mode: str, sql: str) -> None:
    @query(f"b2_align_{mode}", on_pair(sql))
    def b2(spark, d):
        real, syn = real_syn(spark, d)
        syn = syn.drop("tax") if mode in ("shared", "fill0", "fill_null") else syn
        a, b, _ = clean.align(real, syn.select(*sorted(syn.columns)), mode)
        both = a.unionByName(b)
        has_tax = "tax" in both.columns
        return rounded(both.groupBy("side").agg(F.count("*").alias("n"), F.lit(len(both.columns)).cast("bigint").alias("n_columns"),
                                                (F.sum("tax") if has_tax else F.lit(None).cast("double")).alias("tax")))


_aligned("strict", "SELECT side, count(*) AS n, CAST(12 AS BIGINT) AS n_columns, round(sum(tax), 6) AS tax FROM pair GROUP BY side")
_aligned("require", "SELECT side, count(*) AS n, CAST(12 AS BIGINT) AS n_columns, round(sum(tax), 6) AS tax FROM pair GROUP BY side")
_aligned("shared", "SELECT side, count(*) AS n, CAST(11 AS BIGINT) AS n_columns, CAST(NULL AS DOUBLE) AS tax FROM pair GROUP BY side")
_aligned("fill0", "SELECT side, count(*) AS n, CAST(12 AS BIGINT) AS n_columns, round(sum(CASE WHEN side = 'real' THEN tax ELSE 0 END), 6) AS tax FROM pair GROUP BY side")
_aligned("fill_null", "SELECT side, count(*) AS n, CAST(12 AS BIGINT) AS n_columns, round(sum(CASE WHEN side = 'real' THEN tax END), 6) AS tax FROM pair GROUP BY side")


@query("b3_target_last", on_pair("SELECT row_key, side, run, qty, price, disc, tax, margin, capped, status, label, flag FROM pair"))
def b3(spark, d):
    return clean.target_last(pair(spark, d), "flag")


@query("b4_code_to_string", on_pair("SELECT row_key, CAST(run AS VARCHAR) AS run, CAST(CAST(qty AS BIGINT) AS VARCHAR) AS qty FROM pair"))
def b4(spark, d):
    return clean.code_to_string(pair(spark, d).select("row_key", "run", "qty"), ["run", "qty"])


@query("b5_to_numeric", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id AS DOUBLE) END AS number FROM events")
def b5(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    text = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", to_numeric(text).alias("number"))


@query("b6_drop_columns", on_pair("SELECT row_key, side, run, qty FROM pair"))
def b6(spark, d):
    return pair(spark, d).drop("price", "disc", "tax", "margin", "capped", "flag", "status", "label")


@query("b7_peek", "SELECT *, 'head' AS at FROM (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5) UNION ALL SELECT *, 'tail' FROM (SELECT c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 5)")
def b7(spark, d):
    return profile.peek(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey")


@query("b8_point_mass_predicate", on_pair("SELECT side, count(*) FILTER (disc IN (0.0, 0.05)) AS n_in, count(*) FILTER (disc NOT IN (0.0, 0.05)) AS n_out FROM pair GROUP BY side"))
def b8(spark, d):
    inside = F.col("disc").isin(0.0, 0.05)
    return pair(spark, d).groupBy("side").agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))


# ---- C: missing data -----------------------------------------------------------------------

PROFILED = [*NUM, *CAT]
NULL_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 2) AS pct FROM pair" for c in PROFILED)
NULLS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in PROFILED)


@query("c1_null_profile", on_pair(NULL_PROFILE))
def c1(spark, d):
    return profile.null_profile(pair(spark, d), PROFILED)


@query("c2_total_missing_pct", on_pair(f"SELECT CAST(sum({NULLS}) AS BIGINT) AS n_missing, round(100.0 * sum({NULLS}) / (count(*) * {len(PROFILED)}), 6) AS pct FROM pair"))
def c2(spark, d):
    return profile.total_missing_pct(pair(spark, d), PROFILED)


@query("c3_rows_with_null", on_pair(f"SELECT count(*) AS n_rows, count(*) FILTER ({NULLS} > 0) AS n_with_null, round(100.0 * count(*) FILTER ({NULLS} > 0) / count(*), 6) AS pct FROM pair"))
def c3(spark, d):
    return profile.rows_with_null(pair(spark, d), PROFILED)


@query("c3_sample_rows", on_pair(f"SELECT row_key, price, flag, CAST({NULLS} AS INT) AS n_missing FROM pair WHERE {NULLS} > 0 ORDER BY row_key LIMIT 20"))
def c3b(spark, d):
    return profile.sample_with_null(pair(spark, d), "row_key", 20, PROFILED).select("row_key", "price", "flag", "n_missing")


@query("c4_filter_by_null_count", on_pair(f"SELECT row_key, qty FROM pair WHERE {NULLS} <= 0"))
def c4(spark, d):
    return clean.filter_by_null_count(pair(spark, d), PROFILED, min_present=len(PROFILED)).select("row_key", "qty")


@query("c5_drop_sparse_columns", on_pair(f"SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM pair WHERE {NULLS} - CAST(price IS NULL AS INT) <= 0"))
def c5(spark, d):
    out = clean.clean(pair(spark, d), PROFILED, pct=SPARSE_PCT, max_null=0, rows_first=False)  # price misses 1 in 23
    return out.agg(F.count("*").alias("n_rows"), F.lit(len(out.columns)).cast("bigint").alias("n_columns"))


@query("c5_rows_first", on_pair(f"SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_columns FROM pair WHERE {NULLS} <= 0"))
def c5b(spark, d):
    out = clean.clean(pair(spark, d), PROFILED, pct=SPARSE_PCT, max_null=0, rows_first=True)
    return out.agg(F.count("*").alias("n_rows"), F.lit(len(out.columns)).cast("bigint").alias("n_columns"))


@query("c6_blank_to_null", on_pair("SELECT row_key, CASE WHEN status = 'O' THEN NULL ELSE status END AS status FROM pair"))
def c6(spark, d):
    df = pair(spark, d).select("row_key", F.when(F.col("status") == "O", " ").otherwise(F.col("status")).alias("status"))
    return clean.blank_to_null(df, ["status"])


SPEC = clean.TableSpec(categorical=("flag",), numeric=("price",))


@query("c7_null_to_sentinel", on_pair("SELECT row_key, round(coalesce(price, -9999999), 6) AS price, coalesce(flag, 'empty') AS flag FROM pair"))
def c7(spark, d):
    return rounded(clean.null_to_sentinel(pair(spark, d).select("row_key", "price", "flag"), SPEC)[0])


@query("c8_sentinel_to_null", on_pair("SELECT row_key, round(price, 6) AS price, flag FROM pair"))
def c8(spark, d):
    df, spec = clean.null_to_sentinel(pair(spark, d).select("row_key", "price", "flag"), SPEC)
    return rounded(clean.sentinel_to_null(df, spec))


@query("c9_missing_category", on_pair("SELECT row_key, coalesce(flag, '__MISSING__') AS flag FROM pair"))
def c9(spark, d):
    return clean.missing_category(pair(spark, d).select("row_key", "flag"), ["flag"])


@query("c10_impute", on_pair("SELECT row_key, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM pair WHERE side = 'real')), 6) AS price, coalesce(flag, "
                             "(SELECT flag FROM pair WHERE side = 'real' AND flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM pair"))
def c10(spark, d):
    p = pair(spark, d)
    return rounded(clean.impute(p.select("row_key", "price", "flag"), clean.impute_values(p.filter("side = 'real'"), ["price"], ["flag"])))


# ---- D: encodings --------------------------------------------------------------------------

SLOTS = "SELECT feature, category, count(*) AS n, CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, category) - 1 AS INT) AS slot FROM cat GROUP BY feature, category"


@query("d0_column_metadata", on_pair("SELECT feature, min(v) AS lo, max(v) AS hi, '' AS categories FROM num GROUP BY feature UNION ALL "
                                     "SELECT feature, NULL, NULL, string_agg(category, ',' ORDER BY slot) FROM slots GROUP BY feature", num=LONG_NUM, cat=LONG_CAT, slots=SLOTS))
def d0(spark, d):
    return encode.column_metadata(pair(spark, d), NUM, CAT).withColumn("categories", F.array_join("categories", ","))


LOGGED = ("price", "disc", "margin")


@query("d1_log_apply", on_pair("SELECT row_key, " + ", ".join(f"round(CASE WHEN lo_{c} > 0 THEN ln({c}) WHEN lo_{c} = 0 THEN ln({c} + 1) ELSE ln({c} - lo_{c} + 1) END, 6) AS {c}" for c in LOGGED)
                               + " FROM pair, lo", lo="SELECT " + ", ".join(f"min({c}) AS lo_{c}" for c in LOGGED) + " FROM pair"))
def d1(spark, d):
    p = pair(spark, d)
    lows = p.agg(*(F.min(c).alias(f"lo_{c}") for c in LOGGED))  # one row
    return rounded(p.crossJoin(F.broadcast(lows)).select("row_key", *(encode.log_apply(F.col(c), F.col(f"lo_{c}")).alias(c) for c in LOGGED)))


@query("d2_log_invert", on_pair("SELECT row_key, " + ", ".join(f"round({c}, 3) AS {c}" for c in LOGGED) + " FROM pair"))
def d2(spark, d):
    p = pair(spark, d)
    lows = p.agg(*(F.min(c).alias(f"lo_{c}") for c in LOGGED))
    logs = p.crossJoin(F.broadcast(lows)).withColumns({c: encode.log_apply(F.col(c), F.col(f"lo_{c}")) for c in LOGGED})
    return logs.select("row_key", *(F.round(encode.log_invert(F.col(c), F.col(f"lo_{c}")), 3).alias(c) for c in LOGGED))


@query("d3_label_encode", on_pair("SELECT row_key, flag, CAST(dense_rank() OVER (ORDER BY coalesce(flag, '__MISSING__')) - 1 AS INT) AS flag_code FROM pair"))
def d3(spark, d):
    p = pair(spark, d).select("row_key", "flag")
    return clean.target_last(encode.label_encode(p, "flag", F.broadcast(encode.label_dictionary(p, "flag"))), "flag_code")


@query("d3_label_decode", on_pair("SELECT row_key, CAST(dense_rank() OVER (ORDER BY coalesce(flag, '__MISSING__')) - 1 AS INT) AS flag_code, coalesce(flag, '__MISSING__') AS flag_label FROM pair"))
def d3b(spark, d):
    p = pair(spark, d).select("row_key", "flag")
    known = encode.label_dictionary(p, "flag")
    return encode.label_decode(encode.label_encode(p, "flag", known).drop("flag"), "flag", known).select("row_key", "flag_code", "flag_label")


@query("d4_integer_round", on_pair("SELECT row_key, round_even(qty / 2, 0) AS half FROM pair"))
def d4(spark, d):
    return pair(spark, d).select("row_key", round_half_even(F.col("qty") / 2).alias("half"))


def _one_hot(name: str, where: str) -> None:
    """Sparse one-hot vectors of flag and status, with slots fitted on some of the rows."""
    slot = "(SELECT feature, category, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, category) - 1 AS slot FROM cat WHERE feature <> 'label' AND " + where + " GROUP BY feature, category)"

    @query(name, on_pair("SELECT row_key, CAST((SELECT count(*) FROM s) AS INT) AS size, concat_ws(',', a.slot, (SELECT count(*) FROM s WHERE feature = 'flag') + b.slot) AS ones FROM pair "
                         "LEFT JOIN s a ON a.feature = 'flag' AND a.category = coalesce(flag, '__MISSING__') LEFT JOIN s b ON b.feature = 'status' AND b.category = coalesce(status, '__MISSING__')", cat=LONG_CAT, s="SELECT * FROM " + slot))
    def d5(spark, d):
        p = pair(spark, d)
        slots = encode.category_slots(p.filter(where), ["flag", "status"])
        return encode.one_hot(p, ["flag", "status"], slots).select("row_key", "size", F.array_join("indices", ",").alias("ones"))


_one_hot("d5_one_hot_fit_on_real", "side = 'real'")
_one_hot("d5_one_hot_fit_on_union", "true")


def _scaled(name, f, each):
    sql = ", ".join(f"round({each(c)}, 6) AS {c}" for c in ("qty", "tax"))
    stats = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}, avg({c}) AS mean_{c}, stddev_pop({c}) AS std_{c}" for c in ("qty", "tax"))

    @query(name, on_pair(f"SELECT row_key, {sql} FROM pair, s", s=f"SELECT {stats} FROM pair WHERE side = 'real'"))
    def scaled(spark, d):
        p = pair(spark, d)
        return rounded(f(p.select("row_key", "qty", "tax"), encode.scale_stats(p.filter("side = 'real'"), ["qty", "tax"]), ["qty", "tax"]))


_scaled("d6_minmax", encode.minmax, lambda c: f"({c} - lo_{c}) / (hi_{c} - lo_{c})")
_scaled("d7_standardize", encode.standardize, lambda c: f"({c} - mean_{c}) / std_{c}")


@query("d8_range_scale", on_pair("SELECT row_key, round(2 * (qty - 1) / 49 - 1, 6) AS scaled, round(least(greatest(qty, 1), 50), 6) AS back FROM pair"))
def d8(spark, d):
    lo, hi = F.lit(1.0), F.lit(50.0)
    s = encode.range_scale(F.col("qty"), lo, hi)
    return rounded(pair(spark, d).select("row_key", s.alias("scaled"), encode.range_invert(s, lo, hi).alias("back")))


def _em_sql(num: str, where: str = "true", k: int = 10, rounds: int = 20) -> str:
    """EM as a chain of common tables: the cells, the quantiles to start from, and the modes after each round."""
    ctes = dict(
        num=num, v=f"SELECT feature, v FROM num WHERE side = 'real' AND {where}",
        span="SELECT feature, min(v) AS lo, max(v) AS hi, greatest(stddev_pop(v), 1e-6) AS spread FROM v GROUP BY feature",
        hist="SELECT feature, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 1999) ELSE 0 END AS cell, avg(v) AS x, count(*) AS n FROM v JOIN span USING (feature) GROUP BY ALL",
        q=f"SELECT feature, list_sort(list_distinct(quantile_cont(v, {[(i + 0.5) / k for i in range(k)]}))) AS q FROM v GROUP BY feature",
        r0="SELECT feature, unnest(range(len(q))) AS mode, 1.0 / len(q) AS w, unnest(q) AS mu, spread / len(q) + 1e-6 AS sd FROM q JOIN span USING (feature)")
    logs = lambda r: f"SELECT h.feature, cell, x, n, mode, mu, x - mu AS off, ln(w) - ln(sd) - 0.5 * ((x - mu) / sd) ** 2 AS l FROM hist h JOIN r{r} USING (feature)"
    for r in range(1, rounds + 1):
        ctes[f"l{r}"] = logs(r - 1)
        ctes[f"e{r}"] = f"SELECT *, exp(l - max(l) OVER (PARTITION BY feature, cell)) AS e FROM l{r}"
        ctes[f"s{r}"] = (f"SELECT feature, mode, sum(p * n) + 1e-12 AS mass, mu, sum(p * n * off) / mass AS moved, sum(p * n * off * off) AS sxx, sum(n) AS total FROM "
                         f"(SELECT *, e / sum(e) OVER (PARTITION BY feature, cell) AS p FROM e{r}) GROUP BY feature, mode, mu")
        ctes[f"r{r}"] = f"SELECT feature, mode, mass / total AS w, mu + moved AS mu, greatest(sqrt(greatest(sxx / mass - moved ** 2, 0)), 1e-3 * spread) AS sd FROM s{r} JOIN span USING (feature)"
    ctes["used"] = f"SELECT DISTINCT feature, arg_max(mode, (l, -mode)) AS mode FROM ({logs(rounds)}) GROUP BY feature, cell"
    ctes["good"] = f"SELECT *, w > 0.005 AND (feature, mode) IN (SELECT (feature, mode) FROM used) AS good FROM r{rounds}"
    ctes["kept"] = ("SELECT * FROM (SELECT *, bool_or(good) OVER (PARTITION BY feature) AS kept_any, row_number() OVER (PARTITION BY feature ORDER BY w DESC, mode) AS place FROM good) "
                    "WHERE good OR (NOT kept_any AND place = 1)")
    return on_pair("SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY mu, mode) - 1 AS INT) AS mode, round(w / sum(w) OVER (PARTITION BY feature), 6) AS weight, "
                   "round(mu, 6) AS mean, round(sd, 6) AS std FROM kept", **ctes)


@query("d9_mode_fit", _em_sql(LONG_NUM))
def d9(spark, d):
    return rounded(encode.mode_fit(pair(spark, d).filter("side = 'real'"), NUM))


def fixed_modes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, m, w, mu, sd) for f, ms in FIXED_MODES for m, w, mu, sd in ms], encode.MODES)


def encoded_pair(spark, d):
    long = pair(spark, d).unpivot(["row_key"], ["disc", "qty"], "feature", "value").select("row_key", "feature", F.col("value").cast("double").alias("value"))
    return encode.mode_apply(long, encode.mode_arrays(fixed_modes(spark)), seed=5)


_MODES_SQL = " UNION ALL ".join(f"SELECT '{f}' AS feature, {m} AS mode, {w} AS w, CAST({mu} AS DOUBLE) AS mu, CAST({sd} AS DOUBLE) AS sd" for f, ms in FIXED_MODES for m, w, mu, sd in ms)
_ENC = dict(num=" UNION ALL ".join(f"SELECT row_key, '{c}' AS feature, {c} AS v FROM pair" for c in ("disc", "qty")), modes=_MODES_SQL,
            dens="SELECT row_key, feature, v, mode, mu, sd, w / sd * exp(-0.5 * ((v - mu) / sd) ** 2) AS p FROM num JOIN modes USING (feature)",
            tot="SELECT *, CASE WHEN sum(p) OVER (PARTITION BY row_key, feature) > 0 THEN p / sum(p) OVER (PARTITION BY row_key, feature) ELSE 0 END + 1e-6 AS r FROM dens",
            cum="SELECT *, sum(r) OVER (PARTITION BY row_key, feature ORDER BY mode) AS c, sum(r) OVER (PARTITION BY row_key, feature) AS t FROM tot",
            pick=f"SELECT row_key, feature, CAST(least(sum(CASE WHEN c <= {u_sql(5, chr(34) + 'row_key' + chr(34) + chr(32) + '|| ' + chr(39) + '|' + chr(39) + ' || feature')} * t THEN 1 ELSE 0 END), count(*) - 1) AS INT) AS mode FROM cum GROUP BY row_key, feature",
            enc="SELECT row_key, feature, mode, greatest(-0.99, least(0.99, (v - mu) / (4 * sd))) AS u FROM pick JOIN dens USING (row_key, feature, mode)")


@query("d10_mode_apply", on_pair("SELECT row_key, feature, mode, round(u, 6) AS u FROM enc", **_ENC))
def d10(spark, d):
    return rounded(encoded_pair(spark, d))


@query("d11_mode_invert", on_pair("SELECT row_key, feature, mode, round(u, 6) AS u, round(u * 4 * sd + mu, 6) AS value FROM enc JOIN modes USING (feature, mode)", **_ENC))
def d11(spark, d):
    return rounded(encode.mode_invert(encoded_pair(spark, d), encode.mode_arrays(fixed_modes(spark))).select("row_key", "feature", "mode", "u", "value"))


@query("d10_mode_one_hot", on_pair("SELECT row_key, feature, CASE mode WHEN 0 THEN '10' ELSE '01' END AS hot FROM enc", **_ENC))
def d10b(spark, d):
    hot = encode.mode_one_hot(encoded_pair(spark, d), encode.mode_arrays(fixed_modes(spark)))
    return hot.select("row_key", "feature", F.array_join("hot", "").alias("hot"))


@query("d12_mixed_fit", _em_sql(LONG_NUM, "((feature = 'disc' AND v <> 0) OR (feature = 'capped' AND v <> 40))"))
def d12(spark, d):
    return rounded(encode.mixed_fit(pair(spark, d).filter("side = 'real'"), {"disc": (0.0,), "capped": (40.0,)}))


@query("d12_mixed_split", on_pair("SELECT feature, point, count(*) AS n FROM (SELECT feature, CASE WHEN feature = 'disc' AND v = 0 THEN 0 WHEN feature = 'capped' AND v = 40 THEN 0 END AS point FROM num "
                                  "WHERE feature IN ('disc', 'capped')) GROUP BY feature, point", num=LONG_NUM))
def d12b(spark, d):
    long = pair(spark, d).unpivot(["row_key"], ["disc", "capped"], "feature", "value")
    return encode.mixed_split(long, {"disc": (0.0,), "capped": (40.0,)}).groupBy("feature", "point").agg(F.count("*").alias("n"))


#: Point masses of the mixed columns; their other values use FIXED_MODES, which also stand in for the mixture over all values.
MODAL = {"disc": (0.0, 0.05), "qty": (10.0,)}
_POINT = "CASE WHEN feature = 'disc' AND v = 0 THEN 0 WHEN feature = 'disc' AND v = 0.05 THEN 1 WHEN feature = 'qty' AND v = 10 THEN 0 END"
_FIRST = "CASE feature WHEN 'disc' THEN 2 ELSE 1 END"
_MIXED = dict(_ENC, near="SELECT row_key, feature, v, arg_min(mu, abs(v - mu)) AS mu, arg_min(sd, abs(v - mu)) AS sd FROM num JOIN modes USING (feature) GROUP BY row_key, feature, v",
              mixed=f"SELECT row_key, feature, CASE WHEN {_POINT} IS NULL THEN mode + {_FIRST} ELSE {_POINT} END AS slot, CASE WHEN {_POINT} IS NULL THEN u "
                    f"ELSE greatest(-0.99, least(0.99, (v - mu) / (4 * sd))) END AS u, {_POINT} AS point, v FROM enc JOIN near USING (row_key, feature)")


def mixed_pair(spark, d):
    long = pair(spark, d).unpivot(["row_key"], ["disc", "qty"], "feature", "value").select("row_key", "feature", F.col("value").cast("double").alias("value"))
    arrays = encode.mode_arrays(fixed_modes(spark))
    return encode.mixed_apply(long, MODAL, arrays, arrays, seed=5)


@query("d12_mixed_apply", on_pair("SELECT row_key, feature, CAST(slot AS INT) AS slot, round(u, 6) AS u FROM mixed", **_MIXED))
def d12c(spark, d):
    return rounded(mixed_pair(spark, d))


@query("d12_mixed_invert", on_pair(f"SELECT row_key, feature, CAST(slot AS INT) AS slot, round(CASE WHEN point IS NULL THEN u * 4 * sd + mu ELSE v END, 6) AS value "
                                   f"FROM mixed LEFT JOIN (SELECT feature, mode + {_FIRST} AS slot, mu, sd FROM modes) USING (feature, slot)", **_MIXED))
def d12d(spark, d):
    back = encode.mixed_invert(mixed_pair(spark, d), MODAL, encode.mode_arrays(fixed_modes(spark)))
    return rounded(back.select("row_key", "feature", "slot", "value"))


@query("d13_one_hot_and_back", on_pair("SELECT row_key, feature, category AS decoded, repeat('0', slot) || '1' || repeat('0', CAST(n_slots - slot - 1 AS INT)) AS hot FROM cat JOIN "
                                       "(SELECT *, count(*) OVER (PARTITION BY feature) AS n_slots FROM slots) USING (feature, category)", cat=LONG_CAT, slots=SLOTS))
def d13b(spark, d):
    p = pair(spark, d)
    slots = encode.category_slots(p, CAT)
    long = p.select("row_key", *(or_missing(F.col(c)).alias(c) for c in CAT)).unpivot(["row_key"], CAT, "feature", "category")
    back = encode.slot_decode(encode.slot_encode(long, slots).drop("category"), slots)
    return back.select("row_key", "feature", "decoded", F.array_join("hot", "").alias("hot"))


@query("d13_category_slots", on_pair(SLOTS, cat=LONG_CAT))
def d13(spark, d):
    return encode.category_slots(pair(spark, d), CAT)


@query("d14_mode_reorder", on_pair("SELECT feature, mode, count(*) AS n, CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, mode) - 1 AS INT) AS slot FROM pick GROUP BY feature, mode", **_ENC))
def d14(spark, d):
    return encode.mode_reorder(encoded_pair(spark, d))


@query("d14_permute_and_back", on_pair("SELECT row_key, feature, mode, slot FROM pick JOIN (SELECT feature, mode, CAST(row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, mode) - 1 AS INT) AS slot "
                                       "FROM pick GROUP BY feature, mode) USING (feature, mode)", **_ENC))
def d14b(spark, d):
    encoded = encoded_pair(spark, d)
    order = encode.mode_reorder(encoded)
    permuted = encode.mode_permute(encoded, order).withColumn("kept", F.col("slot"))
    return encode.mode_restore(permuted, order).select("row_key", "feature", "mode", F.col("kept").alias("slot"))


def row_encoder(spark, d):
    """Fixed modes for quantity and discount; the range of tax and the categories come from the table."""
    from tabulith.operators.rows import Block, RowEncoder

    p, of = pair(spark, d), {f: tuple((w, mu, sd) for _, w, mu, sd in ms) for f, ms in FIXED_MODES}
    slots = encode.category_slots(p, ["flag", "status"])
    sizes = {r.feature: r["count"] for r in slots.groupBy("feature").count().collect()}
    r = p.agg(F.min("tax").alias("lo"), F.max("tax").alias("hi")).first()
    return p, RowEncoder((Block("qty", "mode", of["qty"]), Block("disc", "mixed", of["disc"], MODAL["disc"], of["disc"]), Block("tax", "general", lo=r.lo, hi=r.hi),
                          Block("flag", "category", categories=sizes["flag"]), Block("status", "category", categories=sizes["status"])), slots)


_ROWS = dict(_MIXED, cat=LONG_CAT, slots=SLOTS, tr="SELECT min(tax) AS lo, max(tax) AS hi FROM pair")


@query("d16_encode_rows", on_pair("SELECT row_key, CAST(i AS INT) AS i, round(v, 6) AS v FROM (SELECT row_key, 0 AS i, u AS v FROM enc WHERE feature = 'qty' UNION ALL SELECT row_key, 1 + mode, 1 FROM enc WHERE feature = 'qty' "
                                  "UNION ALL SELECT row_key, 3, u FROM mixed WHERE feature = 'disc' UNION ALL SELECT row_key, 4 + slot, 1 FROM mixed WHERE feature = 'disc' "
                                  "UNION ALL SELECT row_key, 8, 2 * (tax - lo) / (hi - lo) - 1 FROM pair, tr UNION ALL SELECT row_key, 9 + slot + CASE feature WHEN 'flag' THEN 0 ELSE "
                                  "(SELECT count(*) FROM slots WHERE feature = 'flag') END, 1 FROM cat JOIN slots USING (feature, category) WHERE feature <> 'label')", **_ROWS))
def d16(spark, d):
    from tabulith.operators.rows import encode_rows

    p, encoder = row_encoder(spark, d)
    return rounded(encode_rows(p, encoder, seed=5).select("row_key", F.inline(F.arrays_zip(F.col("indices").alias("i"), F.col("values").alias("v")))))


@query("d16_decode_rows", on_pair("SELECT row_key, round(q.u * 4 * q.sd + q.mu, 6) AS qty, round(m.value, 6) AS disc, round(tax, 6) AS tax, coalesce(flag, '__MISSING__') AS flag, status FROM pair "
                                  "JOIN (SELECT row_key, u, sd, mu FROM enc JOIN modes USING (feature, mode) WHERE feature = 'qty') q USING (row_key) JOIN back m USING (row_key)",
                                  **_ROWS, back=f"SELECT row_key, CASE WHEN point IS NULL THEN u * 4 * sd + mu ELSE v END AS value FROM mixed LEFT JOIN (SELECT feature, mode + {_FIRST} AS slot, mu AS mu, sd AS sd FROM modes) "
                                                f"USING (feature, slot) WHERE feature = 'disc'"))
def d16b(spark, d):
    from tabulith.operators.rows import decode_rows, encode_rows

    p, encoder = row_encoder(spark, d)
    return rounded(decode_rows(encode_rows(p, encoder, seed=5), encoder))


@query("d15_reject_out_of_range", on_pair("SELECT count(*) AS n_rows, count(*) FILTER (NOT (qty BETWEEN 1 AND 50 AND coalesce(price BETWEEN 0 AND 90000, true))) AS n_rejected FROM pair"))
def d15(spark, d):
    return encode.reject_out_of_range(pair(spark, d), {"qty": (1.0, 50.0), "price": (0.0, 90000.0)})[1]


EDGES = " UNION ALL ".join(f"SELECT '{c}' AS feature, list_distinct(quantile_cont({c}, [i / 10.0 for i in range(11)])) AS e FROM pair WHERE side = 'real'" for c in NUM)


@query("d17_quantile_edges", on_pair("SELECT feature, round(x, 6) AS edge FROM (SELECT feature, unnest(e) AS x FROM edges)", edges=EDGES))
def d17(spark, d):
    return rounded(encode.quantile_edges(pair(spark, d).filter("side = 'real'"), NUM, 10).select("feature", F.explode("edges").alias("edge")))


BIN = ("CASE WHEN v IS NULL THEN '__MISSING__' WHEN len(e) <= 1 THEN '0' ELSE CAST(len(list_filter(list_sort(e)[2:len(e) - 1], lambda x: x < v)) AS VARCHAR) END")
BINNED = " UNION ALL ".join(f"SELECT row_key, side, run, feature, {BIN} AS bin FROM (SELECT row_key, side, run, '{c}' AS feature, {c} AS v FROM pair) JOIN edges USING (feature)" for c in NUM)


@query("d18_bin_by_edges", on_pair("SELECT side, feature, bin, count(*) AS n FROM binned GROUP BY ALL", edges=EDGES, binned=BINNED))
def d18(spark, d):
    p = pair(spark, d)
    long = p.unpivot(["side"], NUM, "feature", "v").join(F.broadcast(encode.quantile_edges(p.filter("side = 'real'"), NUM, 10)), "feature")
    return long.groupBy("side", "feature", encode.bin_by_edges(F.col("v"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))


# ---- E: splits and sampling ----------------------------------------------------------------


@query("e1_stratified_split", on_pair("SELECT row_key, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('3|' || row_key), row_key) <= round(0.3 * count(*) OVER (PARTITION BY label)) "
                                      "THEN 'test' ELSE 'train' END AS part FROM pair WHERE side = 'real'"))
def e1(spark, d):
    return sample.stratified_split(real_syn(spark, d)[0], "label", 0.3, seed=3).select("row_key", "part")


@query("e2_random_split", on_pair(f"SELECT row_key, CASE WHEN {u_sql(4, 'row_key')} < 0.2 THEN 'test' ELSE 'train' END AS part FROM pair"))
def e2(spark, d):
    return sample.random_split(pair(spark, d), 0.2, seed=4).select("row_key", "part")


@query("e3_sample_n", on_pair("SELECT row_key FROM pair ORDER BY md5('5|' || row_key), row_key LIMIT 2000"))
def e3(spark, d):
    return sample.sample_n(pair(spark, d).select("row_key"), 2000, seed=5)


@query("e3_sample_fraction", on_pair(f"SELECT row_key FROM pair WHERE {u_sql(6, 'row_key')} < 0.15"))
def e3b(spark, d):
    return sample.sample_fraction(pair(spark, d).select("row_key"), 0.15, seed=6)


COND = ("SELECT feature, category, n, n / sum(n) OVER w AS p, ln(n + 1) / sum(ln(n + 1)) OVER w AS p_log, sum(n) OVER (w ORDER BY category) / sum(n) OVER w AS upto, "
        "sum(ln(n + 1)) OVER (w ORDER BY category) / sum(ln(n + 1)) OVER w AS upto_log FROM (SELECT feature, category, count(*) AS n FROM cat WHERE side = 'real' GROUP BY ALL) WINDOW w AS (PARTITION BY feature)")


@query("e4_condition_tables", on_pair("SELECT feature, category, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("p", "p_log", "upto", "upto_log")) + " FROM cond", cat=LONG_CAT, cond=COND))
def e4(spark, d):
    return rounded(sample.condition_tables(real_syn(spark, d)[0], CAT))


DRAWS = dict(cat=LONG_CAT, cond=COND, draws=f"SELECT i AS draw, ['flag', 'status', 'label'][CAST(floor({u_sql(8, 'i')} * 3) AS INT) + 1] AS feature, {u_sql(9, 'i')} AS u FROM range((SELECT count(*) FROM pair WHERE side = 'real')) r(i)",
             drawn="SELECT draw, feature, min(category) AS category FROM draws JOIN cond USING (feature) WHERE upto > u OR upto >= 1 GROUP BY draw, feature")


def drawn(spark, d):
    real = real_syn(spark, d)[0]
    return real, sample.draw_conditions(spark, real.count(), sample.condition_tables(real, CAT), CAT, seed=8)


@query("e5_draw_conditions", on_pair("SELECT draw, feature, category FROM drawn", **DRAWS))
def e5(spark, d):
    return drawn(spark, d)[1]


_SLICED = dict(DRAWS, sl=f"SELECT row_key, feature, category, CAST(floor({u_sql(15, 'row_key')} * 64) AS INT) AS slice FROM cat WHERE side = 'real'",
               numbered="SELECT *, row_number() OVER (PARTITION BY feature, category ORDER BY slice, row_key) AS k FROM sl",
               sizes="SELECT feature, category, count(*) AS total FROM sl GROUP BY feature, category",
               picked=f"SELECT draw, feature, category, CAST(floor({u_sql(11, 'draw')} * total) + 1 AS BIGINT) AS k FROM drawn JOIN sizes USING (feature, category)")


@query("e6_conditional_rows", on_pair("SELECT draw, feature, category, row_key FROM picked JOIN numbered USING (feature, category, k)", **_SLICED))
def e6(spark, d):
    real, conditions = drawn(spark, d)
    return sample.conditional_rows(real, conditions, CAT, seed=8)


@query("e7_generate_rows")
def e7(spark, d):
    from tabulith.plans.generate import fit_sampler, generate_rows

    real = real_syn(spark, d)[0]
    return rounded(generate_rows(fit_sampler(real, "label", ["qty", "tax", "margin"], ["flag", "status"]), real.count(), seed=2))


# ---- F: aggregation, distributions ---------------------------------------------------------


@query("f1_value_distribution", on_pair("SELECT side, feature, category, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY side, feature), 6) AS probability FROM cat GROUP BY side, feature, category", cat=LONG_CAT))
def f1(spark, d):
    return rounded(profile.value_distribution(pair(spark, d), CAT, ["side"]))


@query("f2_top_values", on_pair("SELECT CAST(flag AS VARCHAR) AS value, count(*) AS n FROM pair GROUP BY flag ORDER BY n DESC, value NULLS LAST LIMIT 20"))
def f2(spark, d):
    return profile.top_values(pair(spark, d), "flag")


def _hist_sql(group: str) -> str:
    by = f"{group}, " if group else ""
    over = f"PARTITION BY {by}feature"
    return on_pair(f"SELECT {by}feature, bin, round(lo, 6) AS lo, round(w, 6) AS width, count(*) AS n, round(count(*) / (sum(count(*)) OVER ({over}) * w), 6) AS density FROM b GROUP BY {by}feature, bin, lo, w",
                   num=LONG_NUM, s="SELECT feature, min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM num GROUP BY feature",
                   b="SELECT num.*, lo, w, CAST(least(floor((v - lo) / w), 29) AS INT) AS bin FROM num JOIN s USING (feature)")


@query("f3_histogram", _hist_sql(""))
def f3(spark, d):
    return rounded(profile.histogram(pair(spark, d), NUM))


@query("f4_density_histogram", _hist_sql("side"))
def f4(spark, d):
    return rounded(profile.histogram(pair(spark, d), NUM, by=["side"]))


@query("f5_rare_class", on_pair("SELECT label AS rare_label, n AS n_rows, (SELECT count(*) FROM c) AS n_classes FROM c ORDER BY n, label LIMIT 1", c="SELECT label, count(*) AS n FROM pair GROUP BY label"))
def f5(spark, d):
    return profile.rare_class(pair(spark, d), "label")


@query("f6_ecdf", "SELECT 'value' AS feature, round(value, 6) AS value, round(f, 6) AS f FROM (SELECT DISTINCT value, cume_dist() OVER (ORDER BY value) AS f FROM events)")
def f6(spark, d):
    return rounded(profile.ecdf(spark.read.parquet(f"{d}/events.parquet"), ["value"]).select("feature", "value", "f"))


@query("f7_two_smallest")
def f7(spark, d):
    real, syn = h_pair(spark, d)
    return rounded(privacy.nearest_two(real, syn, categories=1))


@query("f8_weighted_rollup", on_pair("SELECT feature, round(sum(p), 6) AS weight FROM (SELECT feature, count(*) / sum(count(*)) OVER () AS p FROM cat WHERE feature <> 'label' GROUP BY feature, category) GROUP BY feature", cat=LONG_CAT)
       .replace("FROM cat WHERE feature <> 'label'", "FROM cat").replace(" GROUP BY feature, category) GROUP BY feature", " GROUP BY feature, category) WHERE feature <> 'label' GROUP BY feature"))
def f8(spark, d):
    slots = encode.category_slots(pair(spark, d), CAT).withColumn("role", F.concat_ws("_", "feature", "category"))
    total = slots.agg(F.sum("n").alias("t"))
    weights = slots.crossJoin(F.broadcast(total)).select("role", (F.col("n") / F.col("t")).alias("weight"))
    return rounded(profile.weighted_rollup(weights, slots.select("role", "feature"), "label"))


# ---- G: fidelity ---------------------------------------------------------------------------

DIST = dict(cat=LONG_CAT, pr="SELECT feature, category, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS p FROM cat WHERE side = 'real' GROUP BY feature, category",
            ps="SELECT run, feature, category, count(*) / sum(count(*)) OVER (PARTITION BY run, feature) AS p FROM cat WHERE side = 'syn' GROUP BY run, feature, category",
            runs="SELECT DISTINCT run FROM pair WHERE side = 'syn'",
            dist="SELECT run, feature, category, coalesce(max(pr.p), 0) AS p_real, coalesce(max(ps.p), 0) AS p_syn FROM (SELECT run, feature, category FROM runs, pr UNION SELECT run, feature, category FROM ps) "
                 "LEFT JOIN pr USING (feature, category) LEFT JOIN ps USING (run, feature, category) GROUP BY run, feature, category",
            jsd="SELECT run, feature, sqrt(greatest(0, sum(CASE WHEN p_real > 0 THEN p_real * log2(p_real / ((p_real + p_syn) / 2)) ELSE 0 END + CASE WHEN p_syn > 0 THEN p_syn * log2(p_syn / ((p_real + p_syn) / 2)) ELSE 0 END) / 2)) AS value FROM dist GROUP BY run, feature")
W1 = dict(num=LONG_NUM, wr="SELECT DISTINCT run FROM pair WHERE side = 'syn'",
          pts="SELECT run, feature, v, sum(r) AS r, sum(s) AS s FROM (SELECT wr.run, feature, v, 1 AS r, 0 AS s FROM num, wr WHERE side = 'real' UNION ALL SELECT run, feature, v, 0, 1 FROM num WHERE side = 'syn') GROUP BY ALL",
          cum="SELECT run, feature, v, r, sum(r) OVER w / sum(r) OVER (PARTITION BY run, feature) - sum(s) OVER w / sum(s) OVER (PARTITION BY run, feature) AS d, lead(v) OVER (PARTITION BY run, feature ORDER BY v) AS nx FROM pts WINDOW w AS (PARTITION BY run, feature ORDER BY v)",
          w1="SELECT run, feature, sum(abs(d) * coalesce(nx - v, 0)) / (max(v) FILTER (r > 0) - min(v) FILTER (r > 0)) AS value FROM cum GROUP BY run, feature")


@query("g1_jsd", on_pair("SELECT run, feature, round(value, 6) AS value FROM jsd", **DIST))
def g1(spark, d):
    return rounded(fidelity.jsd(pair(spark, d), CAT))


@query("g2_categorical_distributions", on_pair("SELECT run, feature, category, round(p_real, 6) AS p_real, round(p_syn, 6) AS p_syn FROM dist", **DIST))
def g2(spark, d):
    return rounded(fidelity.categorical_distributions(pair(spark, d), CAT))


@query("g3_wasserstein", on_pair("SELECT run, feature, round(value, 6) AS value FROM w1", **W1))
def g3(spark, d):
    return rounded(fidelity.wasserstein(pair(spark, d), NUM))


@query("f9_metric_summary", on_pair("SELECT run, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS largest, arg_max(feature, value) AS worst, count(*) AS n_features FROM w1 GROUP BY run", **W1))
def f9(spark, d):
    return rounded(profile.metric_summary(fidelity.wasserstein(pair(spark, d), NUM), ["run"]))


def _assoc_ctes() -> dict[str, str]:
    from itertools import combinations

    num = " UNION ALL ".join(f"SELECT side, run, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS value FROM pair GROUP BY side, run" for a, b in combinations(sorted(NUM), 2))
    tab = " UNION ALL ".join(f"SELECT side, run, '{a}' AS a, '{b}' AS b, coalesce({a}, '__MISSING__') AS x, coalesce({b}, '__MISSING__') AS y, count(*) AS n FROM pair GROUP BY ALL" for a, b in combinations(sorted(CAT), 2))
    eta = " UNION ALL ".join(f"SELECT side, run, '{min(v, c)}' AS a, '{max(v, c)}' AS b, sqrt(greatest(0, sum(n * (m - gm) ** 2) / max(ss))) AS value FROM (SELECT side, run, count({v}) AS n, avg({v}) AS m, any_value(gm) AS gm, any_value(ss) AS ss "
                             f"FROM pair JOIN (SELECT side, run, avg({v}) AS gm, var_pop({v}) * count({v}) AS ss FROM pair GROUP BY side, run) USING (side, run) GROUP BY side, run, coalesce({c}, '__MISSING__')) GROUP BY side, run" for c in CAT for v in NUM)
    return dict(
        tab=tab, tw="SELECT *, sum(n) OVER (PARTITION BY side, run, a, b, x) AS nx, sum(n) OVER (PARTITION BY side, run, a, b, y) AS ny, sum(n) OVER (PARTITION BY side, run, a, b) AS nn FROM tab",
        phi="SELECT side, run, a, b, sum(n * n / (nx * ny)) - 1 AS phi2, max(nn) AS nn, count(DISTINCT x) AS r, count(DISTINCT y) AS c FROM tw GROUP BY side, run, a, b",
        v="SELECT side, run, a, b, CASE WHEN least(r - (r - 1) ** 2 / (nn - 1), c - (c - 1) ** 2 / (nn - 1)) > 1 THEN sqrt(greatest(0, phi2 - (r - 1) * (c - 1) / (nn - 1)) / (least(r - (r - 1) ** 2 / (nn - 1), c - (c - 1) ** 2 / (nn - 1)) - 1)) ELSE 0 END AS value FROM phi",
        assoc=f"SELECT * FROM ({num}) UNION ALL SELECT * FROM v UNION ALL SELECT * FROM ({eta})",
        dist2="SELECT s.run, sqrt(2 * sum((coalesce(s.value, 0) - coalesce(r.value, 0)) ** 2)) AS value FROM assoc s JOIN assoc r USING (a, b) WHERE s.side = 'syn' AND r.side = 'real' GROUP BY s.run")


@query("g4_association_matrix", on_pair("SELECT side, run, a, b, round(value, 6) AS value FROM assoc", **_assoc_ctes()))
def g4(spark, d):
    return rounded(fidelity.association_matrix(pair(spark, d), NUM, CAT, ["side", "run"]))


@query("g5_association_distance", on_pair("SELECT run, round(value, 6) AS value FROM dist2", **_assoc_ctes()))
def g5(spark, d):
    return rounded(fidelity.association_distance(pair(spark, d), NUM, CAT))


@query("g6_fidelity_summary", on_pair(
    "SELECT j.run, " + ", ".join(f"round({p}.{c}, 6) AS {n}_{c}" for p, n in (("j", "jsd"), ("w", "w1")) for c in ("mean", "median", "largest")) + ", j.worst AS jsd_worst, w.worst AS w1_worst, round(a.value, 6) AS association FROM j JOIN w USING (run) JOIN dist2 a USING (run)",
    **DIST, **W1, **_assoc_ctes(), **{n: f"SELECT run, avg(value) AS mean, quantile_cont(value, 0.5) AS median, max(value) AS largest, arg_max(feature, value) AS worst FROM {s} GROUP BY run" for n, s in (("j", "jsd"), ("w", "w1"))}))
def g6(spark, d):
    return rounded(fidelity.fidelity_summary(pair(spark, d), NUM, CAT))


TAIL = dict(num=LONG_NUM, q="SELECT feature, quantile_cont(v, 0.9) AS q, max(v) AS top FROM num WHERE side = 'real' GROUP BY feature",
            cells="SELECT side, run, feature, CAST(CASE WHEN top > q THEN greatest(0, ceil(round((v - q) / ((top - q) / 199), 9))) ELSE 0 END AS INT) AS cell, count(*) AS n FROM num JOIN q USING (feature) GROUP BY ALL",
            grid="SELECT g AS cell FROM range(200) r(g)",
            f="SELECT side, run, feature, grid.cell, coalesce(sum(n) FILTER (cells.cell <= grid.cell), 0) / sum(n) AS f FROM cells, grid GROUP BY side, run, feature, grid.cell",
            gap="SELECT s.run, feature, max(abs(s.f - r.f)) AS d FROM f s JOIN f r USING (feature, cell) WHERE s.side = 'syn' AND r.side = 'real' GROUP BY s.run, feature",
            tail="SELECT run, feature, CASE WHEN q < top THEN d END AS value, CASE WHEN q < top THEN 'ok' ELSE 'degenerate_tail' END AS status FROM gap JOIN q USING (feature)")


@query("g7_tail_divergence", on_pair("SELECT run, feature, round(value, 6) AS value, status FROM tail", **TAIL))
def g7(spark, d):
    return rounded(fidelity.tail_divergence(pair(spark, d), NUM))


@query("g8_tail_divergence_mean", on_pair("SELECT run, round(avg(value), 6) AS value, count(value) AS n_used, count(*) - count(value) AS n_left_out FROM tail GROUP BY run", **TAIL))
def g8(spark, d):
    return rounded(fidelity.tail_divergence_mean(fidelity.tail_divergence(pair(spark, d), NUM)))


_COLS = ["qty", "disc", "flag", "label"]

def _cover_sql() -> dict[str, str]:
    from itertools import combinations

    bins = lambda c: (f"CASE WHEN {c} IS NULL THEN '__MISSING__' WHEN len(e_{c}) <= 1 THEN '0' ELSE CAST(len(list_filter(list_sort(e_{c})[2:len(e_{c}) - 1], lambda x: x < {c})) AS VARCHAR) END AS {c}")
    one = ", ".join(f"(SELECT e FROM edges WHERE feature = '{c}') AS e_{c}" for c in ("qty", "disc"))
    sets = " UNION ALL ".join(f"SELECT side, run, '{'+'.join(s)}' AS subset, {s[0]} || '|' || {s[1]} AS combo, count(*) AS n FROM wide GROUP BY ALL" for s in combinations(_COLS, 2))
    return dict(edges=EDGES, one=f"SELECT {one}", wide=f"SELECT side, run, {bins('qty')}, {bins('disc')}, coalesce(flag, '__MISSING__') AS flag, label FROM pair, one", sets=sets,
                rr="SELECT subset, combo, n / sum(n) OVER (PARTITION BY subset) <= 0.05 AS rare FROM sets WHERE side = 'real'", sruns="SELECT DISTINCT run FROM pair WHERE side = 'syn'",
                cover="SELECT sruns.run, rr.subset, count(*) AS n_real, count(*) FILTER (rare) AS n_rare, count(*) FILTER (rare AND s.n IS NOT NULL) AS n_covered FROM rr CROSS JOIN sruns LEFT JOIN sets s "
                      "ON s.side = 'syn' AND s.run = sruns.run AND s.subset = rr.subset AND s.combo = rr.combo GROUP BY sruns.run, rr.subset")


@query("g10_support_coverage", on_pair("SELECT run, subset, n_real, n_rare, n_covered, round(CASE WHEN n_rare > 0 THEN n_covered / n_rare END, 6) AS value FROM cover", **_cover_sql()))
def g10(spark, d):
    return rounded(fidelity.support_coverage(pair(spark, d), ["qty", "disc"], ["flag", "label"]))


@query("g11_support_summary", on_pair("SELECT run, round(avg(n_covered / n_rare) FILTER (n_rare > 0), 6) AS mean, round(stddev_pop(n_covered / n_rare) FILTER (n_rare > 0), 6) AS std, count(*) FILTER (n_rare > 0) AS n_valid, "
                                      "round(sum(n_rare) / sum(n_real), 6) AS rare_share FROM cover GROUP BY run", **_cover_sql()))
def g11(spark, d):
    return rounded(fidelity.support_summary(fidelity.support_coverage(pair(spark, d), ["qty", "disc"], ["flag", "label"])))


# ---- H: privacy ----------------------------------------------------------------------------


@query("h1_drop_all_duplicates", on_pair("SELECT row_key FROM (SELECT row_key, count(*) OVER (PARTITION BY qty, disc, tax, status) AS c FROM pair) WHERE c = 1"))
def h1(spark, d):
    return privacy.drop_all_duplicates(pair(spark, d), ["qty", "disc", "tax", "status"]).select("row_key")


#: The fraction that h5 gives to the report: one row in 20 of each side asks for its neighbours among all rows.
H_SHARE = 0.05


def h_pair(spark, d):
    return privacy.privacy_vectors(*real_syn(spark, d), ["qty", "disc", "tax"], ["status"])


_HV = dict(hs=f"SELECT row_key, side, qty, disc, tax, CAST(status = 'F' AS INT) AS sf, CAST(status = 'O' AS INT) AS so FROM pair",
           st="SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("qty", "disc", "tax", "sf", "so")) + " FROM hs WHERE side = 'real'",
           hz="SELECT row_key, side, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in ("qty", "disc", "tax", "sf", "so")) + " FROM hs, st",
           hd="SELECT a.side AS sa, b.side AS sb, a.row_key, sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in ("qty", "disc", "tax", "sf", "so")) + ") AS d FROM (SELECT * FROM hz WHERE " + f"{u_sql(1, 'row_key')} < {H_SHARE}" + ") a JOIN hz b ON a.row_key <> b.row_key",
           h2="SELECT sa, sb, row_key, min(d, 2)[1] AS d1, min(d, 2)[2] AS d2 FROM hd GROUP BY sa, sb, row_key")
#: The same where every row asks: the pairs are too many to be kept, so they go straight into their minima.
_HA = {c: _HV[c] for c in ("hs", "st", "hz")} | dict(
    h2="SELECT sa, sb, row_key, min(d, 2)[1] AS d1, min(d, 2)[2] AS d2 FROM (SELECT a.side AS sa, b.side AS sb, a.row_key, sqrt("
       + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in ("qty", "disc", "tax", "sf", "so")) + ") AS d FROM hz a JOIN hz b ON a.row_key <> b.row_key) GROUP BY sa, sb, row_key")
ORACLES["f7_two_smallest"] = on_pair("SELECT row_key, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM h2 WHERE sa = 'real' AND sb = 'syn'", **_HA)


@query("h2_nearest_two", on_pair("SELECT row_key, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM h2 WHERE sa = 'syn' AND sb = 'real'", **_HA))
def h2(spark, d):
    real, syn = h_pair(spark, d)
    return rounded(privacy.nearest_two(syn, real, categories=1))


@query("h3_h4_dcr_nndr", on_pair("SELECT round(quantile_cont(d1, 0.05), 6) AS dcr, round(quantile_cont(d1 / greatest(d2, 2.220446049250313e-16), 0.05), 6) AS nndr, count(*) AS n FROM h2 WHERE sa = 'real' AND sb = 'syn'", **_HA))
def h34(spark, d):
    real, syn = h_pair(spark, d)
    return rounded(privacy.dcr_nndr(privacy.nearest_two(real, syn, categories=1)))


@query("h5_privacy_report", on_pair("SELECT sa || '_' || sb AS direction, round(quantile_cont(d1, 0.05), 6) AS dcr, round(quantile_cont(d1 / greatest(d2, 2.220446049250313e-16), 0.05), 6) AS nndr, count(*) AS n, "
                                    f"count(*) FILTER (d1 < 1e-9) AS n_copies, CAST({H_SHARE} AS DOUBLE) AS fraction FROM h2 GROUP BY sa, sb", **_HV))
def h5(spark, d):
    real, syn = real_syn(spark, d)
    return rounded(privacy.privacy_report(real, syn, ["qty", "disc", "tax"], ["status"], fraction=H_SHARE, seed=1))


ALPHAS = [2, 3, 8, 32]
_RDP = (f"WITH ledger AS ({t.LEDGER_SQL}), k AS (SELECT q, noise_stddev / l2_bound AS z, count(*) AS steps FROM ledger GROUP BY ALL), o AS (SELECT unnest([2, 3, 8, 32]) AS alpha), "
        "terms AS (SELECT q, z, steps, alpha, lgamma(alpha + 1) - lgamma(i + 1) - lgamma(alpha - i + 1) + i * ln(q) + (alpha - i) * ln(1 - q) + (i * i - i) / (2 * z * z) AS term "
        "FROM k, o, LATERAL (SELECT CAST(unnest(range(alpha + 1)) AS DOUBLE) AS i)), m AS (SELECT q, z, steps, alpha, max(term) AS mx FROM terms GROUP BY ALL), "
        "a AS (SELECT q, z, steps, alpha, mx + ln(sum(exp(term - mx))) AS log_a FROM terms JOIN m USING (q, z, steps, alpha) GROUP BY q, z, steps, alpha, mx), "
        "rdp AS (SELECT alpha, sum(log_a / (alpha - 1) * steps) AS rdp FROM a GROUP BY alpha) ")


@query("h6_rdp_compose", _RDP + "SELECT alpha, round(rdp, 6) AS rdp FROM rdp")
def h6(spark, d):
    return rounded(privacy.rdp_compose(ledger(spark, d), ALPHAS))


@query("h6_combined_noise", "SELECT o_orderkey AS step_id, round(1 / sqrt(1 / z ** 2 + 1 / (2 * z) ** 2), 6) AS noise_stddev FROM "
       "(SELECT o_orderkey, 1 + CAST(o_orderkey % 10 AS DOUBLE) / 10 AS z FROM orders)")
def h6b(spark, d):
    steps = ledger(spark, d)
    both = steps.unionByName(steps.withColumn("noise_stddev", F.col("noise_stddev") * 2))
    return rounded(privacy.combine_noise(both).select("step_id", "noise_stddev"))


@query("h7_privacy_spent", _RDP + "SELECT round(min(rdp - ln(1e-5) / (alpha - 1)), 6) AS epsilon, CAST(1e-5 AS DOUBLE) AS delta, arg_min(alpha, rdp - ln(1e-5) / (alpha - 1)) AS best_alpha FROM rdp")
def h7(spark, d):
    out = privacy.privacy_spent(privacy.rdp_compose(ledger(spark, d), ALPHAS), delta=1e-5)
    return out.withColumn("epsilon", F.round("epsilon", 6))


@query("h7_delta_of_epsilon", _RDP + "SELECT CAST(4000 AS DOUBLE) AS epsilon, round(exp(least(0, min((rdp - 4000) * (alpha - 1)))), 6) AS delta, arg_min(alpha, (rdp - 4000) * (alpha - 1)) AS best_alpha FROM rdp")
def h7b(spark, d):
    return rounded(privacy.privacy_spent(privacy.rdp_compose(ledger(spark, d), ALPHAS), epsilon=4000.0))


# ---- I: utility ----------------------------------------------------------------------------

_PRED = f"WITH pred AS ({t.PREDICTIONS_SQL})"


@query("i3_classification_metrics", _PRED + ", c AS (SELECT CAST(count(*) FILTER (label = 1 AND prob >= 0.5) AS DOUBLE) AS tp, CAST(count(*) FILTER (label = 0 AND prob >= 0.5) AS DOUBLE) AS fp, CAST(count(*) FILTER (label = 1 AND prob < 0.5) AS DOUBLE) AS fn, CAST(count(*) FILTER (label = 0 AND prob < 0.5) AS DOUBLE) AS tn FROM pred), "
       "r AS (SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk FROM pred), a AS (SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r) "
       "SELECT round(100 * (tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(auc, 6) AS auc, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fp + fn)) / 2, 6) AS f1 FROM c, a")
def i3(spark, d):
    return rounded(utility.classification_metrics(predictions(spark, d)))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_MULTI = "WITH m AS (" + " UNION ALL ".join(f"SELECT event_id AS row_id, '{c}' AS class, event_type AS truth, CAST((event_id * {31 + 6 * i}) % 101 AS DOUBLE) / 100 + CASE WHEN event_type = '{c}' THEN 0.25 ELSE 0 END AS prob FROM events"
                                            for i, c in enumerate(EVENT_TYPES)) + ")"


@query("i3_multiclass_metrics", _MULTI + ", r AS (SELECT class, truth, rank() OVER (PARTITION BY class ORDER BY prob) + (count(*) OVER (PARTITION BY class, prob) - 1) / 2.0 AS rk FROM m), "
       "a AS (SELECT class, CAST(count(*) FILTER (class = truth) AS DOUBLE) AS s, (sum(rk) FILTER (class = truth) - s * (s + 1) / 2) / (s * (count(*) - s)) AS auc FROM r GROUP BY class), "
       "g AS (SELECT row_id, truth, class AS guess FROM m QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, class) = 1), "
       "f AS (SELECT class, (SELECT count(*) FROM g WHERE truth = class) AS s, (SELECT count(*) FROM g WHERE guess = class) AS q, (SELECT count(*) FROM g WHERE guess = class AND truth = class) AS h FROM a) "
       "SELECT round(100.0 * (SELECT sum(h) / sum(s) FROM f), 6) AS accuracy, round((SELECT sum(auc * s) / sum(s) FROM a), 6) AS auc, round((SELECT sum(2.0 * h / (s + q) * s) / sum(s) FROM f), 6) AS f1")
def i3b(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("truth"), F.inline(F.array(*(F.struct(
        F.lit(c).alias("class"), (((F.col("event_id") * (31 + 6 * i)) % 101).cast("double") / 100 + F.when(F.col("event_type") == c, 0.25).otherwise(0.0)).alias("prob"))
        for i, c in enumerate(EVENT_TYPES)))))
    return rounded(utility.multiclass_metrics(rows))


@query("i4_regression_metrics", _PRED + " SELECT round(avg(abs(y - y_hat) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, round(1 - var_pop(y - y_hat) / var_pop(y), 6) AS explained_variance, round(1 - avg((y - y_hat) ** 2) / var_pop(y), 6) AS r2 FROM pred")
def i4(spark, d):
    return rounded(utility.regression_metrics(predictions(spark, d)))


@query("i5_average_precision", _PRED + ", s AS (SELECT prob, sum(label) AS pos, count(*) AS n FROM pred GROUP BY prob), w AS (SELECT pos, sum(pos) OVER o AS tp, sum(n) OVER o AS k FROM s WINDOW o AS (ORDER BY prob DESC)) "
       "SELECT round(sum(pos / (SELECT sum(label) FROM pred) * tp / k), 6) AS ap FROM w")
def i5(spark, d):
    return rounded(utility.average_precision(predictions(spark, d)))


def is_rare():
    return F.col("label") == "rare"


X_NUM, X_CAT = ["qty", "disc", "tax"], ["flag", "status"]


def split_real(spark, d):
    real, syn = real_syn(spark, d)
    return sample.stratified_split(real, "label", 0.3, seed=3), syn


@query("i1_train_classifier")
def i1(spark, d):
    s, _ = split_real(spark, d)
    return rounded(utility.train_classifier(s.filter("part = 'train'"), s.filter("part = 'test'"), is_rare(), X_NUM, X_CAT, "tree"))


def _classes(model: str) -> None:
    @query(f"i1_{model}_classes")
    def classes(spark, d):
        s, _ = split_real(spark, d)
        return rounded(utility.predict_classes(s.filter("part = 'train'"), s.filter("part = 'test'"), "label", X_NUM, X_CAT, model))


for _model in ("logistic", "forest", "mlp"):
    _classes(_model)


def _regressor(model: str) -> None:
    @query(f"i2_{model}")
    def regressor(spark, d):
        s, _ = split_real(spark, d)
        return rounded(utility.train_regressor(s.filter("part = 'train'"), s.filter("part = 'test'"), "price", ["qty", "disc", "tax"], ["status"], model))


for _model in ("ols", "lasso"):
    _regressor(_model)


@query("i6_class_gap")
def i6b(spark, d):
    s, syn = split_real(spark, d)
    return rounded(utility.class_gap(s, syn, "label", X_NUM, X_CAT, ["logistic", "tree"]))


@query("i6_regression_mean_gap")
def i6c(spark, d):
    s, syn = split_real(spark, d)
    return rounded(utility.mean_gap(utility.regression_gap(s, syn, "price", ["qty", "disc", "tax"], ["status"], ["ols", "ridge"])))


@query("i2_train_regressor")
def i2(spark, d):
    s, _ = split_real(spark, d)
    return rounded(utility.train_regressor(s.filter("part = 'train'"), s.filter("part = 'test'"), "price", ["qty", "disc", "tax"], ["status"], "ridge"))


@query("i6_utility_gap")
def i6(spark, d):
    s, syn = split_real(spark, d)
    return rounded(utility.utility_gap(s, syn, is_rare(), X_NUM, X_CAT, ["tree"]))


@query("i7_rare_event_recall")
def i7(spark, d):
    s, syn = split_real(spark, d)
    return rounded(utility.rare_event_recall(s, syn, "label", X_NUM, X_CAT))


@query("i8_detector")
def i8(spark, d):
    return rounded(utility.detector_report(*real_syn(spark, d), X_NUM, X_CAT))


@query("i9_detector_importance")
def i9(spark, d):
    return rounded(utility.detector_importance(*real_syn(spark, d), X_NUM, X_CAT))
