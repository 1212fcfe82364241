"""Scans and sinks, and the fixtures derived from the base tables.

The fixtures' SQL runs unchanged in Spark and DuckDB. ``pair`` holds a real table and three
deterministic distortions of other rows as its synthetic runs: it exercises operators and says
nothing about any generator.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR_SQL = """
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
                 CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS row_key,
       CASE WHEN l_orderkey % 2 = 0 THEN 'real' ELSE 'syn' END AS side,
       CAST((l_orderkey % 2) * (1 + l_orderkey % 3) AS INT) AS run,
       l_quantity + CAST(3 * (l_orderkey % 2) AS DOUBLE) AS qty,
       CASE WHEN (l_orderkey * 7 + l_linenumber) % 23 = 0 THEN NULL
            ELSE l_extendedprice * (1 + CAST(l_orderkey % 2 AS DOUBLE) / 10) END AS price,
       l_discount AS disc,
       l_tax AS tax,
       l_extendedprice - 5000 AS margin,
       CASE WHEN l_quantity > 40 THEN CAST(40 AS DOUBLE) ELSE l_quantity END AS capped,
       CASE WHEN (l_orderkey * 3 + l_linenumber) % 29 = 0 THEN NULL
            WHEN l_orderkey % 2 = 1 AND l_linenumber = 7 THEN 'X'
            WHEN l_orderkey % 2 = 1 AND l_linenumber = 5 THEN 'R'
            ELSE l_returnflag END AS flag,
       l_linestatus AS status,
       CASE WHEN l_quantity >= 48 AND l_discount >= 0.05 THEN 'rare'
            WHEN l_quantity >= 30 THEN 'mid' ELSE 'common' END AS label
FROM lineitem
"""
LEDGER_SQL = """
SELECT o_orderkey AS step_id,
       CAST(1 + o_orderkey % 5 AS DOUBLE) / 100 AS q,
       1 + CAST(o_orderkey % 10 AS DOUBLE) / 10 AS noise_stddev,
       CAST(1 AS DOUBLE) AS l2_bound
FROM orders
"""
PREDICTIONS_SQL = """
SELECT event_id AS row_id,
       CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS label,
       CAST((event_id * 37) % 101 AS DOUBLE) / 100 AS prob,
       value AS y,
       value * (CAST(90 + 2 * (event_id % 11) AS DOUBLE) / 100) AS y_hat
FROM events
"""
NUMERIC = ("qty", "price", "disc", "tax", "margin", "capped")
CATEGORIES = ("flag", "status", "label")


def fixture(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    """A fixture's SQL over one base table; no view is left behind."""
    return spark.sql(sql.replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "lineitem", PAIR_SQL)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "orders", LEDGER_SQL)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "events", PREDICTIONS_SQL)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def scan_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header line, by an explicit schema: a file's own values never decide its types."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_replicas(spark: SparkSession, glob: str, schema: T.StructType | str, pattern: str = r"(\d+)[^/]*(?:/[^/]*)?$",
                  expected: list[int] | None = None) -> DataFrame:
    """All synthetic runs of a data set, with ``run`` taken from the file's name, not from its place in a listing.

    With ``expected``, runs that are missing are an error that names them.
    """
    rows = scan_csv(spark, glob, schema).withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).cast("int"))
    if expected is not None:
        found = {r.run for r in rows.select("run").distinct().limit(len(expected) + 1).collect()}
        if missing := sorted(set(expected) - found):
            raise ValueError(f"no files for runs {missing}")
    return rows


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def sink_metrics(metrics: DataFrame, path: str, form: str = "parquet") -> None:
    """Long metrics (run, metric, feature, value) as parquet or json."""
    metrics.select("run", "metric", "feature", "value").write.format(form).save(path)
