"""Queries against their SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tabulith.plans import catalog

DATA = "/root/testdata/sf0.001"
SLOW = {"g6_fidelity_summary", "g5_association_distance", "h5_privacy_report", "g11_support_summary", "g8_tail_divergence_mean", "d11_mode_invert"}


def rows(frame: pd.DataFrame) -> list:
    plain = lambda v: None if v is None or v is pd.NA or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(([plain(v) for v in r] for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLES) - SLOW))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(duck.sql(catalog.ORACLES[name]).df())
