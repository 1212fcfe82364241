"""Privacy queries ask for every row: on a small lineitem table against brute force in numpy."""

import numpy as np
import pytest

from tabulith.operators import neighbours, privacy
from tabulith.plans import catalog


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The folder of 300 rows of 240 different vectors, and the nearest two of each row by its order: even orders are real, odd ones synthetic."""
    rng = np.random.RandomState(5)
    x = np.column_stack([rng.randint(1, 51, 300), rng.randint(0, 11, 300) / 100, rng.randint(0, 9, 300) / 100, rng.randint(0, 2, 300)]).astype(float)
    x[240:] = x[:60]
    rows = [(i, 1, 1, 1, *v[:3].tolist(), 1.0, "N", "FO"[int(v[3])]) for i, v in enumerate(x)]
    path = tmp_path_factory.mktemp("small")
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(f"{path}/lineitem.parquet")
    real = np.arange(300) % 2 == 0
    x[~real, 0] += 3
    z = np.column_stack([x[:, :3], x[:, 3] == 0, x[:, 3] == 1])
    z = (z - z[real].mean(0)) / z[real].std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    return str(path), {i: np.sort(d[i, real != real[i]])[:2] for i in range(300)}


def every_row(got, near, odd):
    rows = {int(r.row_key.split("-")[0]): (r.d1, r.d2) for r in got.collect()}
    assert sorted(rows) == list(range(odd, 300, 2))
    for i, d in rows.items():
        assert np.allclose(d, near[i], atol=1e-6)


@pytest.mark.parametrize("few", [0, 1 << 14])
def test_two_smallest_of_every_real_row(spark, table, monkeypatch, few):
    monkeypatch.setattr(neighbours, "FEW", few)
    every_row(catalog.QUERIES["f7_two_smallest"](spark, table[0]), table[1], 0)


def test_nearest_two_of_every_synthetic_row(spark, table):
    every_row(catalog.QUERIES["h2_nearest_two"](spark, table[0]), table[1], 1)


def test_thresholds_are_those_of_every_real_row(spark, table):
    d1, d2 = np.array([table[1][i] for i in range(0, 300, 2)]).T
    r = catalog.QUERIES["h3_h4_dcr_nndr"](spark, table[0]).first()
    assert r.n == 150 and r.dcr == pytest.approx(np.quantile(d1, 0.05), abs=2e-6) and r.dcr > 0.1
    assert r.nndr == pytest.approx(np.quantile(d1 / np.maximum(d2, privacy.EPSILON), 0.05), abs=2e-6)
