"""Every catalogue query against its SQL on the same tables."""

import duckdb
import numpy as np
import pytest

from stratavox.operators import mesh, volume
from stratavox.plans import catalogue, standin

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    key = sorted(columns)
    left = sorted((tuple(r[c] for c in key) for r in got.collect()), key=repr)
    right = sorted((tuple(r[columns.index(c)] for c in key) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert not catalogue.QUERIES[name](spark, sf_dir).isEmpty()


def test_flagship(spark, sf_dir):
    row = catalogue.flagship(spark, sf_dir).first()
    assert row["threshold"] == 130 and abs(row["foreground"] - 0.05) < 1e-9
    assert (round(row["x_low"], 3), round(row["x_high"], 3), round(row["z_low"], 2), round(row["z_high"], 2)) == (0.225, 0.775, 0.39, 0.61)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["dedupe_first"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan
    part = volume.crop(standin.volume(spark, sf_dir), volume.Crop(2, 8, 0, 8, 0, 8, 1))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(vec_id,8)" in plan and "GreaterThanOrEqual(vec_id,2)" in plan


@pytest.fixture(scope="module")
def dense(spark, sf_dir):
    a = np.zeros((standin.depth(spark, sf_dir), 8, 8), np.int64)
    for r in standin.volume(spark, sf_dir).collect():
        a[r["z"], r["y"], r["x"]] = r["v"]
    return a


def test_marching_cubes_takes_every_slice(spark, sf_dir, dense):
    keys = mesh.march(dense, 127.5)[0]
    got = catalogue.QUERIES["marching_cubes"](spark, sf_dir).select("a", "b", "c").collect()
    assert len(dense) > 32 and sorted(map(tuple, got)) == sorted(map(tuple, keys.tolist()))


def test_volume_zoom_takes_every_slice(spark, sf_dir, dense):
    n = len(dense)
    out = (int(np.floor(n * 0.625 + 0.5)), 5, 5)
    value = dense.astype(float)
    for axis, m in enumerate(out):
        at = np.arange(m) * ((dense.shape[axis] - 1) / (m - 1))
        low = np.minimum(at.astype(int), dense.shape[axis] - 2)
        f = (at - low).reshape([-1 if k == axis else 1 for k in range(3)])
        value = value.take(low, axis) * (1 - f) + value.take(low + 1, axis) * f
    want = np.floor(np.round(value, 9) + 0.5).astype(int)
    got = {(r["z"], r["y"], r["x"]): r["v"] for r in catalogue.QUERIES["volume_zoom"](spark, sf_dir).collect()}
    assert got == {tuple(map(int, i)): int(v) for i, v in np.ndenumerate(want)}
