"""The association operators on small inputs, and every query with SQL against DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lociflow.operators import linear, markers, samples, segments
from lociflow.plans import association

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(association.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = association.QUERIES[name](spark, DATA)
    expected = con.sql(association.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert mine == sorted(tuple(plain(r[expected.columns.index(c)]) for c in columns) for r in expected.fetchall())


def test_segment_bounds(spark):
    rows = [("chr1", i, 1000 + 100 * i, 1e-10, 1.0, 6.0) for i in range(5)]
    df = spark.createDataFrame(rows, "chrom string, ord long, pos long, p double, beta double, stat double")
    out = segments.threshold_segments(df).collect()
    assert [(r["start"], r["end"], r["n_markers"]) for r in out] == [(999, 1400, 5)]


def test_gram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(m, s, float(x[m, s])) for m in range(40) for s in range(6)], "marker long, sample long, value double")
    rows = linear.rows_of(df, 6)
    s, _, m = linear.singular_values(rows, 6, 3)
    assert m == 40
    assert np.allclose(s, np.linalg.svd(x - x.mean(axis=1, keepdims=True), compute_uv=False)[:3])
    basis = rng.normal(size=(6, 2))
    got = {r["marker"]: np.array(r["x"]) for r in linear.residuals(rows, basis).collect()}
    q, _ = np.linalg.qr(basis)
    assert all(np.allclose(got[m], x[m] - q @ (q.T @ x[m])) for m in range(40))


def test_ols_without_variance(spark):
    df = spark.createDataFrame([(0, s, 1.0) for s in range(5)], "marker long, sample long, value double")
    y = spark.createDataFrame([(s, float(s)) for s in range(5)], "sample long, y double")
    r = linear.ols(df, y).first()
    assert (r["beta"], r["se"], r["stat"]) == (0.0, float("inf"), 0.0)


def test_region_edges_are_inside(spark):
    m = spark.createDataFrame([("chr1", p) for p in (9, 10, 20, 21)] + [("chr2", 15)], "chrom string, pos long")
    r = spark.createDataFrame([("chr1", 10, 20)], "chrom string, start long, end long")
    assert sorted(tuple(x) for x in markers.outside_regions(m, r).collect()) == [("chr1", 9), ("chr1", 21), ("chr2", 15)]


def test_missing_call_rate_is_excluded(spark):
    df = spark.createDataFrame([(1, None, 0.1, 0.1, "OK", 0.0, False, False), (2, 0.99, 0.1, None, None, None, None, True)], "sample long, call_rate double, lrr_sd double, baf_sd double, sex_status string, inbreeding_f double, pre_pca boolean, related boolean")
    out = {r["sample"]: (list(r["reasons"]), r["in_grm"]) for r in samples.exclusions(df).collect()}
    assert out == {1: (["call_rate"], False), 2: (["relatedness"], True)}
