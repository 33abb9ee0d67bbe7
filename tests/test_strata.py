"""Scans by sex, exclusions, figure data and audits."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import linear, markers, report, samples, scans, segments, strata
from lociflow.sources import writers

ROWS = "marker long, chrom string, x array<double>"


def frame(spark, x, chroms):
    return spark.createDataFrame([(i, c, [None if math.isnan(v) else float(v) for v in row]) for i, (row, c) in enumerate(zip(x, chroms, strict=True))], ROWS)


def plain(x, y, c):
    d = np.column_stack([np.ones(len(y)), *c, x])
    b, *_ = np.linalg.lstsq(d, y, rcond=None)
    r = y - d @ b
    return b[-1], math.sqrt(r @ r / (len(y) - d.shape[1]) * np.linalg.inv(d.T @ d)[-1, -1])


def test_scans_by_sex(spark):
    rng = np.random.default_rng(3)
    x, y, sexes, c = rng.normal(size=(5, 40)), rng.normal(size=40), np.arange(40) % 3, rng.normal(size=(40, 1))
    rows = frame(spark, x, ["chrX", "X", "chrY", "MT", "chr1"])
    covariates = np.hstack([c, np.ones((40, 1)), (sexes == 1).astype(float)[:, None]])
    got = {(r["mode"], r["marker"]): (r["beta"], r["se"], r["method"]) for r in strata.sex_scans(rows, sexes, y, covariates, {"M": np.eye(40)}, ["x_male_only", "y_male_only", "mt_female_only", "x_with_sex_covariate"]).collect()}
    male, female = sexes == 1, sexes == 2
    for mode, m, s, extra in (("x_male_only", 0, male, []), ("x_male_only", 1, male, []), ("y_male_only", 2, male, []), ("mt_female_only", 3, female, [])):
        assert got[mode, m][:2] == pytest.approx(plain(x[m][s], y[s], [c[s, 0], *extra])), mode
    assert got["mt_female_only", 3][2] == "lmm" and got["x_male_only", 0][2] == "ols" and len(got) == 6
    assert strata.sex_scans(rows, np.zeros(40), y, None, None, ["x_male_only"]).count() == 0


def test_exclusions_of_markers(spark):
    x = np.random.default_rng(1).normal(size=(4, 20))
    x[1], x[2] = 2.0, np.nan
    rows = frame(spark, x, ["1"] * 4).withColumn("intensity_only", F.col("marker") < 2)
    scan, judged = strata.excluded_scan(rows, np.arange(20.0), np.ones((20, 1)))
    assert {r["marker"]: r["reasons"] for r in judged.collect()} == {0: "intensity_only", 1: "intensity_only;monomorphic_lrr", 2: "monomorphic_lrr", 3: ""}
    assert [r["marker"] for r in scan.collect()] == [3]
    assert tuple(strata.exclusion_info(judged).first()) == (4, 1, 3, 2, 2)
    assert strata.marker_exclusions(judged.drop("reasons", "tested"), False, False).where("tested").count() == 4
    assert strata.varying(np.array([[1.0, 2.0, np.nan], [1.0, 3.0, np.nan]])).tolist() == [1]


def test_links_over_tiles_and_bins(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (30, 25)).astype(float)
    x[5], x[17] = x[4], x[16]
    pos = rng.integers(0, 900, 30)
    chrom = np.where(np.arange(30) < 20, "1", "2")
    rows, places = frame(spark, x, chrom).drop("chrom"), spark.createDataFrame([(i, str(c), int(p)) for i, (c, p) in enumerate(zip(chrom, pos, strict=True))], "marker long, chrom string, pos long")
    tile, markers.TILE = markers.TILE, 3
    try:
        got = {(r["a"], r["b"]): r["r2"] for r in markers.ld_pairs(rows, places, 25, 200, 0.05).collect()}
    finally:
        markers.TILE = tile
    r2 = np.corrcoef(x) ** 2
    want = {(a, b): r2[a, b] for a in range(30) for b in range(30) if chrom[a] == chrom[b] and pos[a] < pos[b] <= pos[a] + 200 and r2[a, b] > 0.05}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_figure_data(spark):
    assert report.chi2_upper(0.05) == pytest.approx(3.841459, abs=1e-6) and report.chi2_upper(1e-12) == pytest.approx(50.8441, abs=1e-3)
    p = [(i, float(v)) for i, v in enumerate(np.linspace(0.01, 0.99, 20))]
    records = spark.createDataFrame(p, "marker long, p double")
    assert report.lambda_gc_of_p(records) == pytest.approx(sum(report.chi2_upper(v) for _, v in p[9:11]) / 2 / report.CHI2_MEDIAN)
    assert math.isnan(report.lambda_gc_of_p(records.limit(1)))
    assert [r["rank"] for r in report.qq_thinned(records, 10, 4).orderBy("rank").collect()] == report.kept_ranks(20, 10, 4)
    assert report.manhattan_points(records.withColumn("p", F.when(F.col("marker") == 3, 1e-9).otherwise(F.col("p"))), 5).count() == 6
    (_, low, high), = report.qq_envelope(1, [1])  # uniform
    assert (low, high) == pytest.approx((0.025, 0.975))
    x = np.random.default_rng(0).beta(3, 8, 200_000)
    assert scans.beta_quantile(0.3, np.array([3.0]), np.array([8.0]))[0] == pytest.approx(np.quantile(x, 0.3), abs=3e-3)
    assert report.loci([("chr1", 100), ("1", 150), ("2", 150), ("1", 900)], 500, 10) == [("chr1", 100), ("2", 150), ("1", 900)]


def test_audits_and_names(spark, tmp_path):
    rec = spark.createDataFrame([("s", "sample", "a", True, None), ("s", "sample", "b", False, "low"), ("s", "sample", "c", False, "low;late"), ("s", "sample", "d", False, "low")], "stage string, id_type string, id string, included boolean, reason string")
    reasons = samples.audit_reasons(rec)
    assert {r["reason"]: r["n"] for r in reasons.collect()} == {"low": 2, "low;late": 1}
    writers.audit(rec, f"{tmp_path}/a", 4)
    text_of = lambda name: "".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*"))).splitlines()
    lines = text_of("a")
    assert lines[0] == "stage\tid_type\tid\tstatus\treason" and lines[1] == "s\tsample\tn=1\tincluded_summary\t" and sorted(lines[2:])[0] == "s\tsample\tb\texcluded\tlow"
    writers.audit_summary(samples.audit(rec), reasons, f"{tmp_path}/b")
    assert text_of("b")[1].endswith('0.25\t0.75\t{"low":2,"low;late":1}')
    later = spark.createDataFrame([("s", "m", "x", 1, "old"), ("s", "m", "x", 2, "new")], "stage string, id_type string, id string, order int, reason string")
    assert samples.latest(later).first()["reason"] == "new"
    records = spark.createDataFrame([(1, "2"), (2, "1")], "marker long, chrom string")
    found = spark.createDataFrame([("1", 5, 9), ("2", 50, 60), ("2", 1, 3)], "chrom string, start long, end long")
    assert [(r["chrom"], r["start"], r["name"]) for r in segments.named(found, records).orderBy("name").collect()] == [("2", 1, "region_1"), ("2", 50, "region_2"), ("1", 5, "region_3")]


def test_ranks_and_residuals_of_patterns(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(500)], "v double").repartition(5)
    assert {r["v"]: r["rank"] for r in markers.ranks(df, [F.col("v")], 7).collect()} == {float(v): v + 1 for v in range(500)}
    x, basis = rng.normal(size=(6, 30)), rng.normal(size=(30, 3))
    x[1, :5], x[2, 3:20] = np.nan, np.nan
    got = {r["marker"]: np.array(r["x"], float) for r in linear.residuals(frame(spark, x, ["1"] * 6), basis).collect()}
    for m in (0, 1, 3):
        s = np.isfinite(x[m])
        assert got[m][s] == pytest.approx(x[m][s] - basis[s] @ np.linalg.lstsq(basis[s], x[m][s], rcond=None)[0])
    assert got[2][~np.isnan(x[2])] == pytest.approx(x[2][~np.isnan(x[2])])
