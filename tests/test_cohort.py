"""Correction, builds, writers and the two-state path on small inputs, and every cohort query with SQL against DuckDB."""

import itertools
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_association import DATA, plain

from lociflow.operators import correction, linear, segments
from lociflow.plans import cohort
from lociflow.sources import builds, readers, writers


@pytest.mark.parametrize("name", sorted(cohort.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df, expected = cohort.QUERIES[name](spark, DATA), con.sql(cohort.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert mine and mine == sorted(tuple(plain(r[expected.columns.index(c)]) for c in columns) for r in expected.fetchall())


def test_correction_with_projected_samples(spark):
    rng = np.random.default_rng(42)
    n, known = 20, np.arange(20) % 5 != 0
    x = rng.normal(size=(60, 2)) @ rng.normal(size=(2, n)) + 0.02 * rng.normal(size=(60, n))
    rows = linear.rows_of(spark.createDataFrame([(m, s, float(x[m, s])) for m in range(60) for s in range(n)], "marker long, sample long, value double"), n)
    out, info = correction.corrected(rows, rows, known, 10, 2)
    mean = x[:, known].mean(axis=1, keepdims=True)
    u, s, vt = np.linalg.svd(x[:, known] - mean, full_matrices=False)
    basis = np.zeros((n, 2))
    basis[known], basis[~known] = vt[:2].T, ((u[:, :2].T @ (x[:, ~known] - mean)) / s[:2, None]).T
    q, _ = np.linalg.qr(basis)
    got = {r["marker"]: np.array(r["x"]) for r in out.collect()}
    assert info["k"] == 2 and info["n_markers_used"] == 60 and np.allclose(info["singular_values"][:2], s[:2])
    assert all(np.allclose(got[m], x[m] - q @ (q.T @ x[m]), atol=1e-6) for m in range(60))


def test_rows_keep_missing_cells(spark):
    df = spark.createDataFrame([(1, 0, 1.5), (1, 2, None), (2, 5, 1.0), (2, None, 3.0)], "marker long, sample long, value double")
    assert {r["marker"]: list(r["x"]) for r in linear.rows_of(df, 3).collect()} == {1: [1.5, None, None], 2: [None, None, None]}
    assert linear.gram(linear.rows_of(df.where("false"), 3), 3)[1] == 0


def test_elbow():
    assert correction.elbow(np.array([9.0, 1.0])) == 1 and correction.elbow(np.array([10.0, 2.0, 1.9, 1.8])) == 1


def test_two_state_path_is_the_best_of_all(spark):
    p = [0.5, 1e-9, 1e-8, 0.7, 0.9, 1e-30, 1e-30, 1e-20]
    df = spark.createDataFrame([("chr1", i, i, v, 0.0, 0.0) for i, v in enumerate(p)], "chrom string, ord long, pos long, p double, beta double, stat double")
    got = tuple(r["state"] for r in segments.viterbi_states(df).orderBy("ord").collect())
    rate, x = (np.log(10), 0.1), -np.log10(p)

    def likelihood(path):
        out = np.log((1 - 1e-3, 1e-3)[path[0]]) + sum(np.log(rate[s]) - rate[s] * v for s, v in zip(path, x, strict=True))
        return out + sum(np.log(1 - 1e-4 if a == b else 1e-4) for a, b in itertools.pairwise(path))

    assert got == max(itertools.product((0, 1), repeat=len(p)), key=likelihood)


@pytest.mark.parametrize(("lines", "build"), [("##contig=<ID=chr1,length=248387328>", "T2T-CHM13"), ("##contig=<ID=1,length=249250000>", "GRCh37"), ("##contig=<ID=chr2,assembly=hg38>", "GRCh38"), ("##contig=<ID=chr11,length=248387328>", None), ("##x", None)])
def test_build_of_a_header(spark, tmp_path, lines, build):
    (tmp_path / "a.vcf").write_text(f"##fileformat=VCFv4.2\n{lines}\n#CHROM\tPOS\n")
    assert builds.detect_build(spark, str(tmp_path / "a.vcf")) == build


def test_regions(spark):
    assert builds.build_name("HG19") == "GRCh37" and builds.regions(spark, "hs1").count() == 26
    assert {r["chrom"] for r in builds.regions(spark, "GRCh38", builds.PSEUDOAUTOSOMAL, False).collect()} == {"X", "Y"}
    with pytest.raises(ValueError):
        builds.build_name("hg17")


def test_vcf_round_trip_in_order(spark, tmp_path):
    rows = [(f"chr{c}", 100 - p, f"v{c}_{p}", "A", ["G"] if p % 2 else [], [0.5, None]) for c in (10, 2) for p in range(20)]
    df = spark.createDataFrame(rows, "chrom string, pos long, variant_id string, ref string, alts array<string>, x array<double>")
    writers.vcf(df, ["S1", "S2"], str(tmp_path / "out"), parts=4)
    lines = [line for f in sorted((tmp_path / "out").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[2].endswith("FORMAT\tS1\tS2")
    places = [(int(c[3:]), int(p)) for c, p, *_ in (line.split("\t") for line in lines[3:])]
    assert places == sorted(places) and len(places) == 40
    back = {r["variant_id"]: (r["pos"], list(r["alts"]), list(r["lrr"])) for r in readers.vcf(spark, str(tmp_path / "out")).collect()}
    assert back == {v: (p, a, x) for _, p, v, _, a, x in rows}


def test_bed_has_one_header(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 999, 1400, 5, 1e-10, 1.0, 6.0)], "chrom string, start long, end long, n_markers long, min_p double, mean_beta double, max_abs_stat double")
    writers.bed(df, str(tmp_path / "b"))
    lines = [line for f in sorted((tmp_path / "b").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines[0].startswith("#chrom\tstart") and lines[1].split("\t")[:5] == ["chr1", "999", "1400", "chr1_999_1400", "5"] and len(lines) == 2
