"""Association as one call, scans by sex in one pass, required samples, contig names, line numbers and links by number."""

import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import dispatch, linear, markers, report, scans, strata
from lociflow.sources import readers

N = 40


def rows_of(spark, x, **more):
    rows = [(i, "chr1", 100 + i, f"rs{i}" if i % 2 else ".", i % 6 == 0, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "marker long, chrom string, pos long, variant_id string, intensity_only boolean, x array<double>").repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(12, N))
    x[4], x[5, 3:] = 1.0, np.nan
    x[7, ::5] = np.nan
    return x, rng.normal(size=N), rng.normal(size=(N, 2))


def test_every_method_by_one_call(spark, data):
    x, y, c = data
    rows = rows_of(spark, x)
    g = np.random.default_rng(1).normal(size=(N, 90))
    k = g @ g.T / 90
    value, vector = np.linalg.eigh(k)
    case = (y > 0).astype(float)
    plain = rows.select("marker", "x")
    for method, target, more, direct in (
        ("ols", y, {}, scans.ols_scan(plain, y, c)),
        ("logistic", case, {}, scans.logistic_scan(plain, case, c)),
        ("lmm", y, {"relationship": k}, scans.lmm_scan(plain, y, k, c)),
        ("lmm", y, {"vectors": (np.maximum(value, 0), vector, np.maximum(value, 0).sum())}, scans.low_rank_lmm_scan(plain, y, np.maximum(value, 0), vector, np.maximum(value, 0).sum(), c)),
    ):
        out, judged = dispatch.associate(rows, target, c, method, **more)
        want = {r["marker"]: r for r in direct.collect()}
        got = out.orderBy("marker").collect()
        assert [r["marker"] for r in got] == [i for i in range(12) if i % 6 and i != 4] and {r["method"] for r in got} == {method}
        for r in got:
            assert (r["beta"], r["p_value"]) == pytest.approx((want[r["marker"]]["beta"], want[r["marker"]]["p_value"]))
            assert r["variant_id"] == (f"rs{r['marker']}" if r["marker"] % 2 else f"chr1:{100 + r['marker']}")
        assert {r["marker"]: r["reasons"] for r in judged.where("not tested").collect()} == {0: "intensity_only", 6: "intensity_only", 4: "monomorphic_lrr"}
    every, _ = dispatch.associate(rows, y, None, "ols", intensity_only=False, monomorphic=False)
    assert every.count() == 12


def test_arguments_are_checked(spark, data, caplog):
    x, y, c = data
    rows = rows_of(spark, x)
    for args, said in (
        ({"y": y[:-1], "method": "ols"}, "phenotype has shape"), ({"y": y, "covariates": c[1:], "method": "ols"}, "covariates have shape"), ({"y": y}, "needs a relationship"), ({"y": y, "relationship": np.eye(3)}, "relationship matrix has shape"),
        ({"y": y, "vectors": (np.ones(2), np.ones((N, 3)), 1.0)}, "vectors have shape"), ({"y": y, "method": "logistic"}, "of 0 and 1"), ({"y": np.zeros(N), "method": "logistic"}, "of 0 and 1"), ({"y": y, "method": "other"}, "no method"),
    ):
        with pytest.raises(ValueError, match=said):
            dispatch.associate(rows, **args)
    rare = (np.arange(N) < 2).astype(float)
    with caplog.at_level(logging.WARNING):
        dispatch.associate(rows, rare, None, "lmm", np.eye(N))
        dispatch.associate(rows, (y > 0).astype(float), None, "logistic", np.eye(N))
    assert "share of cases of 0.050 (2 of 40)" in caplog.text and "does not use the relationship" in caplog.text
    caplog.clear()
    dispatch.associate(rows, (y > 0).astype(float), None, "lmm", np.eye(N))
    assert not caplog.text


def test_scans_by_sex_read_rows_once_and_exclude_by_stratum(spark, data):
    x, y, _ = data
    sexes = np.arange(N) % 2 + 1
    x = x.copy()
    x[1, sexes == 1] = 0.5  # one value among males only
    chroms = ["chrX", "X", "chrY", "MT", "chr1", "chrM"] * 2
    rows = spark.createDataFrame([(i, c, [None if np.isnan(v) else float(v) for v in r]) for i, (c, r) in enumerate(zip(chroms, x, strict=True))], "marker long, chrom string, x array<double>")
    judged = strata.sex_scan_rows(rows, sexes, y)
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1
    gone = {(r["mode"], r["marker"]) for r in judged.where("reason is not null").collect()}
    assert ("x_male_only", 1) in gone and ("x_female_only", 1) not in gone and ("x_with_sex_covariate", 1) not in gone
    info = {r["mode"]: (r["n_markers"], r["n_tested"], r["n_monomorphic"]) for r in strata.mode_exclusions(judged).collect()}
    assert info["x_male_only"] == (4, 3, 1) and info["x_female_only"] == (4, 4, 0) and set(info) == {line.split()[0] for line in strata.MODES.split("\n") if line}
    got = {(r["mode"], r["marker"]): r["beta"] for r in strata.sex_scans(rows, sexes, y, monomorphic=True).collect()}
    male = sexes == 1
    direct = {r["marker"]: r["beta"] for r in scans.ols_scan(rows.select("marker", "x"), y[male], None, np.flatnonzero(male)).collect()}
    assert all(got["y_male_only", m] == pytest.approx(direct[m]) for m in (2, 8)) and ("x_male_only", 1) not in got


def test_required_samples_fail_in_the_same_job(spark):
    samples, known = spark.range(10).withColumnRenamed("id", "sample"), spark.range(3, 30).withColumnRenamed("id", "sample")
    assert dispatch.required(samples.where("sample > 4"), known).count() == 5
    with pytest.raises(Exception, match="3 samples are not in the genotypes, first: 0, 1, 2"):
        dispatch.required(samples, known).collect()
    assert dispatch.required(samples.where("false"), known).collect() == []


def test_genes_of_contigs_named_either_way(spark):
    genes = spark.createDataFrame([("chr1", "A", 100, 200), ("2", "B", 10, 20)], "chrom string, symbol string, start long, end long")
    hits = spark.createDataFrame([(1, "1", 150), (2, "chr2", 30), (3, "chr3", 5)], "hit_id long, chrom string, pos long")
    assert sorted(map(tuple, report.nearest_genes(hits, genes).collect())) == [(1, "A", 0), (2, "B", 10), (3, None, -1)]
    assert sorted(map(tuple, report.genes_in_window(hits, genes, 50).collect())) == [(1, "A", 1), (2, "B", 1)]
    assert report.genes_in_region(genes, "1", 150, 160).count() == report.genes_in_region(genes, "chr2", 1, 10).count() == 1
    spans = spark.createDataFrame([("1", "A", 50, 60, "-", 1), ("1", "A", 10, 20, "+", 2)], "chrom string, symbol string, start long, end long, strand string, record long")
    assert tuple(report.gene_spans(spans).first()) == ("1", "A", 10, 60, "-")


def test_lines_are_numbered_through_all_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    for part in range(2):
        (tmp_path / f"part{part}").write_text("\n".join(lines[part * 3000 : (part + 1) * 3000]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line"], r["value"]) for r in got] == list(enumerate(lines))
    vcf = tmp_path / "a.vcf"
    vcf.write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + "".join(f"1\t{9 - i}\tv{i}\tA\tC\t.\t.\t.\tLRR\t0.5\n" for i in range(9)))
    assert [r["variant_id"] for r in readers.vcf(spark, str(vcf), numbered=True).orderBy("record").collect()] == [f"v{i}" for i in range(9)]


def test_tab_separated_sheets_and_phenotypes_without_a_column(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("sample_id\tnote, and more\nb\t1,2\na\tx\nb\tlast\n")
    got = readers.sectioned(spark, f"{tmp_path}/s.tsv", key="sample_id")
    assert sorted((r["sample"], r["note, and more"]) for r in got.collect()) == [("a", "x"), ("b", "last")]
    (tmp_path / "p.tsv").write_text("sample_id\na\n")
    with pytest.raises(ValueError, match="beside sample_id"):
        readers.phenotypes(spark, f"{tmp_path}/p.tsv")


def test_links_by_number(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, (60, 30)).astype(float)
    g[40], g[59] = g[2], g[50]
    rows = spark.createDataFrame([(i * 7, [float(v) for v in r]) for i, r in enumerate(g)], "marker long, x array<double>")
    got = {(r["a"] // 7, r["b"] // 7) for r in markers.ld_pairs_by_number(rows, 30, 12, 0.2).collect()}
    r2 = np.corrcoef(g) ** 2
    assert got == {(i, j) for i in range(60) for j in range(i + 1, min(60, i + 13)) if r2[i, j] > 0.2} and (50, 59) in got and (2, 40) not in got


def test_stage_masks_without_qc(spark):
    m = spark.createDataFrame([(1, "v")], "marker long, variant_id string")
    assert [tuple(r) for r in markers.without_qc(m).collect()] == [(1, "v", "", True)]
    qc = spark.createDataFrame([("v", False, True)], "variant_id string, call_rate_pass boolean, qc_pass boolean")
    assert markers.qc_reasons(m, qc, ["call_rate_pass"], "qc_pass").first()["passes"] and not markers.qc_reasons(m, qc, ["call_rate_pass"]).first()["passes"]
    assert linear.rows_of(spark.createDataFrame([(1, 0, 2.0)], "marker long, sample long, value double"), 1).first()["x"] == [2.0]
