"""Scans against plain least squares and likelihoods, and readers on small files."""

import math

import numpy as np
import pytest

from lociflow.operators import markers, scans
from lociflow.sources import readers

ROWS = "marker long, x array<double>"


def frame(spark, x):
    return spark.createDataFrame([(i, [None if math.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], ROWS)


def by_marker(df):
    return {r["marker"]: r for r in df.collect()}


@pytest.mark.parametrize(("t", "df", "p"), [(0.0, 5, 1.0), (2.0, 10, 0.07338803), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (math.inf, 3, 0.0)])
def test_t_tail(t, df, p):
    assert scans.t_two_sided(np.array([t]), df)[0] == pytest.approx(p, abs=1e-6)


def plain_ols(x, y, c):
    s = np.isfinite(x)
    d = np.column_stack([np.ones(s.sum()), c[s], x[s]])
    b, *_ = np.linalg.lstsq(d, y[s], rcond=None)
    r = y[s] - d @ b
    return b[-1], math.sqrt(r @ r / (s.sum() - d.shape[1]) * np.linalg.inv(d.T @ d)[-1, -1])


def test_ols_with_covariates_and_missing_values(spark):
    rng = np.random.default_rng(99)
    x, c = rng.normal(size=(6, 80)), rng.normal(size=(80, 2))
    y = 2 * x[0] + c[:, 0] + rng.normal(0, 0.1, 80)
    x[1, :20], x[2], x[3] = np.nan, 1.0, np.nan
    out = by_marker(scans.ols_scan(frame(spark, x), y, c))
    for m in (0, 1, 4, 5):
        assert (out[m]["beta"], out[m]["se"]) == pytest.approx(plain_ols(x[m], y, c))
    assert out[0]["p_value"] < 1e-30 and out[1]["n_samples"] == 60
    for m in (2, 3):
        assert (out[m]["beta"], out[m]["se"], out[m]["stat"], out[m]["p_value"]) == (0.0, math.inf, 0.0, 1.0)


def test_mixed_model_of_unrelated_samples_is_least_squares(spark):
    rng = np.random.default_rng(5)
    x, y, c = rng.normal(size=(4, 50)), rng.normal(size=50), rng.normal(size=(50, 1))
    out = by_marker(scans.lmm_scan(frame(spark, x), y, np.eye(50), c))
    for m in range(4):
        assert (out[m]["beta"], out[m]["se"]) == pytest.approx(plain_ols(x[m], y, c))


def test_mixed_model_weights(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(40, 30))
    k, x, y = z @ z.T / 30, rng.normal(size=(1, 40)), rng.normal(size=40) + z[:, 0]
    value, vector = np.linalg.eigh(k)
    delta = scans.reml_delta(np.maximum(value, 0), vector.T @ y, vector.T @ np.ones((40, 1)))
    v, d = np.linalg.inv(k + delta * np.eye(40)), np.column_stack([np.ones(40), x[0]])
    want = np.linalg.solve(d.T @ v @ d, d.T @ v @ y)[1]
    assert by_marker(scans.lmm_scan(frame(spark, x), y, k))[0]["beta"] == pytest.approx(want)


def test_logistic_score_is_zero_at_the_fit(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 200))
    y = (rng.random(200) < 1 / (1 + np.exp(-x[0]))).astype(float)
    x[1, :50], x[2] = np.nan, y  # marker 2 separates the cases: no finite fit
    out = by_marker(scans.logistic_scan(frame(spark, x), y))
    for m in (0, 1):
        s = np.isfinite(x[m])
        b = out[m]["beta"]
        a = 0.0
        for _ in range(100):  # the best intercept for that slope
            mu = 1 / (1 + np.exp(-(a + b * x[m][s])))
            a += (y[s] - mu).sum() / (mu * (1 - mu)).sum()
        assert abs(((y[s] - mu) * x[m][s]).sum()) < 1e-4
    assert out[0]["p_value"] < 1e-4
    assert (out[2]["beta"], out[2]["p_value"]) == (0.0, 1.0)


def test_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(
        "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\n"
        "chr1\t100\trs1\tA\tG\t.\t.\tINTENSITY_ONLY;AC=1\tGT:LRR\t0/1:0.5\t./.:nan\t1|1:-inf\n"
        "chr2\t7\t.\tC\t.\t.\t.\t.\tLRR\t1e-2\t.\t-0.25\n"
        "chr2\t9\t.\tC\tA,T\t.\t.\t.\tGT\t1/2\t0\t0/2\n"
    )
    path = str(tmp_path / "a.vcf")
    assert readers.vcf_samples(spark, path) == ["S1", "S2", "S3"]
    a, b, c = readers.vcf(spark, path).orderBy("chrom", "pos").collect()
    assert (a["variant_id"], a["intensity_only"], list(a["lrr"]), list(a["dosage"])) == ("rs1", True, [0.5, None, None], [1.0, None, 2.0])
    assert (b["variant_id"], list(b["alts"]), b["intensity_only"], list(b["lrr"])) == ("chr2:7:C:", [], False, [0.01, None, -0.25])
    assert (c["variant_id"], list(c["dosage"]), list(c["lrr"])) == ("chr2:9:C:A:T", [3.0, None, 2.0], [None, None, None])


def test_tables(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("sample_id\tbmi\tage\nA\t1.5\t40\nB\tNA\tx\n")
    assert [tuple(r) for r in readers.phenotypes(spark, str(tmp_path / "p.tsv")).orderBy("sample_id").collect()] == [("A", 1.5, 40.0), ("B", None, None)]
    (tmp_path / "q.tsv").write_text("# note\nvariant_id\tall_ancestries_call_rate_pass\tall_ancestries_hwe_pass\tall_ancestries_maf_pass\nrs1\tTrue\t1\tyes\nrs1\tTrue\t0\tyes\n")
    assert [tuple(r) for r in readers.variant_qc(spark, str(tmp_path / "q.tsv")).collect()] == [("rs1", True, True, True, None, None, None)]
    (tmp_path / "ids.txt").write_text("sample_id\tz\nA\t1\n\nB\n")
    assert sorted(r[0] for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["A", "B"]
    (tmp_path / "r.tsv").write_text("\t".join("chrom pos variant_id beta se stat p_value n_samples method".split()) + "\nchr1\t5\tv\tbad\t1\t2\t0.5\t9\tols\nchr1\tx\tw\t1\t1\t1\t1\t9\tols\n")
    assert [(r["pos"], r["beta"], r["p"]) for r in readers.association_records(spark, str(tmp_path / "r.tsv")).collect()] == [(5, None, 0.5)]


def test_gene_tracks(spark, tmp_path):
    line = ["0", "N1", "chr1", "+", "99", "200", "0", "0", "1", "a", "b", "0", "GENEA", "x", "y", "z"]
    (tmp_path / "g.txt").write_text("\t".join(line) + "\nshort\n")
    assert [tuple(r) for r in readers.refgene(spark, str(tmp_path / "g.txt")).collect()] == [("chr1", "GENEA", 100, 200, "+")]
    (tmp_path / "g.gtf").write_text('chr1\ts\ttranscript\t5\t9\t.\t-\t.\tgene_id "E1"; transcript_id "T";\nchr1\ts\texon\t5\t9\t.\t-\t.\tgene_id "E1";\n')
    assert [tuple(r) for r in readers.gtf(spark, str(tmp_path / "g.gtf")).collect()] == [("chr1", "E1", 5, 9, "-")]


def test_ld_prune_is_the_greedy_walk(spark, tmp_path):
    rng = np.random.default_rng(1)
    pairs = sorted({(int(a), int(a + g)) for a, g in zip(rng.integers(0, 60, 90), rng.integers(1, 6, 90), strict=True)})
    kept = []
    for m in range(66):
        if not any((k, m) in pairs for k in kept):
            kept.append(m)
    df = spark.createDataFrame([(m,) for m in range(66)], "marker long")
    out = markers.ld_pruned(df, spark.createDataFrame(pairs, "a long, b long"))
    assert sorted(r["marker"] for r in out.collect()) == kept
    none = markers.ld_pruned(df, spark.createDataFrame([], "a long, b long"))
    assert none.count() == 66


def test_ld_prune_of_contigs_and_stretches(spark):
    rng = np.random.default_rng(6)
    chrom, pos = rng.integers(0, 3, 150), rng.permutation(2000)[:150]
    order = sorted(range(150), key=lambda m: (chrom[m], pos[m]))
    pairs = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if chrom[a] == chrom[b] and pos[b] - pos[a] < 60 and rng.random() < 0.5}
    kept = []
    for m in order:
        if not any((k, m) in pairs for k in kept):
            kept.append(m)
    df = spark.createDataFrame([(m, f"chr{chrom[m]}", int(pos[m])) for m in range(150)], "marker long, chrom string, pos long")
    out = markers.ld_pruned(df, spark.createDataFrame(sorted(pairs), "a long, b long").repartition(5))
    assert sorted(r["marker"] for r in out.collect()) == sorted(kept) and len(kept) < 150
