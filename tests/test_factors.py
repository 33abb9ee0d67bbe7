"""Distributed factors, tiles and the correction call against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociflow.operators import correction, factors, linear, scans
from lociflow.sources import bcf, writers

N, M = 60, 300


def values(seed=0, missing=0.05):
    rng = np.random.default_rng(seed)
    batch = rng.normal(size=(M, 3)) @ (np.array([3.0, 2.0, 1.0])[:, None] * np.linalg.qr(rng.normal(size=(N, 3)))[0].T) * 0.5
    x = 0.1 * rng.normal(size=(M, N)) + batch + rng.normal(size=(M, 1))
    x[rng.random((M, N)) < missing] = np.nan
    return x


def frame(spark, x, **columns):
    rows = [(i, *[c[i] for c in columns.values()], [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    kinds = "".join(f"{k} {'string' if isinstance(v[0], str) else 'long'}, " for k, v in columns.items())
    return spark.createDataFrame(rows, f"marker long, {kinds}x array<double>").repartition(7)


def centred(x):
    return np.where(np.isnan(x), 0, x - np.nanmean(x, axis=1, keepdims=True))


def collected(df, column="x"):
    return np.array([[np.nan if v is None else v for v in r[column]] for r in df.orderBy("marker").collect()])


def test_randomised_factors_equal_those_of_the_gram_matrix(spark):
    x = values()
    rows = frame(spark, x)
    u, s, v = np.linalg.svd(centred(x), full_matrices=False)
    for backend in ("rsvd", "gram", lambda r, n, k, c: factors.randomised(r, n, k, c, rounds=80)):
        found = factors.decompose(rows, N, 4, backend=backend)
        assert found.n_markers == M and np.allclose(found.singular, s[:4], rtol=1e-9)
        # the angle between the subspaces of the three strong components
        assert np.linalg.norm(found.right[:3] - found.right[:3] @ v[:3].T @ v[:3]) < 1e-6
    loadings = factors.left(rows, found)
    rest = collected(factors.residualised(rows, loadings, found))
    expected = x - u[:, :4] * s[:4] @ v[:4]
    assert np.allclose(np.nan_to_num(rest, nan=9), np.nan_to_num(expected, nan=9), atol=1e-6)
    some = factors.residualised(rows, loadings.where("marker < 10"), found)
    assert np.allclose(np.nan_to_num(collected(some)[10:]), np.nan_to_num(x[10:]))


def test_factors_of_some_samples_and_of_a_matrix_of_low_rank(spark):
    x = values(1, 0.0)
    keep = np.flatnonzero(np.arange(N) % 3 != 0)
    found = factors.decompose(frame(spark, x), N, 3, keep)
    assert np.allclose(found.singular, np.linalg.svd(centred(x[:, keep]))[1][:3], rtol=1e-9) and found.right.shape == (3, len(keep))
    flat = np.outer(np.arange(1.0, 9), np.sin(np.arange(N)))
    found = factors.decompose(frame(spark, flat), N, 3)
    assert found.singular[1] < 1e-8 * found.singular[0]
    assert np.allclose(collected(factors.residualised(frame(spark, flat), factors.left(frame(spark, flat), found), found)), flat.mean(axis=1, keepdims=True))


def test_the_tree_of_triangles(spark):
    x = np.random.default_rng(2).normal(size=(900, 6))
    parts = spark.createDataFrame([(x[i : i + 9].tobytes(),) for i in range(0, 900, 9)], "block binary").repartition(100)
    r = factors.triangle(parts, 6)
    assert np.allclose(r.T @ r, x.T @ x)
    assert factors.triangle(parts.where("false"), 6).shape == (0, 6)


def test_refused_arguments(spark):
    rows = frame(spark, values())
    for k, backend, said in ((0, "rsvd", "at least 1"), (N + 1, "rsvd", "number of samples"), (2, "other", "no backend")):
        with pytest.raises(ValueError, match=said):
            factors.decompose(rows, N, k, backend=backend)
    with pytest.raises(ValueError, match="number of markers"):
        factors.decompose(rows.where("marker < 2"), N, 5)


def dosages(seed=3, missing=0.04):
    rng = np.random.default_rng(seed)
    g = rng.binomial(2, rng.uniform(0, 0.5, (M, 1)), (M, N)).astype(float)
    g[:, 1] = g[:, 0]  # two samples alike
    g[rng.random((M, N)) < missing] = np.nan
    return g


def test_tiles_equal_the_matrix_and_its_eigenvectors(spark, tmp_path):
    g = dosages()
    rows = frame(spark, g)
    exact, m = linear.gram(rows, N, "relationship", 0.02)
    exact /= m
    for tile in (16, 60, 100):
        tiles, n_tiles = factors.relationship_tiles(rows, N, 0.02, tile)
        tiles, found = factors.with_markers(tiles, f"{tmp_path}/{tile}")
        assert found == m and tiles.count() == n_tiles * (n_tiles + 1) // 2
        assert max(len(r["block"]) for r in tiles.collect()) <= tile * tile * 8
        product = factors.tiled_product(tiles, N, m, tile)
        assert np.allclose(product(np.eye(N)[:, :20]), exact[:, :20])
        assert np.allclose([r["diagonal"] for r in factors.diagonal(tiles, m, tile).orderBy("sample").collect()], np.diag(exact))
    value, vector = factors.leading(lambda v: exact @ v, N, 5)
    wanted = np.linalg.eigvalsh(exact)[::-1]
    assert np.allclose(value, wanted[:5]) and np.allclose(exact @ vector, vector * value, atol=1e-7)
    every, vectors = factors.leading(product, N, N, block=20)
    assert np.allclose(every, wanted, atol=1e-9) and np.allclose(vectors.T @ vectors, np.eye(N), atol=1e-9)
    with pytest.raises(ValueError, match="no marker"):
        factors.with_markers(factors.relationship_tiles(frame(spark, np.zeros((5, N))), N)[0], f"{tmp_path}/none")


def test_mixed_model_of_leading_vectors(spark):
    rng = np.random.default_rng(7)
    g, x = dosages(), values(8)
    k, m = linear.gram(frame(spark, g), N, "relationship", 0.02)
    k /= m
    y, c = rng.normal(size=N) + k @ rng.normal(size=N), rng.normal(size=(N, 2))
    rows = frame(spark, x)
    value, vector = np.linalg.eigh(k)
    exact = scans.lmm_scan(rows, y, k, c).toPandas().sort_values("marker")
    whole = scans.low_rank_lmm_scan(rows, y, np.maximum(value, 0), vector, np.maximum(value, 0).sum(), c).toPandas().sort_values("marker")
    for column in ("beta", "se", "stat", "p_value"):
        assert np.allclose(exact[column], whole[column], rtol=1e-4, atol=1e-6), column
    # eigenvalues that are all alike beyond the leading ones lose nothing
    lead = np.argsort(-value)[:4]
    alike = vector[:, lead] @ np.diag(value[lead] - 0.3) @ vector[:, lead].T + 0.3 * np.eye(N)
    exact = scans.lmm_scan(rows, y, alike, c).toPandas().sort_values("marker")
    few = scans.low_rank_lmm_scan(rows, y, value[lead], vector[:, lead], np.trace(alike), c).toPandas().sort_values("marker")
    assert np.allclose(exact["beta"], few["beta"], rtol=1e-4) and np.allclose(exact["p_value"], few["p_value"], rtol=1e-3)


def test_correction_as_one_call(spark, tmp_path):
    x = values(4, 0.01)
    x[:, 5] += 3 * np.random.default_rng(1).normal(size=M)  # a noisy sample
    x[200, :] = 0.25  # no variance
    x[201, : N // 2] = np.nan
    x[202, 4:] = np.nan
    chrom = ["chrX" if i % 10 == 0 else "chr1" for i in range(M)]
    rows = frame(spark, x, chrom=chrom, pos=list(range(0, M * 100, 100)))
    regions = spark.createDataFrame([("chr1", 1000, 2000)], "chrom string, start long, end long")
    upstream = spark.range(5, M).select(F.col("id").alias("marker"))
    limits = correction.Thresholds(most_lrr_sd=2.5, least_sample_call_rate=0.9, least_marker_call_rate=0.9)
    out, told = correction.correct_lrr(rows, N, 3, None, limits, regions, upstream)
    auto = np.array([c == "chr1" for c in chrom])
    known = (np.nanstd(x[auto], axis=0) <= 2.5) & (np.isfinite(x[auto]).mean(axis=0) >= 0.9)
    assert not known[5] and known.sum() == told["n_hq_samples"] and (known == told["hq_sample_mask"]).all()
    place = np.arange(M) * 100
    passing = auto & (np.isfinite(x).mean(axis=1) >= 0.9) & (np.nan_to_num(np.nanvar(x, axis=1)) >= 0.001) & ~((place >= 1000) & (place <= 2000)) & (np.arange(M) >= 5)
    assert told["n_markers_used"] == passing.sum() and sorted(r["marker"] for r in told["marker_mask"].where("passes").collect()) == np.flatnonzero(passing).tolist()
    sub = x[passing]
    mean = np.nanmean(sub[:, known], axis=1, keepdims=True)
    u, s, v = np.linalg.svd(np.where(np.isnan(sub), 0, sub - mean)[:, known], full_matrices=False)
    assert np.allclose(told["singular_values"], s[:3])
    scores = np.zeros((3, N))
    scores[:, known] = v[:3]
    scores[:, ~known] = (u[:, :3] / s[:3]).T @ np.where(np.isnan(sub), 0, sub - mean)[:, ~known]
    fixed = collected(out)
    for i in (0, 17, 150, 201, 202):
        seen = np.isfinite(x[i])
        expected = x[i].copy()
        if seen.sum() >= max(4, N / 2):
            expected[seen] -= scores[:, seen].T @ np.linalg.lstsq(scores[:, seen].T, x[i, seen], rcond=None)[0]
        assert np.allclose(np.nan_to_num(fixed[i]), np.nan_to_num(expected), atol=1e-6), i
    assert told["k"] == told["n_components_computed"] == 3 and told["backend"] == "rsvd" and not told["rsvd_subsampled"] and told["rsvd_marker_budget"] is None
    writers.markers_used(told["marker_mask"], rows.selectExpr("marker", "concat('m', marker) as variant_id", "chrom", "pos"), f"{tmp_path}/used", 3)
    lines = [line for f in sorted(tmp_path.glob("used/part-*")) for line in f.read_text().splitlines()]
    assert lines == ["variant_id\tchrom\tpos", *(f"m{i}\tchr1\t{i * 100}" for i in np.flatnonzero(passing))]
    assert told["marker_loadings"].count() == passing.sum() and told["sample_scores"].shape == (3, N) and len(told) == 12
    none, few = correction.correct_lrr(rows, N, None, None, correction.Thresholds(2.5, 0.9, 0.9, budget=50), residualise=False)
    assert none is None and few["rsvd_subsampled"] and few["n_markers_used"] <= 50 and few["n_components_computed"] == 3 and few["k"] >= 1
    for limits, k, said in ((correction.Thresholds(0.0), 3, "good quality"), (correction.Thresholds(9, 0, least_variance=1e9), 3, "no marker"), (correction.Thresholds(9, 0.5, 0.5), 500, "more than")):
        with pytest.raises(ValueError, match=said):
            correction.correct_lrr(rows, N, k, None, limits)


def test_corrected_records_are_measured_as_they_are_written(spark, tmp_path):
    x = values(6)
    x[7, 3:] = np.nan
    names = [f"s{i}" for i in range(N)]
    rows = frame(spark, x, chrom=["chr1"] * M, pos=list(range(1, M + 1))).selectExpr("chrom", "pos", "concat('m', marker) variant_id", "'A' ref", "array('C') alts", "x as lrr")
    bcf.write(rows, f"{tmp_path}/in.bcf", ["chr1"], names)
    scores = np.linalg.qr(np.random.default_rng(0).normal(size=(N, 2)))[0].T
    chosen = spark.range(0, M, 3).selectExpr("concat('m', id) variant_id")
    records = bcf.bcf(spark, f"{tmp_path}/in.bcf", split_bytes=9_000)
    metrics, counts = correction.correct_and_write(records, scores, f"{tmp_path}/out.bcf", ["chr1"], names, chosen, "k=2")
    assert counts == {"n_markers": M, "n_uncorrected": 1, "n_diagnostic": 100}
    back = bcf.bcf(spark, f"{tmp_path}/out.bcf").orderBy("pos").toPandas()
    assert back["pos"].tolist() == list(range(1, M + 1)) and "##correction=k=2" in bcf.header_text(["chr1"], names, "lociflow", "k=2")
    y = np.array([[np.nan if v is None else v for v in r] for r in back["lrr"]])
    single = x.astype(np.float32).astype(float)
    assert np.allclose(np.nan_to_num(y[7]), np.nan_to_num(single[7])) and (np.isnan(y) == np.isnan(x)).all()
    seen = np.isfinite(x[12])
    assert np.allclose(y[12, seen], single[12, seen] - scores[:, seen].T @ np.linalg.lstsq(scores[:, seen].T, single[12, seen], rcond=None)[0], atol=1e-6)
    got = metrics.toPandas().set_index("SAMPLE").loc[names]
    assert np.allclose(got["LRR_SD"], np.nanstd(y[::3], axis=0)) and np.allclose(got["callrate"], np.isfinite(y[::3]).mean(axis=0)) and set(got["n_markers_used"]) == {100}
    every, counts = correction.correct_and_write(records, scores, f"{tmp_path}/all.bcf", ["chr1"], names)
    assert counts["n_diagnostic"] == M and every.count() == N


def test_relationship_files_are_read_by_bands(spark, tmp_path):
    from lociflow.sources import relationship

    g = dosages()
    tiles, _ = factors.relationship_tiles(frame(spark, g), N, 0.02, 16)
    tiles, m = factors.with_markers(tiles, f"{tmp_path}/tiles")
    exact = factors.tiled_product(tiles, N, m, 16)(np.eye(N))
    relationship.write(tiles, N, m, f"{tmp_path}/grm", [f"s{i}" for i in range(N)], 16)
    flat = np.concatenate([exact[i, : i + 1] for i in range(N)]).astype("<f4")
    (tmp_path / "one.grm.bin").write_bytes(flat.tobytes())
    for path, tile in ((f"{tmp_path}/grm", 16), (f"{tmp_path}/grm", 25), (f"{tmp_path}/one.grm.bin", 16), (f"{tmp_path}/one.grm.bin", 100)):
        back, n = relationship.read(spark, path, tile)
        assert n == N and np.allclose(factors.tiled_product(back, N, 1, tile)(np.eye(N)), exact, atol=1e-6)
    assert [tuple(r) for r in relationship.sample_ids(spark, f"{tmp_path}/grm/samples.id").orderBy("number").collect()] == [(i, f"s{i}") for i in range(N)]
    (tmp_path / "bad").write_bytes(b"\0" * 8)
    with pytest.raises(ValueError, match="no lower triangle"):
        relationship.read(spark, f"{tmp_path}/bad")
