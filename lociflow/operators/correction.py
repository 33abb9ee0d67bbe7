"""Removal of low-rank batch effects, and the relationship matrix of chromosome X.

Both go over rows (marker, x) in place; what meets on the driver is at most
samples x samples, or samples x components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import autosomal
from ..sources import bcf
from . import profiles
from .factors import Backend, decompose, left
from .linear import BLOCKS, block_sums, corrected_columns, gram, matrix, residuals, rows_of, select_k, singular_values, sliced
from .markers import every_nth, outside_regions, stage_masks

# fixed values: how near to one copy a male call is, and the largest that one copy can be
ONE_COPY, MOST_COPIES = 0.05, 1.05


def elbow(singular: np.ndarray) -> int:
    """Components up to the sharpest bend of the singular values; 1 for fewer than three of them."""
    return 1 if len(singular) < 3 else int(np.argmax(np.diff(singular, 2))) + 1


def projected(rows: DataFrame, known: np.ndarray, singular: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Components (k x others) of the samples that known (booleans) leaves out.

    singular and vectors (k x known) are of the row-centred matrix of the known
    samples.  The others are centred by the means of the known, missing values are 0.
    """
    k, n = len(singular), int((~known).sum())

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, m = np.zeros((k, n)), 0
        for pdf in sliced(batches, len(known)):
            x = matrix(pdf["x"])
            seen = np.isfinite(x)
            count = np.maximum(seen[:, known].sum(axis=1, keepdims=True), 1)
            x = np.where(seen, x - np.where(seen, x, 0)[:, known].sum(axis=1, keepdims=True) / count, 0)
            total += (x[:, known] @ vectors.T).T @ x[:, ~known]
            m += len(x)
        if m:
            yield pd.DataFrame({"i": np.arange(k), "block": [r.tobytes() for r in total], "m": m})

    out = np.zeros((k, n))
    for i, block, _ in block_sums(rows.select("x").mapInPandas(partial, BLOCKS)):
        out[i] = block
    square = singular[:, None] ** 2
    return np.divide(out, square, out=np.zeros_like(out), where=square > 0)


def corrected(rows: DataFrame, learn_from: DataFrame, known: np.ndarray, n_components: int = 10, k: int | None = None) -> tuple[DataFrame, dict]:
    """rows without the components of learn_from, and what was done.

    The singular vectors come from the markers learn_from (a filtered rows) and the
    samples of good quality (known); the other samples are projected on them.  Every
    marker is then regressed on the first k components of all samples; without k,
    those above the noise edge are taken.
    """
    s, v, m = singular_values(learn_from, len(known), n_components, np.flatnonzero(known))
    chosen = min(k or select_k(s, m, int(known.sum())), len(s))
    basis = np.zeros((len(known), chosen))
    basis[known] = v[:chosen].T
    if not known.all():
        basis[~known] = projected(learn_from, known, s[:chosen], v[:chosen]).T
    return residuals(rows, basis), {"k": chosen, "n_markers_used": m, "n_known_samples": int(known.sum()), "singular_values": s, "components": basis}


def sample_sums(rows: DataFrame, n_samples: int) -> tuple[np.ndarray, int]:
    """Number, sum and sum of squares of each sample's values (3 x samples), and the number of markers, in one pass."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, m = np.zeros((3, n_samples)), 0
        for pdf in sliced(batches, n_samples):
            x = matrix(pdf["x"])
            seen = np.isfinite(x)
            x = np.where(seen, x, 0.0)
            total += np.stack([seen.sum(axis=0), x.sum(axis=0), (x * x).sum(axis=0)])
            m += len(x)
        if m:
            yield pd.DataFrame({"i": np.arange(3), "block": [r.tobytes() for r in total], "m": m})

    out, markers = np.zeros((3, n_samples)), 0
    for i, block, markers in block_sums(rows.select("x").mapInPandas(partial, BLOCKS)):  # noqa: B007
        out[i] = block
    return out, markers


def metrics_of(sums: np.ndarray, n_markers: int) -> tuple[np.ndarray, np.ndarray]:
    """Population SD (NaN without values) and call rate of each sample from its sums."""
    n = np.where(sums[0] > 0, sums[0], np.nan)
    return np.sqrt(np.maximum(sums[2] / n - (sums[1] / n) ** 2, 0)), sums[0] / max(n_markers, 1)


def row_stats(rows: DataFrame) -> DataFrame:
    """(marker, call_rate, variance) of each row's values."""

    def stats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = matrix(pdf["x"])
            seen = np.isfinite(x)
            n = np.maximum(seen.sum(axis=1), 1)
            mean = np.where(seen, x, 0).sum(axis=1) / n
            variance = np.where(seen, (x - mean[:, None]) ** 2, 0).sum(axis=1) / n
            yield pd.DataFrame({"marker": pdf["marker"].to_numpy(), "call_rate": seen.mean(axis=1), "variance": np.where(seen.any(axis=1), variance, np.nan)})

    return rows.select("marker", "x").mapInPandas(stats, "marker long, call_rate double, variance double").withColumn("variance", F.nanvl("variance", F.lit(None).cast("double")))


@dataclass
class Thresholds:
    """What samples and markers need to be learnt from; budget is the most markers, 0 for no limit."""

    most_lrr_sd: float = 0.35
    least_sample_call_rate: float = 0.95
    least_marker_call_rate: float = 0.95
    least_variance: float = 0.001
    most_variance: float | None = None
    budget: int = 0


def correct_lrr(rows: DataFrame, n_samples: int, k: int | None = None, n_components: int | None = None, thresholds: Thresholds | None = None, regions: DataFrame | None = None, upstream: DataFrame | None = None, backend: str | Backend = "rsvd", least_share: float = 0.5, residualise: bool = True) -> tuple[DataFrame | None, dict]:
    """rows (marker, chrom, pos, x) without batch components, and what was done.

    Samples of good quality are told by the SD and call rate over the autosomes; markers
    by call rate, variance, autosome, regions and, where ``upstream`` (marker) is given,
    by being in it.  Of more than the budget of markers every n-th is taken.  Without
    k, a twentieth of the good samples (or n_components) are computed and those above
    the noise edge removed.  The other samples are projected, and every marker is
    regressed on the components of all samples; without ``residualise`` there is no
    first result, and ``sample_scores`` serves a later pass.

    The report: k, n_components_computed, singular_values, sample_scores (components x
    samples), marker_loadings (marker, u) and marker_mask (marker and each filter) as
    tables, hq_sample_mask, n_hq_samples, n_markers_used, backend, rsvd_subsampled and
    rsvd_marker_budget.
    """
    t = thresholds or Thresholds()
    sd, rate = metrics_of(*sample_sums(rows.where(autosomal(F.col("chrom"))), n_samples))
    known = (np.nan_to_num(sd, nan=np.inf) <= t.most_lrr_sd) & (rate >= t.least_sample_call_rate)
    if not known.any():
        raise ValueError("no sample is of good quality: relax most_lrr_sd or least_sample_call_rate")
    masks = stage_masks(rows.select("marker", "chrom", "pos"), row_stats(rows), regions, t.least_marker_call_rate, t.least_variance, t.most_variance)
    if upstream is not None:
        masks = masks.join(upstream.select("marker", F.lit(True).alias("upstream_ok")).distinct(), "marker", "left").withColumn("upstream_ok", F.coalesce("upstream_ok", F.lit(False)))
        masks = masks.withColumn("passes", F.col("passes") & F.col("upstream_ok"))
    passing = masks.where("passes").select("marker")
    n_passing = passing.count()
    if not n_passing:
        raise ValueError("no marker passes the filters")
    over = 0 < t.budget < n_passing
    if over:
        passing = every_nth(passing, "marker", n_passing, t.budget)
        masks = masks.join(passing.select("marker", F.lit(True).alias("_taken")), "marker", "left").withColumn("passes", F.coalesce("_taken", F.lit(False))).drop("_taken")
        n_passing = passing.count()
    most = min(n_passing, int(known.sum())) - 1
    if most < 1:
        raise ValueError("too few markers or samples are left for a decomposition")
    if k is not None and k > most:
        raise ValueError(f"k={k} is more than the {most} components there can be")
    if n_components is not None and n_components < 1:
        raise ValueError("n_components must be at least 1")
    computed = k or min(most, n_components or max(1, int(np.ceil(0.05 * known.sum()))))
    learn_from = rows.join(passing, "marker", "left_semi")
    found = decompose(learn_from, n_samples, computed, np.flatnonzero(known), backend)
    chosen = k or min(select_k(found.singular, n_passing, int(known.sum())), computed)
    scores = np.zeros((computed, n_samples))
    scores[:, known] = found.right
    if not known.all():
        scores[:, ~known] = projected(learn_from, known, found.singular, found.right)
    report = {
        "k": chosen, "n_components_computed": computed, "singular_values": found.singular, "sample_scores": scores, "marker_loadings": left(learn_from, found, np.flatnonzero(known)), "marker_mask": masks, "hq_sample_mask": known,
        "n_hq_samples": int(known.sum()), "n_markers_used": n_passing, "backend": backend if isinstance(backend, str) else "custom", "rsvd_subsampled": over, "rsvd_marker_budget": t.budget or None,
    }
    return (residuals(rows, scores[:chosen].T, least_share) if residualise else None), report


def correct_and_write(records: DataFrame, scores: np.ndarray, path: str, contigs: list[str], samples: list[str], diagnostic: DataFrame | None = None, provenance: str = "", least_share: float = 0.5) -> tuple[DataFrame, dict]:
    """Write records (of a BCF source, with lrr) less their fit on scores (components x samples), in their own order, and measure them on the way.

    One pass: the sink adds up each sample's values of the diagnostic markers (variant_id;
    all without them) as it writes, and the counts of markers are observed.  Returns the
    samples' LRR_SD, callrate and n_markers_used of what was written, and the counts.
    """
    seen = Observation("written")
    out = corrected_columns(records, scores.T, "lrr", least_share)
    if diagnostic is not None:
        out = out.join(F.broadcast(diagnostic.select("variant_id", F.lit(True).alias("diagnostic")).distinct()), "variant_id", "left").withColumn("diagnostic", F.coalesce("diagnostic", F.lit(False)))
    else:
        out = out.withColumn("diagnostic", F.lit(True))
    out = out.observe(seen, F.count("*").alias("n_markers"), F.count_if(~F.col("corrected")).alias("n_uncorrected"), F.count_if("diagnostic").alias("n_diagnostic"))
    bcf.save(out.drop("corrected"), path, contigs, samples, "lociflow", provenance, metrics=f"{path}.sample_metrics.tsv")
    metrics = records.sparkSession.read.csv(f"{path}.sample_metrics.tsv", sep="\t", header=True, schema="SAMPLE string, LRR_SD double, callrate double, n_markers_used long")
    return metrics, dict(seen.get)


def x_dosage(dosage: DataFrame, sexes: DataFrame, positions: DataFrame, shared: DataFrame) -> DataFrame:
    """(marker, sample, value) of X outside the shared regions, males on the scale of two copies.

    sexes: (sample, sex) with 1 for males.  Males are doubled where their calls count
    one copy: some are near 1 and none is above.
    """
    own = outside_regions(positions, shared).select("marker")
    calls = dosage.join(own, "marker", "left_semi").join(sexes.select("sample", (F.col("sex") == 1).alias("male")), "sample", "left")
    males = calls.where("male").agg(F.max("value").alias("most"), F.coalesce(F.max(F.abs(F.col("value") - 1) <= ONE_COPY), F.lit(False)).alias("ones")).first()
    double = bool(males["ones"]) and males["most"] <= MOST_COPIES
    value = F.when(F.col("male"), F.col("value") * 2).otherwise(F.col("value")) if double else F.col("value")
    return calls.select("marker", "sample", value.alias("value"))


def x_relationship(dosage: DataFrame, sexes: DataFrame, positions: DataFrame, shared: DataFrame, n_samples: int, least_maf: float = 0.01) -> np.ndarray:
    """The relationship matrix of X, with frequencies over both sexes."""
    k, m = gram(rows_of(x_dosage(dosage, sexes, positions, shared), n_samples), n_samples, "relationship", least_maf)
    if not m:
        raise ValueError("no marker of X is left for the relationship matrix")
    return k / m


def x_relationship_by_sample(rows: DataFrame, male: Column, positions: DataFrame, shared: DataFrame, least_maf: float = 0.01) -> DataFrame:
    """(sample, diagonal, row_sum, row_square) of the same matrix from (sample, x), where samples outnumber markers; positions number the places of x."""
    own = sorted(r["marker"] for r in outside_regions(positions, shared).select("marker").collect())
    x = profiles.x_dosage(rows, male, own, ONE_COPY, MOST_COPIES)
    scale = profiles.standardised(x, len(own), least_maf)
    if not scale.width:
        raise ValueError("no marker of X is left for the relationship matrix")
    return profiles.relationship(x, len(own), least_maf, scale)
