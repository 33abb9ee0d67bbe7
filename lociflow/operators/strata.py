"""Association outside the autosomes, and what comes before any scan: covariates, samples and marker exclusions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import matrix, sliced
from .scans import SCHEMA, Kernel, lmm_kernel, ols_kernel, ols_scan

# fixed values: name, contig, samples (by sex) and whether the sex is a covariate of each scan
MODES = """
x_with_sex_covariate X all yes
x_male_only X male no
x_female_only X female no
y_male_only Y male no
mt_with_sex_covariate M all yes
mt_male_only M male no
mt_female_only M female no"""
CONTIGS = {"X": ("chrX", "X"), "Y": ("chrY", "Y"), "M": ("chrM", "chrMT", "M", "MT")}
LEAST_SAMPLES = 3


def varying(covariates: np.ndarray | None) -> np.ndarray:
    """The numbers of the columns whose finite values are not all the same."""
    if covariates is None:
        return np.zeros(0, int)
    known = np.isfinite(covariates)
    return np.array([c for c in range(covariates.shape[1]) if known[:, c].any() and np.std(covariates[known[:, c], c]) > 0], int)


def analysed(phenotypes: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Samples with a phenotype that are among the chosen ones (a column sample), by default all."""
    ok = phenotypes.where("phenotype is not null and not isnan(phenotype)")
    return ok if chosen is None else ok.join(chosen.select("sample").distinct(), "sample", "left_semi")


JUDGED = f"mode string, reason string, method string, {SCHEMA}"


def sex_scan_rows(rows: DataFrame, sexes: np.ndarray, y: np.ndarray, covariates: np.ndarray | None = None, relationships: dict[str, np.ndarray] | None = None, modes: list[str] | None = None, monomorphic: bool = True) -> DataFrame:
    """Every marker of every mode in one pass over rows (marker, chrom, x): mode, reason, method and the result.

    With ``monomorphic`` a marker whose values are all the same, or all missing, in a
    mode's samples is not tested there: its reason is monomorphic_lrr and its result
    null.  See ``sex_scans`` for the rest.
    """
    plans: dict[str, list[tuple[str, str, np.ndarray, Callable[[], Kernel]]]] = {c: [] for c in CONTIGS}
    for name, contig, who, with_sex in (line.split() for line in MODES.split("\n") if line):
        keep = np.flatnonzero({"all": np.ones(len(sexes), bool), "male": sexes == 1, "female": sexes == 2}[who])
        if modes is not None and name not in modes or len(keep) < LEAST_SAMPLES:
            continue
        extra = [] if covariates is None else [covariates[keep]]
        extra += [(sexes[keep] == 1).astype(float)[:, None]] if with_sex == "yes" else []
        design = np.hstack(extra) if extra else None
        used = varying(design)
        design, k = design[:, used] if len(used) else None, (relationships or {}).get(contig)
        if k is None:
            plans[contig].append((name, "ols", keep, lambda keep=keep, design=design: ols_kernel(y[keep], design)))
        else:  # decomposed here, once
            kernel = lmm_kernel(y[keep], k[np.ix_(keep, keep)], design)
            plans[contig].append((name, "lmm", keep, lambda kernel=kernel: kernel))
    widest = len(sexes) + max((1 + (0 if covariates is None else covariates.shape[1]) + 1) ** 2, 1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kernels = {name: make() for own in plans.values() for name, _, _, make in own}
        for pdf in sliced(batches, widest):
            for contig, own in plans.items():
                mine = pdf[pdf["chrom"].isin(CONTIGS[contig])]
                if not len(mine) or not own:
                    continue
                x = matrix(mine["x"])
                for name, method, keep, _ in own:
                    part = x[:, keep]
                    low, high = np.where(np.isnan(part), np.inf, part).min(axis=1), np.where(np.isnan(part), -np.inf, part).max(axis=1)
                    out = (low >= high) & monomorphic
                    result = kernels[name](mine["marker"][~out], part[~out]) if (~out).any() else pd.DataFrame({"marker": []})
                    yield result.assign(mode=name, reason=None, method=method)[KEPT] if len(result) else pd.DataFrame(columns=KEPT)
                    if out.any():
                        gone = pd.DataFrame({c: [None] * int(out.sum()) for c in KEPT})
                        yield gone.assign(mode=name, reason="monomorphic_lrr", method=method, marker=mine["marker"][out].to_numpy())

    wanted = [c for contig, own in plans.items() if own for c in CONTIGS[contig]]
    return rows.where(F.col("chrom").isin(wanted) if wanted else F.lit(False)).select("marker", "chrom", "x").mapInPandas(scan, JUDGED)


KEPT = [c.split(" ")[0] for c in JUDGED.split(", ")]


def sex_scans(rows: DataFrame, sexes: np.ndarray, y: np.ndarray, covariates: np.ndarray | None = None, relationships: dict[str, np.ndarray] | None = None, modes: list[str] | None = None, monomorphic: bool = False) -> DataFrame:
    """The scans of X, Y and M by sex: mode, marker, beta, se, stat, p_value, n_samples and method.

    rows: (marker, chrom, x), read once for all modes.
    sexes: 1 male, 2 female, anything else unknown; an unknown sex counts as female
    in the sex covariate and is in no scan of one sex.  relationships holds n x n
    matrices for X, Y and M; a contig with one gets the mixed model on the block of
    the mode's samples, the others least squares.  Covariates that do not vary in a
    mode's samples are dropped there.  A mode with fewer than three samples is left
    out, one without markers has no rows.
    """
    found = sex_scan_rows(rows, sexes, y, covariates, relationships, modes, monomorphic)
    return found.where("reason is null").select("mode", *[c.split(" ")[0] for c in SCHEMA.split(", ")], "method")


def mode_exclusions(judged: DataFrame) -> DataFrame:
    """Markers in all, tested and excluded of each mode of ``sex_scan_rows``."""
    return judged.groupBy("mode").agg(F.count("*").alias("n_markers"), F.count_if(F.col("reason").isNull()).alias("n_tested"), F.count("reason").alias("n_monomorphic"))


def marker_exclusions(markers: DataFrame, intensity_only: bool = True, monomorphic: bool = True) -> DataFrame:
    """reasons (;-joined) and tested of markers (marker, intensity_only, monomorphic), by the rules that are on."""
    rules = [("intensity_only", intensity_only, "intensity_only"), ("monomorphic", monomorphic, "monomorphic_lrr")]
    found = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit(False)), F.lit(name)) for c, on, name in rules if on])) if intensity_only or monomorphic else F.array().cast("array<string>")
    return markers.withColumn("reasons", F.array_join(found, ";")).withColumn("tested", F.col("reasons") == "")


def with_exclusions(rows: DataFrame) -> DataFrame:
    """rows (marker, x, ...) with monomorphic: all values the same, or none."""
    return rows.withColumn("monomorphic", F.coalesce(F.array_min("x") == F.array_max("x"), F.lit(True)))


def excluded_scan(rows: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, intensity_only: bool = True, monomorphic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Least squares of the markers that no rule excludes, and every marker with its reasons; rows: (marker, intensity_only, x)."""
    judged = marker_exclusions(with_exclusions(rows), intensity_only, monomorphic)
    used = varying(covariates)
    scan = ols_scan(judged.where("tested"), y, covariates[:, used] if len(used) else None)
    return scan, judged.select("marker", "intensity_only", "monomorphic", "reasons", "tested")


def exclusion_info(judged: DataFrame) -> DataFrame:
    """Markers in all, tested and excluded, and how many each rule excludes."""
    has = lambda name: F.count_if(F.array_contains(F.split("reasons", ";"), name))
    return judged.agg(F.count("*").alias("n_markers"), F.count_if("tested").alias("n_tested"), F.count_if(~F.col("tested")).alias("n_excluded"), has("intensity_only").alias("n_intensity_only"), has("monomorphic_lrr").alias("n_monomorphic"))
