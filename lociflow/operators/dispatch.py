"""Association as one call: arguments checked, markers excluded, a method chosen, and results named in input order."""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scans import SCHEMA, lmm_scan, logistic_scan, low_rank_lmm_scan, ols_scan
from .strata import marker_exclusions, with_exclusions

log = logging.getLogger(__name__)
# fixed values: the shares of cases outside which a mixed model of a binary phenotype is warned of
LEAST_CASES, MOST_CASES = 0.1, 0.9
RESULT = ("chrom", "pos", "variant_id", "beta", "se", "stat", "p_value", "n_samples", "method")


def checked(n_samples: int, y: np.ndarray, covariates: np.ndarray | None, method: str, relationship: np.ndarray | None, vectors: tuple[np.ndarray, np.ndarray, float] | None) -> None:
    """Raise for arguments that do not fit together, and warn of those that fit badly."""
    if y.ndim != 1 or len(y) != n_samples:
        raise ValueError(f"the phenotype has shape {y.shape} for {n_samples} samples")
    if covariates is not None and (covariates.ndim != 2 or len(covariates) != n_samples):
        raise ValueError(f"the covariates have shape {covariates.shape} for {n_samples} samples")
    known = y[~np.isnan(y)]
    binary = len(known) > 0 and bool(np.isin(known, (0.0, 1.0)).all())
    if method == "lmm":
        if relationship is None and vectors is None:
            raise ValueError("the mixed model needs a relationship matrix, or its leading values and vectors")
        if relationship is not None and relationship.shape != (n_samples, n_samples):
            raise ValueError(f"the relationship matrix has shape {relationship.shape} for {n_samples} samples")
        if vectors is not None and vectors[1].shape != (n_samples, len(vectors[0])):
            raise ValueError(f"the vectors have shape {vectors[1].shape} for {n_samples} samples and {len(vectors[0])} values")
        share = float(known.mean()) if binary else 0.5
        if share < LEAST_CASES or share > MOST_CASES:
            log.warning("a mixed model of a binary phenotype with a share of cases of %.3f (%d of %d) can find too much, the more so at low frequencies; think of logistic regression of unrelated samples", share, round(share * len(known)), len(known))
    elif method == "logistic":
        if not binary or len(np.unique(known)) < 2:
            raise ValueError(f"logistic regression needs a phenotype of 0 and 1, not {np.unique(known)[:5].tolist()}")
        if relationship is not None or vectors is not None:
            log.warning("logistic regression does not use the relationship matrix")
    elif method != "ols":
        raise ValueError(f"no method {method!r}: ols, logistic or lmm")


def associate(rows: DataFrame, y: np.ndarray, covariates: np.ndarray | None = None, method: str = "lmm", relationship: np.ndarray | None = None, vectors: tuple[np.ndarray, np.ndarray, float] | None = None, intensity_only: bool = True, monomorphic: bool = True) -> tuple[DataFrame, DataFrame]:
    """Association of y with each marker of rows (marker, chrom, pos, variant_id, intensity_only, x), and every marker with its exclusion reasons.

    ``marker`` is the number of the record in its file; the result keeps it, so that
    ordering by it gives the input order.  A record without an id is chrom:pos.
    relationship is n x n; vectors are its leading eigenvalues, their vectors (n x k)
    and its trace, which no task needs n x n for.  Rows are streamed: nothing but the
    small join of results with names shuffles.
    """
    first = rows.select(F.size("x").alias("n")).first()
    checked(len(y) if first is None else first["n"], y, covariates, method, relationship, vectors)
    named = rows.withColumn("variant_id", F.coalesce(F.nullif("variant_id", F.lit(".")), F.concat_ws(":", "chrom", "pos")))
    judged = marker_exclusions(with_exclusions(named), intensity_only, monomorphic)
    going = judged.where("tested")
    if method == "ols":
        scan = ols_scan(going, y, covariates)
    elif method == "logistic":
        scan = logistic_scan(going, y, covariates)
    elif vectors is not None:
        scan = low_rank_lmm_scan(going, y, *vectors, covariates)
    else:
        scan = lmm_scan(going, y, relationship, covariates)
    names = going.select("marker", "chrom", "pos", "variant_id")
    results = scan.select(*[c.split(" ")[0] for c in SCHEMA.split(", ")]).join(names, "marker").withColumn("method", F.lit(method))
    return results.select("marker", *RESULT), judged.select("marker", "chrom", "pos", "variant_id", "intensity_only", "monomorphic", "reasons", "tested")


def required(samples: DataFrame, known: DataFrame, key: str = "sample", what: str = "the genotypes") -> DataFrame:
    """samples, when each is in known by key; otherwise the job that reads them fails and names how many and the first five that are not.

    The check is part of the plan: it runs in the same job, not in one before.
    """
    missing = samples.join(known.select(key), key, "left_anti")
    n = missing.agg(F.count("*").alias("n")).scalar()
    first = missing.select(F.col(key).cast("string").alias("k")).distinct().orderBy("k").limit(5).agg(F.array_join(F.array_sort(F.collect_list("k")), ", ").alias("f")).scalar()
    said = F.concat(n.cast("string"), F.lit(f" samples are not in {what}, first: "), first)
    return samples.where(F.assert_true(n == 0, said).isNull())
