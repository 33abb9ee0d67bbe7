"""Relationship matrices, singular vectors, residuals and regressions over a long matrix (marker, sample, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS, BLOCK_CELLS = 1 << 20, 1 << 15
BLOCKS = "i long, block binary, m long"


def rows_of(lrr: DataFrame, n_samples: int) -> DataFrame:
    """One array of n_samples values a marker, missing ones null.

    The values of a marker are put in their places in one pass, a bounded number of cells at a time.
    """
    found = lrr.groupBy("marker").agg(F.collect_list(F.struct(F.col("sample").cast("long").alias("sample"), F.col("value").cast("double").alias("value"))).alias("e"))
    most = max(1, CELLS // max(1, n_samples))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                entries = batch.column(1)
                row = np.repeat(np.arange(batch.num_rows), np.diff(entries.offsets.to_numpy()))
                flat = entries.flatten()
                sample = flat.field(0).fill_null(-1).to_numpy()
                inside = (sample >= 0) & (sample < n_samples)
                x = np.full((batch.num_rows, n_samples), np.nan)
                x[row[inside], sample[inside]] = flat.field(1).to_numpy(zero_copy_only=False)[inside]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n_samples, pa.int32()), pa.array(x.ravel(), pa.float64(), mask=np.isnan(x.ravel())))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["marker", "x"])

    return found.mapInArrow(placed, "marker long, x array<double>")


def matrix(column: pd.Series) -> np.ndarray:
    """A column of arrays as rows of a matrix, missing values NaN."""
    return np.array([np.array(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 0))


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The blocks of one number added up, one after another."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for pdf in batches:
        for i, block, m in zip(pdf["i"], pdf["block"], pdf["m"], strict=True):
            b = np.frombuffer(block)
            total[i] = total[i] + b if i in total else b
            count[i] = count.get(i, 0) + m
    for i, b in total.items():
        yield pd.DataFrame({"i": [i], "block": [b.tobytes()], "m": [count[i]]})


def block_sums(parts: DataFrame) -> list[tuple[int, np.ndarray, int]]:
    """(i, sum of the blocks, sum of m) for each i of BLOCKS rows."""
    return [(r["i"], np.frombuffer(bytes(r["block"])), r["m"]) for r in parts.repartition("i").mapInPandas(_added, BLOCKS).collect()]


def gram(rows: DataFrame, n_samples: int, kind: str = "centred", least_maf: float = 0.01, columns: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Sum over markers of z z', and the number of markers; of the samples numbered in columns, by default all.

    kind: "centred" (missing to the mean) or "relationship" (allele dosage, standardised by
    frequency, markers under least_maf left out).  Every task adds up its own
    n x n matrix and sends it on in blocks of whole rows, BLOCK_CELLS values each; the
    blocks of all tasks are added up one after another.  n x n has to fit
    on the driver, which is the documented limit of the eigenvalue methods.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, m = np.zeros((n, n)), 0
        for pdf in sliced(batches, n_samples):
            x = matrix(pdf["x"])
            x = x if columns is None else x[:, columns]
            with np.errstate(invalid="ignore"):
                mean = np.nan_to_num(np.nanmean(x, axis=1, keepdims=True))
            x = np.where(np.isnan(x), mean, x) - mean
            if kind == "relationship":
                f = mean[:, 0] / 2
                keep = np.minimum(f, 1 - f) >= least_maf
                x, f = x[keep], f[keep]
                x = x / np.sqrt(2 * f * (1 - f))[:, None]
            total += x.T @ x
            m += len(x)
        if m:
            starts = np.arange(0, n, high)
            yield pd.DataFrame({"i": starts, "block": [total[i : i + high].tobytes() for i in starts], "m": m})

    n = n_samples if columns is None else len(columns)
    high = max(1, BLOCK_CELLS // max(1, n))
    out, markers = np.zeros((n, n)), 0
    for i, block, markers in block_sums(rows.select("x").mapInPandas(partial, BLOCKS)):  # noqa: B007
        b = block.reshape(-1, n)
        out[i : i + len(b)] = b
    return out, markers


def singular_values(rows: DataFrame, n_samples: int, k: int, columns: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest singular values of the row-centred matrix, their right vectors (k x n) and the number of markers."""
    g, m = gram(rows, n_samples, columns=columns)
    value, vector = np.linalg.eigh(g)
    order = np.argsort(-value)[:k]
    return np.sqrt(np.maximum(value[order], 0)), vector[:, order].T, m


def select_k(singular: np.ndarray, n_markers: int, n_samples: int) -> int:
    """Components above the Marchenko-Pastur edge, at least one."""
    eigen = singular**2
    noise = np.median(eigen) / n_markers
    return max(1, int((eigen / n_samples > noise * (1 + np.sqrt(n_markers / n_samples)) ** 2).sum()))


def sliced(batches: Iterator[pd.DataFrame], cells: int) -> Iterator[pd.DataFrame]:
    """Pieces of batches whose rows take at most CELLS values, cells of them a row; empty ones are left out."""
    most = max(1, CELLS // max(1, cells))
    for pdf in batches:
        for at in range(0, len(pdf), most):
            yield pdf.iloc[at : at + most]


def partial_fits(seen: np.ndarray, values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least-squares coefficients on the columns of q of every row of values, each over the samples where it is seen.

    The normal equations of all rows are one product with the columns' products,
    so rows with other missing samples cost no more than those with the same.  q is
    orthonormal over all samples, which keeps the equations well conditioned.
    """
    k = q.shape[1]
    info = (seen @ (q[:, :, None] * q[:, None, :]).reshape(len(q), k * k)).reshape(-1, k, k)
    return np.linalg.solve(info + 1e-12 * np.eye(k), (values @ q)[..., None])[..., 0]


def residuals(rows: DataFrame, basis: np.ndarray, least_share: float = 0.5) -> DataFrame:
    """Each marker minus its least-squares fit on basis (n x k); a marker with too few values stays as it is."""
    return corrected_columns(rows.select("marker", "x"), basis, "x", least_share).drop("corrected")


def corrected_columns(rows: DataFrame, basis: np.ndarray, values: str = "x", least_share: float = 0.5) -> DataFrame:
    """rows with the column of values less its fit on basis, and corrected: whether it has enough values for one (the share, and more than columns)."""
    n, k = basis.shape
    q, _ = np.linalg.qr(basis)
    least = max(k + 1, int(np.ceil(least_share * n)))
    at, kinds = rows.columns.index(values), ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, CELLS // max(1, n + k * k))
        for whole in batches:
            for start in range(0, whole.num_rows, most):
                batch = whole.slice(start, most)
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n)
                seen = np.isfinite(x)
                fitted = partial_fits(seen.astype(float), np.where(seen, x, 0.0), q) @ q.T
                enough = seen.sum(axis=1) >= least
                out = np.where(enough[:, None] & seen, x - fitted, x).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * n, pa.int32()), pa.array(out, pa.float64(), mask=np.isnan(out)))
                columns = [lists if i == at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(enough)], names=[*batch.schema.names, "corrected"])

    return rows.mapInArrow(fit, f"{kinds}, corrected boolean")


def ols(lrr: DataFrame, phenotype: DataFrame) -> DataFrame:
    """Slope, standard error, t and count of phenotype on each marker, without covariates: Spark's regression aggregates.

    A marker without variance gets slope 0, infinite error and t 0.
    """
    j = lrr.join(phenotype, "sample").where("value is not null and y is not null")
    s = j.groupBy("marker").agg(F.count("*").alias("n_samples"), F.var_pop("value").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("value", "y").alias("cxy"))
    ok = (F.col("n_samples") > 2) & (F.col("vx") > 0)
    s = s.withColumn("beta", F.when(ok, F.col("cxy") / F.col("vx")).otherwise(0.0))
    rss = F.greatest(F.col("vy") - F.col("beta") * F.col("cxy"), F.lit(0.0))
    s = s.withColumn("se", F.when(ok, F.sqrt(rss / (F.col("n_samples") - 2) / F.col("vx"))).otherwise(F.lit(float("inf"))))
    return s.select("marker", "beta", "se", F.when(ok & (F.col("se") > 0), F.col("beta") / F.col("se")).otherwise(0.0).alias("stat"), "n_samples")
