"""Low-rank factors of a matrix whose rows are spread over tasks, and what is built on them.

The matrix has a row (marker, x) for each marker and a column for each sample; it is
centred by row, missing values at the mean.  Nothing here holds samples x samples:
the driver and each task keep samples x components, and a tile of pairs of samples is
TILE x TILE.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import BLOCK_CELLS, BLOCKS, block_sums, matrix, singular_values, sliced

OVERSAMPLE, ROUNDS, TOLERANCE, FAN = 10, 60, 1e-12, 32
TILE, CHUNK = 1024, 2048


@dataclass
class Factors:
    """Singular values, right vectors (components x samples) and the number of markers; left vectors come from ``left``."""

    singular: np.ndarray
    right: np.ndarray
    n_markers: int


def centred(x: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Rows less their means, missing values 0; of the samples numbered in columns."""
    x = x if columns is None else x[:, columns]
    seen = np.isfinite(x)
    mean = np.where(seen, x, 0).sum(axis=1, keepdims=True) / np.maximum(seen.sum(axis=1, keepdims=True), 1)
    return np.where(seen, x - mean, 0.0)


def _tall(rows: DataFrame, width: int, n: int, k: int, product: Callable[[np.ndarray], np.ndarray], columns: np.ndarray | None) -> tuple[np.ndarray, int]:
    """The sum over the tasks of product(centred rows), n x k, and the number of rows; it meets in blocks, not whole."""
    high = max(1, BLOCK_CELLS // max(1, k))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, m = np.zeros((n, k)), 0
        for pdf in sliced(batches, width):
            x = centred(matrix(pdf["x"]), columns)
            total += product(x)
            m += len(x)
        if m:
            starts = np.arange(0, n, high)
            yield pd.DataFrame({"i": starts, "block": [total[i : i + high].tobytes() for i in starts], "m": m})

    out, markers = np.zeros((n, k)), 0
    for i, block, markers in block_sums(rows.select("x").mapInPandas(partial, BLOCKS)):  # noqa: B007
        b = block.reshape(-1, k)
        out[i : i + len(b)] = b
    return out, markers


def triangle(parts: DataFrame, k: int) -> np.ndarray:
    """R of the QR decomposition of tall blocks (column ``block``: rows of k numbers) by a tree: FAN triangles become one at each level."""

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, k))
        for pdf in batches:
            for block in pdf["block"]:
                r = np.linalg.qr(np.vstack([r, np.frombuffer(block).reshape(-1, k)]), mode="r")
        if len(r):
            yield pd.DataFrame({"block": [np.ascontiguousarray(r).tobytes()]})

    parts, n = parts.mapInPandas(level, "block binary"), parts.rdd.getNumPartitions()
    while n > FAN:
        n = -(-n // FAN)
        parts = parts.repartition(n).mapInPandas(level, "block binary")
    found = [np.frombuffer(bytes(r["block"])).reshape(-1, k) for r in parts.collect()]
    return np.linalg.qr(np.vstack([np.zeros((0, k)), *found]), mode="r") if found else np.zeros((0, k))


def randomised(rows: DataFrame, n_samples: int, k: int, columns: np.ndarray | None = None, oversample: int = OVERSAMPLE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 0) -> Factors:
    """The k largest singular values and their right vectors, by power rounds of a random block and a TSQR of its image.

    A round is one pass: each task adds up x' (x z) for its rows, samples x (k + oversample)
    numbers.  Rounds end when the wanted values move by less than tolerance, relative
    to the largest, or after ``rounds`` of them.  The image x z is then decomposed by a
    tree of small triangles, never gathered.
    """
    n = n_samples if columns is None else len(columns)
    width = min(n, k + oversample)
    z = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    last, m = np.full(width, np.inf), 0
    for _ in range(rounds):
        image, m = _tall(rows, n_samples, n, width, lambda x, z=z: x.T @ (x @ z), columns)
        values = np.sqrt(np.maximum(np.linalg.eigvalsh(z.T @ image)[::-1], 0))
        z = np.linalg.qr(image)[0]
        if np.abs(values[:k] - last[:k]).max(initial=0) <= tolerance * max(values[:1].max(initial=0), 1e-300):
            break
        last = values

    def images(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, n_samples):
            yield pd.DataFrame({"block": [(centred(matrix(pdf["x"]), columns) @ z).tobytes()]})

    r = triangle(rows.select("x").mapInPandas(images, "block binary"), width)
    _, s, v = np.linalg.svd(r)
    s = np.concatenate([s, np.zeros(max(0, width - len(s)))])
    return Factors(s[:k], (z @ v.T).T[:k], m)


def by_gram(rows: DataFrame, n_samples: int, k: int, columns: np.ndarray | None = None) -> Factors:
    """The same from the exact product matrix, samples x samples."""
    return Factors(*singular_values(rows, n_samples, k, columns))


Backend = Callable[[DataFrame, int, int, "np.ndarray | None"], Factors]
BACKENDS: dict[str, Backend] = {"rsvd": randomised, "gram": by_gram}


def decompose(rows: DataFrame, n_samples: int, k: int, columns: np.ndarray | None = None, backend: str | Backend = "rsvd") -> Factors:
    """Factors by a backend of BACKENDS, or by any function of the same arguments."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k > (n_samples if columns is None else len(columns)):
        raise ValueError(f"k={k} is more than the number of samples")
    if isinstance(backend, str) and backend not in BACKENDS:
        raise ValueError(f"no backend {backend!r}; there are {', '.join(sorted(BACKENDS))}")
    found = (BACKENDS[backend] if isinstance(backend, str) else backend)(rows, n_samples, k, columns)
    if k > found.n_markers:
        raise ValueError(f"k={k} is more than the number of markers, {found.n_markers}")
    return found


def left(rows: DataFrame, factors: Factors, columns: np.ndarray | None = None) -> DataFrame:
    """(marker, u): each marker's left vectors, its centred row times the right vectors over the singular values; 0 for values of 0."""
    scale = np.divide(1, factors.singular, out=np.zeros_like(factors.singular), where=factors.singular > 1e-12 * max(factors.singular.max(initial=0), 1e-300))
    turn = factors.right.T * scale

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, len(turn)):
            yield pd.DataFrame({"marker": pdf["marker"].to_numpy(), "u": list(centred(matrix(pdf["x"]), columns) @ turn)})

    return rows.select("marker", "x").mapInPandas(project, "marker long, u array<double>")


def residualised(rows: DataFrame, loadings: DataFrame, factors: Factors) -> DataFrame:
    """(marker, x): x less u s v of the marker's loadings (marker, u); missing values stay, and markers without loadings stay as they are.

    Rows and loadings meet by marker, so the loadings may be of some markers only.
    """
    product = factors.singular[:, None] * factors.right

    def subtract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in sliced(batches, product.shape[1]):
            u = np.array([np.zeros(len(product)) if v is None else np.array(v) for v in pdf["u"]])
            yield pd.DataFrame({"marker": pdf["marker"].to_numpy(), "x": list(matrix(pdf["x"]) - u @ product)})

    return rows.select("marker", "x").join(loadings.select("marker", "u"), "marker", "left").mapInPandas(subtract, "marker long, x array<double>")


def standardised(x: np.ndarray, least_maf: float) -> np.ndarray:
    """Dosages of markers that pass the frequency filter, less twice the frequency and over their spread; missing ones 0."""
    seen = np.isfinite(x)
    f = np.where(seen, x, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1) / 2
    keep = np.minimum(f, 1 - f) >= least_maf
    f = f[keep, None]
    spread = np.sqrt(2 * f * (1 - f))
    return np.divide(np.where(seen[keep], x[keep] - 2 * f, 0.0), spread, out=np.zeros_like(x[keep]), where=spread > 0)


def relationship_tiles(dosage: DataFrame, n_samples: int, least_maf: float = 0.01, tile: int = TILE) -> tuple[DataFrame, int]:
    """(i, j, block) of the relationship matrix for i <= j, tile x tile values each, and the number of markers.

    dosage: (marker, x).  Standardised rows are cut into pieces of ``tile`` samples, a few
    MB of markers at a time.  A pair of pieces meets in the task of its tile, which holds
    one tile and two pieces; a piece goes to as many tasks as there are tiles in its row.
    """
    n_tiles = -(-n_samples // tile)
    most = max(1, min(CHUNK, (1 << 22) // max(1, n_samples)))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for at in range(0, len(pdf), most):
                z = standardised(matrix(pdf["x"].iloc[at : at + most]), least_maf)
                if len(z):
                    cut = [np.ascontiguousarray(z[:, t * tile : (t + 1) * tile]) for t in range(n_tiles)]
                    yield pd.DataFrame({"chunk": number, "t": range(n_tiles), "m": len(z), "piece": [c.tobytes() for c in cut]})
                    number += 1

    found = dosage.select("x").mapInPandas(pieces, "chunk long, t int, m int, piece binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("o")
    dealt = found.select("*", other).select("chunk", "m", "piece", "t", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, total, m, waiting = None, None, 0, None
        for pdf in batches:
            for i, j, chunk, t, rows, piece in zip(pdf["i"], pdf["j"], pdf["chunk"], pdf["t"], pdf["m"], pdf["piece"], strict=True):
                if (i, j) != here:
                    if here is not None:
                        yield pd.DataFrame({"i": [here[0]], "j": [here[1]], "block": [total.tobytes()], "m": [m]})
                    here, m, waiting = (i, j), 0, None
                    total = np.zeros((min(tile, n_samples - i * tile), min(tile, n_samples - j * tile)))
                z = np.frombuffer(piece).reshape(rows, -1)
                if i == j:
                    total += z.T @ z
                    m += rows
                elif waiting is None or waiting[0] != chunk:
                    waiting = chunk, t, z
                else:
                    a, b = (waiting[2], z) if waiting[1] == i else (z, waiting[2])
                    total += a.T @ b
        if here is not None:
            yield pd.DataFrame({"i": [here[0]], "j": [here[1]], "block": [total.tobytes()], "m": [m]})

    tiles = dealt.repartition("i", "j").sortWithinPartitions("i", "j", "chunk", "t").select("i", "j", "chunk", "t", "m", "piece").mapInPandas(products, "i int, j int, block binary, m long")
    return tiles, n_tiles


def with_markers(tiles: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Stored tiles and the number of markers in them, which all tiles on the diagonal have."""
    tiles.write.mode("overwrite").parquet(path)
    kept = tiles.sparkSession.read.schema(tiles.schema).parquet(path)
    row = kept.where("i = j").agg(F.max("m").alias("m")).first()
    if not row["m"]:
        raise ValueError("no marker is left for the relationship matrix")
    return kept, row["m"]


def diagonal(tiles: DataFrame, m: int, tile: int = TILE) -> DataFrame:
    """(sample, diagonal) of the matrix of tiles over m markers."""

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, block in zip(pdf["i"], pdf["block"], strict=True):
                n = int(np.sqrt(len(block) // 8))
                yield pd.DataFrame({"sample": i * tile + np.arange(n), "diagonal": np.diag(np.frombuffer(block).reshape(n, n)) / m})

    return tiles.where("i = j").select("i", "block").mapInPandas(own, "sample long, diagonal double")


def tiled_product(tiles: DataFrame, n_samples: int, m: int, tile: int = TILE) -> Callable[[np.ndarray], np.ndarray]:
    """The product of the matrix of tiles with a few vectors; what the tiles give meets by block of samples."""

    def product(v: np.ndarray) -> np.ndarray:
        k = v.shape[1]

        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for i, j, block in zip(pdf["i"], pdf["j"], pdf["block"], strict=True):
                    a, b = (v[t * tile : (t + 1) * tile] for t in (i, j))
                    x = np.frombuffer(block).reshape(len(a), len(b))
                    out = [(i, x @ b)] if i == j else [(i, x @ b), (j, x.T @ a)]
                    yield pd.DataFrame({"i": [t for t, _ in out], "block": [y.tobytes() for _, y in out], "m": 1})

        out = np.zeros((n_samples, k))
        for t, block, _ in block_sums(tiles.select("i", "j", "block").mapInPandas(apply, BLOCKS)):
            out[t * tile : (t + 1) * tile] = block.reshape(-1, k)
        return out / m

    return product


def leading(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, block: int = 8, most: int = 40, tolerance: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors (n x k) of a symmetric matrix, by block Lanczos steps with full orthogonalisation.

    The driver keeps n x (block * steps) numbers; each step is one product with a
    block.  It ends when the wanted residuals are below tolerance times the largest value.
    """
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, min(n, max(1, block)))))[0]
    basis, images = q, product(q)
    for _ in range(most):
        small = basis.T @ images
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1][:k], turn[:, ::-1][:, :k]
        vector = basis @ turn
        off = np.linalg.norm(images @ turn - vector * value, axis=0)
        if basis.shape[1] >= n or len(value) == k and off.max(initial=0) <= tolerance * max(abs(value[0]), 1e-300):
            break
        q = images[:, -q.shape[1] :]
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
        q, r = np.linalg.qr(q)
        q = q[:, np.abs(np.diag(r)) > 1e-13 * max(abs(value[0]), 1e-300)][:, : n - basis.shape[1]]
        if not q.shape[1]:  # the block spans all that the start can reach
            q = np.random.default_rng(seed + basis.shape[1]).normal(size=(n, min(max(1, block), n - basis.shape[1])))
            for _ in range(2):
                q = q - basis @ (basis.T @ q)
            q = np.linalg.qr(q)[0]
        basis, images = np.hstack([basis, q]), np.hstack([images, product(q)])
    return value, vector
