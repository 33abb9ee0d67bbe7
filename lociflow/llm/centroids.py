"""Centroid clustering in integers, with products of 32-bit floats to screen the centroids.

A vector's components x become floor(256 x).  Squared distances, sums and means are
exact integers; ties go to the smaller number.  The nearest centroid of a vector is
found in two steps: a matrix product of 32-bit floats gives each distance an
interval that contains it (the error of a sum of n products in any order is at most
gamma(n + 2) = (n + 2) u / (1 - (n + 2) u) times the sum of their sizes, u = 2^-24, which the
product of the two lengths bounds), and only the centroids whose interval meets the
best one are measured in integers.

A round is one pass over the stored vectors: tasks assign theirs and add them up,
and the driver gets one row for each centroid and component.  Nothing else meets in
one place.

Vectors of another length, or with a null or non-finite component, are left out;
null vec_ids are clustered, but never seeds; repeated rows count each for itself,
and of seeds with one id the smaller vector comes first.  With fewer vectors than
centroids each vector is a seed, and an empty table gives an empty result.
Components beyond 2^27 in size, whose squared distances could leave 64 bits, end the
job with a message.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved, shared_dir

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 40, 5, 256
LARGEST = 1 << 27
SLICE = 4096


def as_integers(embedding: Column, scale: int = SCALE, largest: int = LARGEST) -> Column:
    """floor(scale * x) of every component as a long."""
    low = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: F.abs(x.cast("double") * scale) < largest
    return F.transform(embedding, lambda x: F.when(fits(x), low(x)).otherwise(F.raise_error(F.lit(f"a component is {largest // scale} or more in size")).cast("long")))


def kept_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integers of each vector that has exactly that many components, all finite."""
    known = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = (F.size("embedding") == dimensions) & F.forall("embedding", lambda x: F.coalesce(known(x.cast("double")), F.lit(False)))
    return df.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), as_integers(F.col("embedding"), scale).alias("v"))


def seeds(vectors: DataFrame, n: int = CENTROIDS) -> np.ndarray:
    """The n vectors of the smallest SHA-256 of ``2:<vec_id>``, in that order."""
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(name.alias("name"), "v").orderBy("name", "v").limit(n).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Nearest:
    """Finds the nearest of integer centroids for integer vectors."""

    def __init__(self, centroids: np.ndarray):
        self.exact = centroids
        self.single = centroids.astype(np.float32)
        self.squares = (centroids * centroids).sum(axis=1).astype(float)
        n = centroids.shape[1] + 2
        self.gamma = n * 2.0**-24 / (1 - n * 2.0**-24)
        self.lengths = np.sqrt(self.squares)
        self.measured = 0

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        product = (x.astype(np.float32) @ self.single.T).astype(float)
        lengths = np.sqrt((x * x).sum(axis=1).astype(float))
        # distance less the vector's own square; the last term covers the roundings of this 64-bit arithmetic
        middle = self.squares - 2 * product
        error = 2 * self.gamma * (1 + 1e-12) * lengths[:, None] * self.lengths + 2.0**-50 * (self.squares + 2 * np.abs(product)) + 2.0**-50
        least = (middle + error).min(axis=1)
        row, number = np.nonzero(middle - error <= least[:, None])
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = number[first].copy()
        several = np.diff(first, append=len(row)) > 1
        if several.any():
            pick = several[row]
            r, k = row[pick], number[pick]
            self.measured += len(r)
            d = ((x[r] - self.exact[k]) ** 2).sum(axis=1)
            order = np.lexsort((k, d, r))  # of a vector's candidates the nearest, then the smaller number
            at = order[np.flatnonzero(np.diff(r[order], prepend=-1))]
            best[r[at]] = k[at]
        return best, ((x - self.exact[best]) ** 2).sum(axis=1)


def _slices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part.column(0), part.column(1).flatten().to_numpy().reshape(-1, dimensions)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    k, n = centroids.shape

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest, total, count = Nearest(centroids), np.zeros((k, n), np.int64), np.zeros(k, np.int64)
        for _, x in _slices(batches, n):
            best, _ = nearest.of(x)
            count += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            starts = np.flatnonzero(np.diff(best[order], prepend=-1))
            total[best[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(full, n)), pa.array(np.tile(np.arange(n), len(full))), pa.array(total[full].ravel()), pa.array(np.repeat(count[full], n))], names=["cluster", "i", "total", "n"])

    parts = vectors.select("vec_id", "v").mapInArrow(added, "cluster long, i long, total long, n long")
    sums = parts.groupBy("cluster", "i").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in sums:
        out[r["cluster"], r["i"]] = int(r["total"]) // r["n"]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of each vector."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = Nearest(centroids)
        for ids, x in _slices(batches, centroids.shape[1]):
            best, distance = nearest.of(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, cluster int, distance long")


def clustered(df: DataFrame, dimensions: int = DIMENSIONS, n_centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each kept vector of df (vec_id, embedding)."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    vectors = saved(kept_vectors(df, dimensions, scale), f"{folder}/vectors")
    centroids = seeds(vectors, n_centroids)
    if not len(centroids):
        return vectors.where(F.lit(False)).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = saved(assigned(vectors, centroids), f"{folder}/assigned")
    sums = {r["cluster"]: int(r["total"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(k, sums.get(k, 0), sum(sums.values()), name) for k, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
