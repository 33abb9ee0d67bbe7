"""Relationship matrices in files: the lower triangle as 32-bit floats, row after row, beside a list of sample ids.

Such a file is read and written in bands of rows, which are runs of its bytes; a band
becomes tiles of pairs of samples, so that no task holds more than a band and nothing
holds the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bcf import _store

TILES = "i int, j int, block binary, m long"


def _first(row: int) -> int:
    """The number of values before a row of the triangle."""
    return row * (row + 1) // 2


def sample_ids(spark: SparkSession, path: str) -> DataFrame:
    """(number, sample) of an id list: the second column, or the only one; lines of a header (#) go."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split(F.trim("value"), r"\s+")
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    placed = lines.select(order.alias("at"), F.coalesce(F.get(cells, F.lit(1)), F.get(cells, F.lit(0))).alias("sample"))
    listed = placed.agg(F.array_sort(F.collect_list(F.struct("at", "sample"))).alias("s"))
    return listed.select(F.posexplode("s").alias("number", "s")).select(F.col("number").cast("long").alias("number"), "s.sample")


def _parts(path: str) -> list[tuple[str, int, int]]:
    """(file, first value, number of values) of a file, or of the parts of a folder in order of their names."""
    store, name = _store(path)
    info = store.get_file_info(name)
    found = [info] if info.is_file else sorted((f for f in store.get_file_info(_selector(name)) if f.base_name.startswith("band-")), key=lambda f: f.base_name)
    out, at = [], 0
    for f in found:
        out.append((f.path, at, f.size // 4))
        at += f.size // 4
    return out


def _selector(name: str):
    from pyarrow import fs

    return fs.FileSelector(name)


def read(spark: SparkSession, path: str, tile: int = 256) -> tuple[DataFrame, int]:
    """Tiles (i <= j) of the matrix in a file or a folder of parts, and the number of samples.

    A task seeks to the bytes of its bands only.
    """
    parts = _parts(path)
    total = sum(n for _, _, n in parts)
    n = int((np.sqrt(8 * total + 1) - 1) / 2)
    if _first(n) != total:
        raise ValueError(f"{path} has {total} values, which is no lower triangle")

    def values(first: int, end: int) -> np.ndarray:
        store, found = _store(path)[0], []
        for name, at, many in parts:
            a, b = max(first, at), min(end, at + many)
            if a < b:
                with store.open_input_file(name) as source:
                    source.seek(4 * (a - at))
                    found.append(np.frombuffer(source.read(4 * (b - a)), "<f4"))
        return np.concatenate(found) if found else np.zeros(0, "<f4")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for band in pdf["id"]:
                low, high = band * tile, min(n, (band + 1) * tile)
                flat = values(_first(low), _first(high))
                square = np.zeros((high - low, high))
                for r in range(low, high):
                    square[r - low, : r + 1] = flat[_first(r) - _first(low) : _first(r + 1) - _first(low)]
                own = square[:, low:]
                square[:, low:] = own + np.tril(own, -1).T
                for t in range(band + 1):
                    yield pd.DataFrame({"i": [t], "j": [band], "block": [np.ascontiguousarray(square[:, t * tile : (t + 1) * tile].T).tobytes()], "m": [1]})

    n_bands = -(-n // tile)
    return spark.range(0, n_bands, 1, max(1, min(n_bands, 10_000))).mapInPandas(bands, TILES), n


def write(tiles: DataFrame, n_samples: int, n_markers: int, path: str, samples: list[str], tile: int = 256) -> None:
    """The triangle of tiles over n_markers markers as a folder: parts that follow one another by name, and samples.id.

    A band's tiles meet in one task by a sort, one after another; the rows of a band are a part of their own.
    """
    store, base = _store(path)
    store.create_dir(base, recursive=True)

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, square = None, None

        def done() -> pd.DataFrame:
            low = here * tile
            name = f"{base}/band-{here:08d}"
            rows = [square[r, : low + r + 1].astype("<f4").tobytes() for r in range(len(square))]
            with _store(path)[0].open_output_stream(name, compression=None) as out:
                out.write(b"".join(rows))
            return pd.DataFrame({"band": [here]})

        for pdf in batches:
            for i, j, block in zip(pdf["i"], pdf["j"], pdf["block"], strict=True):
                if j != here:
                    if here is not None:
                        yield done()
                    here, square = j, np.zeros((min(tile, n_samples - j * tile), min(n_samples, (j + 1) * tile)))
                square[:, i * tile : (i + 1) * tile] = np.frombuffer(block).reshape(-1, len(square)).T / n_markers
        if here is not None:
            yield done()

    written = tiles.select("i", "j", "block").repartition("j").sortWithinPartitions("j", "i").mapInPandas(bands, "band int")
    if written.distinct().count() != -(-n_samples // tile):
        raise ValueError("tiles are missing")
    with store.open_output_stream(f"{base}/samples.id", compression=None) as out:
        out.write("".join(f"{s}\t{s}\n" for s in samples).encode())


def write_factor(factor: DataFrame, path: str) -> DataFrame:
    """A matrix z z' as the rows (sample, name, z) of its factor, 32-bit floats in Parquet, and as read back.

    Of m markers and n samples that is n m values for the triangle's n (n + 1) / 2,
    and any value of the matrix is the product of two rows.
    """
    factor.select("sample", "name", F.col("z").cast("array<float>").alias("z")).write.mode("errorifexists").parquet(path)
    return read_factor(factor.sparkSession, path)


def read_factor(spark: SparkSession, path: str) -> DataFrame:
    """(sample, name, z) of a factor file; samples that are asked for by number or name are filtered where they are read."""
    return spark.read.schema("sample long, name string, z array<float>").parquet(path)


def factor_diagonal(factor: DataFrame) -> DataFrame:
    """(sample, name, diagonal) of the matrix of a factor."""
    return factor.select("sample", "name", F.aggregate("z", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")).alias("diagonal"))


def factor_tile(factor: DataFrame, first: int, other: int, tile: int = 256) -> DataFrame:
    """(a, b, value) of the pairs of samples numbered in two tiles."""
    side = lambda t, name: factor.where(F.col("sample").between(t * tile, (t + 1) * tile - 1)).select(F.col("sample").alias(name), F.col("z").alias(f"z_{name}"))
    both = F.zip_with("z_a", "z_b", lambda x, y: x.cast("double") * y.cast("double"))
    return side(first, "a").crossJoin(F.broadcast(side(other, "b"))).select("a", "b", F.aggregate(both, F.lit(0.0), lambda total, v: total + v).alias("value"))
