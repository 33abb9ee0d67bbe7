"""Whole-column text kernels in numpy: words, 64-bit word hashes and shingles.

They work on the flat UTF-8 buffer of an Arrow string column, a few MB at a
time, without making Python strings.  A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z
lower-cased; no byte of a longer UTF-8 sequence is changed by that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads close values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for a usual slice are kept, longer ones last for one text."""
    if n <= len(_powers.get("up", ())):
        return _powers["up"], _powers["down"]
    size, out = max(n, SLICE_BYTES + 2), {}
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out[key] = np.multiply.accumulate(p)
    if size <= SLICE_BYTES + 2:
        _powers.update(out)
    return out["up"], out["down"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8), offsets


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets from 0) of runs of rows of about SLICE_BYTES; a longer text is a run of its own."""
    data, offsets = buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, start and end of each word, and the n + 1 word offsets of the rows."""
    low = _LOWER[data]
    inside = _IS_WORD[low]
    first, last = offsets[:-1], offsets[1:]
    full = first < last
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(inside):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[first[full]] = False
        after[last[full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, from running sums, then mixed."""
    up, down = _power_tables(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[: len(low)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the runs of width words of each row, and the n + 1 offsets of the rows.

    A row with fewer words has one shingle, its whole sequence; without words it has none.
    """
    counts = np.diff(at)
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out_at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros(out_at[-1], dtype=np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    if len(hashes) >= width:
        run = np.zeros(len(hashes) - width + 1, dtype=np.uint64)
        for i in range(width):
            run = run * factor + hashes[i : len(hashes) - width + 1 + i]
        run = mixed(run + np.uint64(width))
        long = counts >= width
        take = np.repeat(at[:-1][long] - out_at[:-1][long], per_row[long]) + np.flatnonzero(np.repeat(long, per_row))
        out[np.repeat(long, per_row)] = run[take]
    for r in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for w in hashes[at[r] : at[r + 1]]:
                h = h * factor + w
            out[out_at[r]] = mixed(np.array([h + np.uint64(counts[r])]))[0]
    return out, out_at


def row_shingles(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, data, offsets in slices(column):
        low, starts, ends, at = words(data, offsets)
        shingles, out_at = shingle_hashes(word_hashes(low, starts, ends), at, width)
        for a, b in zip(out_at[:-1], out_at[1:], strict=True):
            yield np.unique(shingles[a:b])
