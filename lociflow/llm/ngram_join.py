"""Exact Jaccard self-join of five-word shingle sets by count-vector R-trees.

Two documents link when 100 * |A & B| >= 75 * |A | B|.  The result has every
document's component under these links.

1. Classes.  Documents with the same shingle set are one class, named by a 64-bit
   hash of the set; where a second hash shows that two sets share a name, both
   are named by both hashes.  Exact copies never meet again.
2. Partition.  Linked sets share one of their first n - ceil(3n/4) + 1 shingles
   in any fixed order of all shingles.  The order here is by hash, with the
   ``HOT_SHINGLES`` most frequent shingles (counted over all documents) last.
   The classes with the same shingle among their first form a cell, and cells
   with the same smallest class are one.  The frequent shingles' smallest classes
   are aggregated in each task before any shuffle and handed out by a broadcast of
   at most ``HOT_SHINGLES`` rows, so no task gets all classes of one of them, and a
   class is sent on once for each of its cells, not for each of its shingles.
3. Points.  Each shingle is hashed into one of ``GROUPS`` groups; the group
   counts of a class are its point.  The summed coordinate minima of two points
   bound the overlap from above, and so do those of the upper corners of two
   rectangles.  Pairs that pass are bounded again with finer groups, at least half
   as many as the class has shingles; a point is kept as its finer counts,
   Zstandard-compressed.
4. Stars.  In each cell every class is held against the cell's smallest class:
   pairs whose bounds allow a link are verified on their sets.  Each class meets
   the smallest of its cells first, and of the others those that are in another
   component after that.  This joins large groups of near copies with a number
   of pairs linear in them.  The set of a
   class with many partners is copied to a task for each ``STAR`` of them.
5. R-trees.  In each cell whose classes are still in different components an
   R-tree is bulk-loaded and joined with itself by the bound.  The cells are here
   those of the shingles with the same two smallest classes, cut where no class is
   of a size that links both parts; shingles of only two classes are settled.  Of the surviving pairs of each two components ``BEST`` are
   verified first, and all where these leave the two apart.  Cells of more than
   ``CELL`` classes are dealt into parts, and every two parts are joined by a task
   of their own, so no pair is left out.
6. Components of the verified links, in Spark.

Words and shingles are those of ``textvec``; sets are compared by 64-bit shingle
hashes.  The links that are found span each component; pairs inside one that is
already joined are not verified again.  Texts without words and null texts link
with nothing and are their own component.  Rows with a null doc_id link like
others; a component of nothing but such rows is null.  Rows that repeat a doc_id
count as the texts they have.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dropped, free_name, keyed_join, saved, shared_dir, spread
from .textvec import row_shingles, shingle_hashes, slices, word_hashes, words

NUMERATOR, DENOMINATOR = 3, 4
GROUPS = 128
FINE_BITS = (9, 15)
HOT_SHINGLES = 50_000
WINDOW, HOT_IN_WINDOW = 1 << 21, 4
CELL, STAR = 1024, 1024
BEST, TRIED = 4, 64
BANDS = 8
LEAF = 16
BROADCAST_ROWS = 500_000


def needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The least overlap of sets of sizes n and m that link: 4 o >= 3 (n + m - o)."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent shingles.

    Every partition is counted in windows of about WINDOW shingles, rows that repeat a
    text of the window once; what a window holds at least HOT_IN_WINDOW times is summed
    up over all.  The choice only affects the speed.
    """

    def found(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        keep = n >= HOT_IN_WINDOW
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, held = [], np.zeros(0, np.uint64), 0
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                low, starts, ends, at = words(data, offsets)
                new, seen = unseen(*shingle_hashes(word_hashes(low, starts, ends), at), seen)
                parts.append(new)
                held += len(new)
                if held >= WINDOW:
                    yield found(parts)
                    parts, seen, held = [], np.zeros(0, np.uint64), 0
        if held:
            yield found(parts)

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT_SHINGLES).collect()
    return np.sort(np.array([r["token"] for r in found], np.int64).view(np.uint64))


def unseen(shingles: np.ndarray, at: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of the rows (n + 1 offsets) whose sums of shingles are new, the first row of each, and seen with these sums."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles)])
    sums, first = np.unique(total[at[1:]] - total[at[:-1]], return_index=True)
    fresh = np.zeros(len(at) - 1, bool)
    fresh[first[~np.isin(sums, seen)]] = True
    return shingles[np.repeat(fresh, np.diff(at))], np.union1d(seen, sums)


def class_names(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of a sorted set."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def features(docs: DataFrame, hot: np.ndarray, row: str | None = None) -> DataFrame:
    """(doc_id, [row], text_hash, n_shingles, cls, cls2, prefix, hot_prefix, fine) of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)
    new = [("n_shingles", pa.int64()), ("cls", pa.int64()), ("cls2", pa.int64()), ("prefix", pa.list_(pa.int64())), ("hot_prefix", pa.list_(pa.int64())), ("fine", pa.binary())]

    def lists(parts: list[np.ndarray | None]) -> pa.Array:
        ends = np.cumsum([0] + [0 if p is None else len(p) for p in parts], dtype=np.int32)
        flat = [p for p in parts if p is not None]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).view(np.int64) if flat else np.zeros(0, np.int64)))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, point = sent.value, PointWriter()
        for batch in batches:
            sizes, names, colds, hots, fine = [], [], [], [], []
            for s in row_shingles(batch.column(batch.num_columns - 1)):
                n = len(s)
                sizes.append(n)
                names.append(class_names(s) if n else (None, None))
                fine.append(point.of(s) if n else None)
                p = n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0
                is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(n, bool)
                cold = s[~is_hot][:p]
                colds.append(cold)
                hots.append(s[is_hot][: p - len(cold)])
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), *[pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)], lists(colds), lists(hots), pa.array(fine, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *[n for n, _ in new]])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([F.col(row).cast("long").alias("row")] if row else []), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    kind = ", ".join(f"{c} long" for c in rows.columns[:-1])
    return rows.mapInArrow(extract, f"{kind}, n_shingles long, cls long, cls2 long, prefix array<long>, hot_prefix array<long>, fine binary")


def text_hash() -> F.Column:
    """Finds a document's text again, together with its doc_id; other texts that share it only cost time."""
    return F.xxhash64(F.col("text").cast("string"))


class PointWriter:
    """Counts of a set in at least half as many groups as it has shingles, compressed: item size, log2 of the groups, counts."""

    def __init__(self):
        import zstandard

        self.zstd = zstandard.ZstdCompressor(level=1)

    def of(self, s: np.ndarray) -> bytes:
        bits = min(FINE_BITS[1], max(FINE_BITS[0], (len(s) // 2).bit_length()))
        counts = np.bincount((s & np.uint64((1 << bits) - 1)).astype(np.intp), minlength=1 << bits)
        width = 1 if counts.max() < 256 else 4
        return bytes([width]) + self.zstd.compress(counts.astype(f"<u{width}").tobytes())


class PointReader:
    def __init__(self):
        import zstandard

        self.zstd = zstandard.ZstdDecompressor()

    def fine(self, data: bytes) -> np.ndarray:
        return np.frombuffer(self.zstd.decompress(data[1:]), f"<u{data[0]}")

    def coarse(self, data: bytes) -> np.ndarray:
        """The point in GROUPS groups."""
        return self.fine(data).reshape(-1, GROUPS).sum(axis=0, dtype=np.int64)


def fine_bound(x: np.ndarray, y: np.ndarray) -> int:
    """The summed minima of two fine points, the finer one folded onto the groups of the other."""
    n = min(len(x), len(y))
    x, y = (v if len(v) == n else v.reshape(-1, n).sum(axis=0) for v in (x, y))
    return int(np.minimum(x, y).sum(dtype=np.int64))


class CountTree:
    """An R-tree over count vectors, bulk-loaded by size and then by the widest coordinates.

    Levels are kept as upper corners and least sizes: the bound needs no lower corner.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        spread_ = np.argsort(-points.var(axis=0))[:2] if len(points) else []
        keys = [points[:, g] // 4 for g in spread_][::-1] + [sizes // 8]
        self.order = np.lexsort(keys) if len(points) else np.zeros(0, int)
        self.levels = [(points[self.order], sizes[self.order], sizes[self.order])]
        while len(self.levels[-1][0]) > LEAF:
            top, low, high = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))


def joined(a: CountTree, b: CountTree, same: bool, at_once: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of a and b whose bound reaches the overlap that links; each pair once if a is b."""
    depth = max(len(a.levels), len(b.levels))
    level = lambda t, k: t.levels[min(k, len(t.levels) - 1)]

    def passing(k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (pa_, la, ha), (pb, lb, hb) = level(a, k), level(b, k)
        ok = (DENOMINATOR * ha[i] >= NUMERATOR * lb[j]) & (DENOMINATOR * hb[j] >= NUMERATOR * la[i])
        at = np.flatnonzero(ok)
        bound = np.minimum(pa_[i[at]], pb[j[at]]).sum(axis=1)
        ok[at] = bound >= needed(la[i[at]], lb[j[at]])
        return ok

    def children(t: CountTree, k: int, i: np.ndarray) -> np.ndarray:
        """Indices one level down, -1 beyond the end; the same index where the tree has no such level."""
        if k >= len(t.levels):
            return i[:, None]
        kids = i[:, None] * LEAF + np.arange(LEAF)
        return np.where(kids < len(t.levels[k - 1][0]), kids, -1)

    def down(k: int, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for s in range(0, len(i), at_once):
            x, y = i[s : s + at_once], j[s : s + at_once]
            ok = passing(k, x, y)
            x, y = x[ok], y[ok]
            if not len(x):
                continue
            if k == 0:
                yield a.order[x], b.order[y]
                continue
            cx, cy = children(a, k, x), children(b, k, y)
            n, m = cx.shape[1], cy.shape[1]
            cx, cy = np.repeat(cx, m, axis=1).ravel(), np.tile(cy, (1, n)).ravel()
            keep = (cx >= 0) & (cy >= 0)
            if same:
                keep &= (cx <= cy) if k > 1 else (cx < cy)
            yield from down(k - 1, cx[keep], cy[keep])

    k = depth - 1
    n, m = len(level(a, k)[0]), len(level(b, k)[0])
    i, j = np.repeat(np.arange(n), m), np.tile(np.arange(m), n)
    if same:
        keep = (i <= j) if k else (i < j)
        i, j = i[keep], j[keep]
    yield from down(k, i, j)


def _bounded(pairs: DataFrame, points: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, na, nb) whose sizes and points allow a link."""
    p = points.select("cls", "n_shingles", "fine")
    sized = saved(pairs.where("4 * na >= 3 * nb and 4 * nb >= 3 * na").select("a", "b", "na", "nb"), f"{folder}-sized")
    partners = saved(sized.groupBy("a").agg(F.count("*").alias("n")), f"{folder}-firsts")
    seconds = sized.join(p.select(F.col("cls").alias("b"), F.col("fine").alias("pb")), "b")
    firsts = partners.join(p.select(F.col("cls").alias("a"), F.col("fine").alias("pa")), "a")
    rows = keyed_join(seconds, firsts, "a", "n", partners).select("a", "b", "na", "nb", "pa", "pb")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, last, x = PointReader(), None, None
        for batch in batches:
            ok = []
            for n, m, p, q in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                if p != last:
                    last, x = p, point.fine(p)
                ok.append(fine_bound(x, point.fine(q)) >= needed(n, m))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(bound, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, clashes: list[int]) -> DataFrame:
    """(cls, shingles) of classes, from one document (doc_id, text_hash) of each; other classes may come too."""
    spark = docs.sparkSession
    key = lambda: F.xxhash64("doc_id", "text_hash").alias("key")
    wanted = wanted.select(key())
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    rows = rows.select(key(), "text").join(wanted, "key", "left_semi").select("text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in row_shingles(batch.column(0)) if len(s)]
            names = [class_names(s) for s in sets]
            yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in names], pa.int64()) for k in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "cls2", "shingles"])

    found = _renamed(rows.mapInArrow(extract, "cls long, cls2 long, shingles binary"), clashes)
    return saved(found.select("cls", "shingles").dropDuplicates(["cls"]), shared_dir(spark))


def _renamed(rows: DataFrame, clashes: list[int]) -> DataFrame:
    """rows, with the names that several sets share replaced by a hash of both names."""
    return rows.withColumn("cls", F.when(F.col("cls").isin(clashes), F.xxhash64("cls", "cls2")).otherwise(F.col("cls"))) if clashes else rows


def _clashes(rows: DataFrame) -> list[int]:
    """Names that several sets share: at 10**11 different texts a few hundred."""
    two = rows.where("cls is not null").groupBy("cls").agg(F.min("cls2").alias("x"), F.max("cls2").alias("y")).where("x != y")
    return sorted(r["cls"] for r in two.select("cls").collect())


def _verified(docs: DataFrame, pairs: DataFrame, points: DataFrame, clashes: list[int], folder: str) -> DataFrame:
    """The pairs (a, b) that link.  Each b's set goes to a task with its a, whose set comes first; an a of many partners has several tasks."""
    spark = pairs.sparkSession
    partners = saved(pairs.groupBy("a").agg(F.count("*").alias("n")), f"{folder}-partners")
    wanted = partners.select("a").toDF("cls").union(pairs.select("b").toDF("cls")).distinct()
    sets = _sets(docs, points.join(wanted, "cls", "left_semi"), clashes)
    parts = F.ceil(F.col("n") / STAR).cast("int")
    dealt = keyed_join(pairs, partners.withColumn("parts", parts), "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    seconds = dealt.join(sets.toDF("b", "shingles"), "b").select("a", "part", "b", "shingles")
    firsts = partners.join(sets.toDF("a", "shingles"), "a").select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, mine = None, None
        for batch in batches:
            out = []
            for a, part, b, data in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                s = np.frombuffer(data, np.uint64)
                if b is None:
                    current, mine = (a, part), s
                elif (a, part) == current:
                    shared = len(mine) + len(s) - len(np.union1d(mine, s))
                    if shared >= needed(len(mine), len(s)):
                        out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    rows = firsts.unionByName(seconds).repartition(spread(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(verify, "a long, b long")


def _tree_pairs(members: DataFrame, every: bool) -> DataFrame:
    """Candidate pairs (cell, i, j, a, b, more) of the cells' parts; members has (cell, i, j, side, cls, component, n_shingles, fine), sorted by task.

    Pairs of one component need no link.  Unless every is set, a task names for two
    components at most BEST pairs, those of the highest bounds among the first TRIED,
    and more is whether there are others.
    """

    def pairs_of(rows: list[tuple], point: PointReader) -> Iterator[tuple]:
        task = rows[0][:3]
        same = task[1] == task[2]
        sides = [[r for r in rows if r[3] == s] for s in ((0,) if same else (0, 1))]
        if not all(sides):
            return
        fine = [[point.fine(r[7]) for r in s] for s in sides]
        trees = [CountTree(np.stack([x.reshape(-1, GROUPS).sum(axis=0, dtype=np.int64) for x in f]), np.array([r[6] for r in s])) for f, s in zip(fine, sides, strict=True)]
        found: dict[tuple[int, int], list] = {}
        more = set()
        for x, y in joined(trees[0], trees[-1], same):
            for p, q in zip(x.tolist(), y.tolist(), strict=True):
                r, s = sides[0][p], sides[-1][q]
                if r[5] == s[5]:
                    continue
                two = (min(r[5], s[5]), max(r[5], s[5]))
                if not every and len(found.get(two, ())) >= TRIED:
                    more.add(two)
                    continue
                bound = fine_bound(fine[0][p], fine[-1][q])
                if bound >= needed(r[6], s[6]):
                    pair = (min(r[4], s[4]), max(r[4], s[4]))
                    if every:
                        yield (*task, *pair, False)
                    else:
                        found.setdefault(two, []).append((-bound / (r[6] + s[6]), pair))
        for two, pairs in found.items():
            for _, pair in sorted(pairs)[:BEST]:
                yield (*task, *pair, two in more or len(pairs) > BEST)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, point, found = None, [], PointReader(), []
        names = ["cell", "i", "j", "a", "b", "more"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

        def settled() -> Iterator[pa.RecordBatch]:
            for pair in pairs_of(rows, point) if len(rows) > 1 else ():
                found.append(pair)
                if len(found) > 10_000:
                    yield batch_of()
                    found.clear()

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if r[:3] != key:
                    yield from settled()
                    key, rows = r[:3], []
                rows.append(r)
        yield from settled()
        if found:
            yield batch_of()

    return members.mapInArrow(search, "cell long, i int, j int, a long, b long, more boolean")


def _hot_cells(has: DataFrame) -> DataFrame:
    """(cell, cls) of the frequent shingles, each pair once a row.

    A task sends on one class for each shingle, its smallest, and of a row's shingles
    that have the same smallest class only one.
    """
    spark = has.sparkSession
    rows = has.where(F.size("hot_prefix") > 0).select("cls", "hot_prefix")

    def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Class and shingle of every entry."""
        lists = batch.column(1)
        return np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            cls, token = (np.concatenate(x) for x in zip(kept, flat(batch), strict=True))
            order = np.lexsort((cls, token))
            first = order[np.unique(token[order], return_index=True)[1]]
            kept = cls[first], token[first]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["cls", "token"])

    smallest = rows.mapInArrow(least, "cls long, token long").groupBy("token").agg(F.min("cls").alias("cls"))
    found = sorted((r["token"], r["cls"]) for r in smallest.collect())  # of the HOT_SHINGLES broadcast ones only
    sent = spark.sparkContext.broadcast(np.array(found, np.int64).reshape(-1, 2).T.copy())

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, cells = sent.value
        for batch in batches:
            cls, token = flat(batch)
            out = np.stack([cells[np.searchsorted(tokens, token)], cls])
            out = np.unique(out[:, out[0] != out[1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["cell", "cls"])

    return rows.mapInArrow(cells_of, "cell long, cls long")


def _cells(has: DataFrame) -> DataFrame:
    """(cell, cls, cell_n, n, trees): the classes that share one of their first shingles with a smaller class, under the smallest of each shingle, and the sizes of both.

    trees names the sets of classes in which the pair has to meet others: one for the
    shingles of the same two smallest classes, none where a shingle has only two.  The
    sizes join the pairs, so that the shuffle of all first shingles goes without them.
    """
    cold = has.select("cls", F.explode("prefix").alias("token"))
    by = Window.partitionBy("token").orderBy("cls")
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = cold.select("cls", F.first("cls").over(so_far).alias("cell"), F.nth_value("cls", 2).over(so_far).alias("second"), F.dense_rank().over(by).alias("rank"), F.lead("cls").over(by).alias("next"))
    third = (F.col("rank") > 2) | (F.col("next") != F.col("cls"))
    cold = cold.where("rank > 1").select("cell", "cls", F.when(third, F.xxhash64("cell", "second")).alias("tree"))
    both = cold.unionByName(_hot_cells(has).withColumn("tree", F.col("cell"))).distinct()
    pairs = both.groupBy("cell", "cls").agg(F.collect_set("tree").alias("trees"))
    pairs = saved(pairs, shared_dir(has.sparkSession))
    sizes = has.groupBy("cls").agg(F.first("n_shingles").alias("n"))
    members = pairs.groupBy("cell").agg(F.count("*").alias("rows"))
    cells = members.join(sizes.toDF("cell", "cell_n"), "cell")
    return keyed_join(pairs.join(sizes, "cls"), cells, "cell", "rows", members)


def size_band(n: str) -> F.Column:
    """BANDS bands to a factor of 4/3: the bands of sets that link are at most BANDS + 1 apart."""
    return F.floor(F.log(F.col(n)) * (BANDS / math.log(DENOMINATOR / NUMERATOR))).cast("int")


def _chains(member: DataFrame) -> DataFrame:
    """(tree, band, n, chain, parts) of the members (tree, cls, band, component) that may link with one of another component.

    A tree falls into chains of bands: classes of two chains differ too much in size.
    n is the number of classes in the band, parts that of the chain's parts.
    """
    bands = member.groupBy("tree", "band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n"))
    by, chain = Window.partitionBy("tree").orderBy("band"), Window.partitionBy("tree", "chain")
    starts = F.coalesce((F.col("band") - F.lag("band").over(by) > BANDS + 1).cast("int"), F.lit(0))
    chains = bands.withColumn("starts", starts).withColumn("chain", F.sum("starts").over(by))
    chains = chains.withColumns({"least": F.min("c0").over(chain), "largest": F.max("c1").over(chain), "parts": F.ceil(F.sum("n").over(chain) / CELL).cast("int")})
    return chains.where("least < largest").select("tree", "band", "n", "chain", "parts")


def linked(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, cls, root and component_id of every row of docs (doc_id, text), and its column ``row`` as row if one is named.

    root is the same class for all rows of a component, null for rows without words.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    feats = saved(features(docs, frequent_shingles(docs), row), f"{folder}/features")
    clashes = _clashes(feats)
    feats = _renamed(feats, clashes)
    has = feats.where("cls is not null")
    cells = saved(_cells(has), f"{folder}/cells")

    members = cells.select("cls").union(cells.select("cell")).distinct()
    in_cells = has.select("cls", "doc_id", "text_hash", "n_shingles", "fine").join(members, "cls", "left_semi")
    points = in_cells.groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("doc"), F.first("n_shingles").alias("n_shingles"), F.first("fine").alias("fine"))
    points = saved(points.select("cls", "doc.*", "n_shingles", "fine"), f"{folder}/points")
    own = saved(feats.select("doc_id", "n_shingles", "cls", *(["row"] if row else [])), f"{folder}/classes")
    dropped(spark, f"{folder}/features")

    def star(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs (cell, cls, cell_n, n) of a cell's smallest class and another."""
        near = saved(_bounded(pairs.select("cell", "cls", "cell_n", "n").toDF("a", "b", "na", "nb"), points, f"{folder}/{name}"), f"{folder}/{name}")
        return saved(_verified(docs, near, points, clashes, f"{folder}/{name}"), f"{folder}/{name}-links")

    firsts = cells.groupBy("cls", "n").agg(F.min(F.struct("cell", "cell_n")).alias("x")).select("x.*", "cls", "n")
    links = star(firsts, "near")
    found = saved(components(links, f"{folder}/first"), f"{folder}/joined")
    of = lambda column: found.toDF(column, f"{column}_in")
    apart = cells.join(of("cls"), "cls", "left").join(of("cell"), "cell", "left")
    apart = apart.where(F.coalesce("cls_in", "cls") != F.coalesce("cell_in", "cell"))
    links = links.unionByName(star(saved(apart.select("cell", "cls", "cell_n", "n"), f"{folder}/apart"), "far"))
    found = components(links, f"{folder}/second")

    # pairs with the smallest class are settled, so it stays out of its trees, and so do the classes that share no shingle with a third
    member = cells.select(F.explode("trees").alias("tree"), "cls", size_band("n").alias("band")).join(found.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    member = saved(member, f"{folder}/members")
    open_ = saved(_chains(member), f"{folder}/open")
    dealt = keyed_join(member, open_, ["tree", "band"], "n").withColumn("cell", F.xxhash64("tree", "chain"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cell", "cls"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") > F.col("other")).cast("int").alias("side"), "cls", "component")
    dealt = saved(dealt, f"{folder}/dealt")

    def searched(dealt: DataFrame, every: bool, name: str) -> DataFrame:
        rows = dealt.join(points.select("cls", "n_shingles", "fine"), "cls").select("cell", "i", "j", "side", "cls", "component", "n_shingles", "fine")
        rows = rows.repartition(spread(spark), "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "side")
        return saved(_tree_pairs(rows, every), f"{folder}/{name}")

    def met(pairs: DataFrame, name: str) -> DataFrame:
        return saved(_verified(docs, pairs.select("a", "b").distinct(), points, clashes, f"{folder}/{name}"), f"{folder}/{name}-links")

    best = searched(dealt, False, "best")
    links = saved(links.unionByName(met(best, "best")), f"{folder}/most")
    if best.where("more").limit(1).count():
        # where two components that have further pairs are still apart, all pairs of their task are verified
        found = saved(components(links, f"{folder}/third"), f"{folder}/known")
        of = lambda column: found.toDF(column, f"{column}_in")
        left = best.where("more").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b"))
        left = saved(left.select("cell", "i", "j").distinct(), f"{folder}/left")
        if left.limit(1).count():
            again = dealt.join(left, ["cell", "i", "j"], "left_semi").join(of("cls"), "cls", "left").withColumn("component", F.coalesce("cls_in", "cls"))
            again = saved(again, f"{folder}/again")
            small = again.count() <= BROADCAST_ROWS // 10
            links = links.unionByName(met(searched(F.broadcast(again) if small else again, True, "rest"), "rest"))
    links = saved(links, f"{folder}/all")
    stars = [star + part for star in ("near", "far") for part in ("", "-sized", "-firsts", "-partners", "-links")]
    for name in (*stars, "joined", "apart", "members", "cells", "best", "best-partners", "best-links", "most", "known", "left", "dealt", "again", "rest", "rest-partners", "rest-links", "points", "open"):
        dropped(spark, f"{folder}/{name}")

    found = components(links, f"{folder}/last").toDF("cls", "root")
    classes = own.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n"))
    classes = saved(classes.join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls")), f"{folder}/roots")
    roots = classes.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_classes"))
    named = saved(keyed_join(classes.drop("least_id"), roots, "root", "n_classes").select("cls", "root", "component_id", "n"), f"{folder}/named")
    linked_rows = keyed_join(own.where("cls is not null"), named, "cls", "n")
    alone = own.where("cls is null").withColumns({"root": F.lit(None).cast("long"), "component_id": F.col("doc_id")})
    return linked_rows.select(alone.columns).unionByName(alone)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each component one row stays, that of the smallest doc_id (null last).

    Of rows that repeat that doc_id the first stays, as they are stored.  Rows
    without words all stay.
    """
    spark = docs.sparkSession
    row = free_name(docs, "row_no")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), f"{shared_dir(spark)}/rows")
    found = linked(rows, row).where("root is not null").select("row", "root", "doc_id")
    found = saved(found, f"{shared_dir(spark)}/found")
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("kept")).select(F.col("kept.row").alias("row"))
    copies = found.join(kept, "row", "left_anti").select(F.col("row").alias(row))
    return rows.join(copies, row, "left_anti").drop(row)
