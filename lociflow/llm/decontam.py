"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is found in a document if at least ``least`` (0.75) of the item's
distinct five-word shingles are in the document; words and shingles are those of
``textvec``.  Items are partitioned by size, in classes of doubling shingle
counts.  Each class keeps, for each of its items, the ``sketch`` (16) shingles of
smallest hash, its MinHash sample: the share of the sample that a document holds
estimates the containment of the item in it, however long the document is.  A
document is checked only against the classes whose smallest item it could hold
(n >= least * size), and an item is a candidate from one hit on; a contained
item is missed with a chance of at most 0.25**16, and never if it has no more
shingles than the sample.  Every candidate is verified by exact containment:
the shingle hashes are counted, and those that pass are compared word by word.

The items are a stated query set: they are read in blocks of at most
``BLOCK_ITEMS`` items of at most ``BLOCK_SHINGLES`` shingles, and each block is
sent to the tasks that scan the documents.  No document is shuffled.

Items with fewer than five words have one shingle, their whole sequence; it can
only be found in a document that is that sequence.  Items without words, null
texts and empty documents match nothing.  Repeated items and rows each give
their own pairs; null ids are kept as they are.  Extra columns pass through
``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textvec import mixed, shingle_hashes, slices, word_hashes, words

LEAST = (3, 4)
SKETCH = 16
WIDTH = 5
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 4_000_000
PAIRS = "doc_id long, item_id long, item_shingles long, shared long, containment double"


def exact_shingles(text: str, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    w = text.encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class ItemBlock:
    """Shingles, samples and size classes of a block of items."""

    def __init__(self, ids: list[int | None], texts: list[str]):
        self.ids, self.texts, self.sets = ids, texts, []
        for _, data, offsets in slices(pa.array(texts, pa.large_string())):
            low, starts, ends, at = words(data, offsets)
            h, out = shingle_hashes(word_hashes(low, starts, ends), at, WIDTH)
            self.sets += [np.unique(h[a:b]) for a, b in zip(out[:-1], out[1:], strict=True)]
        size = np.array([len(s) for s in self.sets])
        self.classes = []
        for c in sorted({int(n).bit_length() for n in size if n}):
            mine = [i for i, n in enumerate(size) if n and int(n).bit_length() == c]
            sample = [(h, i) for i in mine for h in self.sets[i][np.argsort(mixed(self.sets[i]))[:SKETCH]]]
            hashes = np.array([h for h, _ in sample], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.classes.append((int(min(size[i] for i in mine)), hashes[order], np.array([i for _, i in sample])[order]))

    def candidates(self, shingles: np.ndarray, doc_of: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(document, item) with a sampled shingle in common; sizes bound the documents' distinct shingles from above."""
        for least, hashes, items in self.classes:
            # one table probe drops almost all shingles before the search
            table = np.zeros(1 << 16, bool)
            table[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
            at = np.flatnonzero(table[(shingles & np.uint64(0xFFFF)).astype(np.int64)] & (LEAST[1] * sizes[doc_of] >= LEAST[0] * least))
            first = np.searchsorted(hashes, shingles[at], side="left")
            last = np.searchsorted(hashes, shingles[at], side="right")
            n = last - first
            docs = np.repeat(doc_of[at], n)
            hit = items[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            yield from sorted(set(zip(docs.tolist(), hit.tolist(), strict=True)))

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, shared shingles, item shingles) of every contained item of every row."""
        for row, data, offsets in slices(column):
            low, starts, ends, at = words(data, offsets)
            h, out = shingle_hashes(word_hashes(low, starts, ends), at, WIDTH)
            sizes = np.diff(out)
            seen: dict[int, np.ndarray] = {}
            text: dict[int, set] = {}
            for d, i in self.candidates(h, np.repeat(np.arange(len(sizes)), sizes), sizes):
                if d not in seen:
                    seen[d] = np.unique(h[out[d] : out[d + 1]])
                if LEAST[1] * np.isin(self.sets[i], seen[d]).sum() >= LEAST[0] * len(self.sets[i]):
                    if d not in text:
                        text[d] = exact_shingles(column[row + d].as_py())
                    mine = exact_shingles(self.texts[i])
                    shared = len(mine & text[d])
                    if LEAST[1] * shared >= LEAST[0] * len(mine):
                        yield row + d, i, shared, len(mine)


def item_blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """The items (item_id, text), block after block, from an iterator that holds one partition."""
    ids, texts, size = [], [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        n = len(r["text"] or "") // 4
        if ids and (len(ids) >= BLOCK_ITEMS or size + n > BLOCK_SHINGLES):
            yield ItemBlock(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r["item_id"])
        texts.append(r["text"] or "")
        size += n
    if ids:
        yield ItemBlock(ids, texts)


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair of a document (doc_id, text) and an item (item_id, text) that it contains."""
    spark = docs.sparkSession
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            b = sent.value
            for batch in batches:
                ids = batch.column(0)
                rows = [(ids[r].as_py(), b.ids[i], n, s, s / n) for r, i, s, n in b.matches(batch.column(1))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()], strict=True)], names=["doc_id", "item_id", "item_shingles", "shared", "containment"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(search, PAIRS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item, all columns as they are."""
    spark, schema = docs.sparkSession, docs.schema
    at = docs.columns.index("text")
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in sent.value.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs
