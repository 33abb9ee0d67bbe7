"""Token ids as fixed-width bit-packed shard files with random access.

A shard file holds the ids of a run of documents, each id in the fewest bits
that the vocabulary allows.  Layout, little-endian:

    packed ids: blocks of block_ids ids, each padded to a whole byte
    block offsets: n_blocks + 1 u64, bytes from the start of the file
    documents: n_docs records (doc_id i64, first id u64)
    place of the block offsets u64, bits u32, block_ids u32,
    n_ids u64, n_docs u64, n_blocks u64, magic "LFTOKEN1"

Any id range is read by seeking to its blocks, which numpy unpacks whole.

Null text counts as empty: such a document holds the end id alone.  Repeated
ids and rows are written as they come, ordered by (doc_id, text); rows with a
null doc_id come first, as doc_id ``null``.  An empty table makes no file.
"""

from __future__ import annotations

import gc
import io
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, shared_dir, spread

MAGIC = b"LFTOKEN1"
TAIL = struct.Struct("<QIIQQQ8s")
DOC = np.dtype([("doc_id", "<i8"), ("first", "<u8")])
NO_ID = -(1 << 63)
BLOCK_IDS = 1 << 16
CACHE_CHUNKS = 350_000
CACHE_PIECES = 450_000
# fixed values: the pre-token pattern of byte-level BPE, and the characters that stand for bytes
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LEVEL = dict(zip([b for b in range(256) if b not in _SHOWN], range(256, 512)))
MANIFEST = "path string, part long, n_ids long, n_docs long, first_doc long"


def bits_for(vocabulary: int) -> int:
    """Bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    """ids, bits each, first id in the lowest bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits)
    return (flat.reshape(n, bits).astype("<u4") << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype="<u4")


class ShardWriter:
    """Writes one shard file; holds one block of ids and 16 bytes a document."""

    def __init__(self, out: io.RawIOBase, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.at, self.n_ids = 0, 0
        self.rest: list[np.ndarray] = []
        self.n_rest = 0
        self.blocks: list[int] = [0]
        self.docs: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((NO_ID if doc_id is None else doc_id, self.n_ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= self.block_ids:
            flat = np.concatenate(self.rest)
            whole = len(flat) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(flat[i : i + self.block_ids])
            self.rest, self.n_rest = [flat[whole:]], len(flat) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.at += self.out.write(packed(ids, self.bits))
        self.blocks.append(self.at)

    def close(self) -> None:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(np.array(self.docs, DOC).tobytes())
        self.out.write(TAIL.pack(self.at, self.bits, self.block_ids, self.n_ids, len(self.docs), len(self.blocks) - 1, MAGIC))


class ShardReader:
    """Reads id ranges of a shard file."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - TAIL.size)
        place, self.bits, self.block_ids, self.n_ids, n_docs, n_blocks, magic = TAIL.unpack(source.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(place)
        self.blocks = np.frombuffer(source.read(8 * (n_blocks + 1)), "<u8")
        self.docs = np.frombuffer(source.read(DOC.itemsize * n_docs), DOC)

    def ids(self, first: int, end: int) -> np.ndarray:
        """The ids first .. end - 1."""
        if first >= end:
            return np.zeros(0, "<u4")
        a, b = first // self.block_ids, (end - 1) // self.block_ids
        self.source.seek(int(self.blocks[a]))
        data = self.source.read(int(self.blocks[b + 1] - self.blocks[a]))
        parts, base = [], int(self.blocks[a])
        for k in range(a, b + 1):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            parts.append(unpacked(data[int(self.blocks[k]) - base : int(self.blocks[k + 1]) - base], self.bits, n))
        return np.concatenate(parts)[first - a * self.block_ids : end - a * self.block_ids]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every document, in file order; reads about at_once ids at a time."""
        firsts = np.append(self.docs["first"], self.n_ids).astype(np.int64)
        i = 0
        while i < len(self.docs):
            j = max(i + 1, int(np.searchsorted(firsts, firsts[i] + at_once, side="right")) - 1)
            ids = self.ids(int(firsts[i]), int(firsts[j]))
            for k in range(i, j):
                doc = int(self.docs["doc_id"][k])
                yield (None if doc == NO_ID else doc), ids[firsts[k] - firsts[i] : firsts[k + 1] - firsts[i]]
            i = j


class _Whole(Exception):
    """The text has white space that only the whole text's pre-tokens show."""


class _Pieces(dict):
    """Ids of pre-tokens, from the library's BPE model."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        out = array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()
        if len(self) < CACHE_PIECES:  # what is frequent comes early
            self[piece] = out
        return out


class _Chunks(dict):
    """Ids of what stands between single spaces, the space before it included."""

    def __init__(self, pieces: _Pieces, pattern):
        self.pieces, self.pattern = pieces, pattern

    def encoded(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[-1].isspace():
            raise _Whole
        if chunk.isalpha():
            out = self.pieces[" " + chunk]
        elif chunk[-1] in ",.;:!?" and chunk[:-1].isalpha():
            out = self.pieces[" " + chunk[:-1]] + self.pieces[chunk[-1]]
        else:
            out = self.encoded(" " + chunk)
        if len(self) < CACHE_CHUNKS:
            self[chunk] = out
        return out


_encoders: dict[str, Encoder] = {}


class Encoder:
    """Whole-text ids by a byte-level BPE file of the tokenizers library, with bounded tables of what was seen.

    The usual splitting pattern never joins anything across a single space that
    follows a character other than white space, so the chunks between such spaces,
    and within them the pattern's pre-tokens, are encoded apart, each once as long
    as the table holds it.  A text with any other white space before a space goes
    through the library whole, and so does one that contains an added token, which
    has an id of its own, and every text for another kind of file.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        parts = json.loads(self.tokenizer.to_str())
        splits = parts["pre_tokenizer"] or {}
        self.by_chunk = parts["model"]["type"] == "BPE" and parts["normalizer"] is None and splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
        added = sorted((t["content"] for t in parts["added_tokens"] if t["content"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.chunks = _Chunks(_Pieces(self.tokenizer.model), regex.compile(PATTERN))

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder of this worker, whose tables last from task to task."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        first, *chunks = text.split(" ")
        if not self.by_chunk or not first or first[-1].isspace() or self.added and self.added.search(text):
            return self._whole(text)
        try:
            return np.frombuffer(self.chunks.encoded(first) + b"".join(map(self.chunks.__getitem__, chunks)), "<u4")
        except _Whole:
            return self._whole(text)


def _open_out(uri: str, part: int):
    store, base = fs.FileSystem.from_uri(uri)
    store.create_dir(base, recursive=True)
    name = f"{base}/shard-{part:06d}-{uuid.uuid4().hex}.bin"
    return name, store.open_output_stream(name, compression=None)


def write_shards(df: DataFrame, uri: str, tokenizer_path: str, end_id: int = 0, order: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Encode (doc_id, text), write shards in the order of these columns below uri, and return the manifest.

    Each task names its file anew, so a repeated attempt never touches the file of
    another; the manifest, itself written by Spark's committer, lists the files of
    the attempts that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, writer, encoder, first = TaskContext.get().partitionId(), None, None, None
        gc.disable()  # the tables are millions of strings and hold no cycles
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc_id in enumerate(ids):
                if writer is None:
                    encoder = Encoder.of(tokenizer_path)
                    name, out = _open_out(uri, part)
                    writer, first = ShardWriter(out, bits_for(encoder.vocabulary)), doc_id
                writer.add(doc_id, np.append(encoder.encode(texts[i].as_py()), np.uint32(end_id)))
        gc.enable()
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist(
                [{"path": name, "part": part, "n_ids": writer.n_ids, "n_docs": len(writer.docs), "first_doc": first}],
                schema=pa.schema([("path", pa.string()), ("part", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("first_doc", pa.int64())]),
            )

    n = spread(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in order if c not in ("doc_id", "text")])
    ranges = [c for c in order if c != "text"]
    ordered = rows.repartitionByRange(n, *ranges).sortWithinPartitions(*order).select("doc_id", "text")
    return saved(ordered.mapInArrow(write, MANIFEST), f"{uri}/manifest")


def read_shards(manifest: DataFrame, uri: str) -> DataFrame:
    """Digest of every document in the files: doc_id, start, n_tokens, ids_crc32.

    A document's start counts all ids before it.  Shards are in the order of their parts; their
    own starts come from a running sum over the manifest, one row a file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                size = store.get_file_info(row["path"]).size
                with store.open_input_file(row["path"]) as source:
                    reader, start, rows = ShardReader(source, size), row["base"], []
                    for doc_id, ids in reader.documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield digest(rows)
                            rows = []
                    if rows:
                        yield digest(rows)

    def digest(rows: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "start", "n_tokens", "ids_crc32")
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=list(names))

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return placed.repartition(spread(manifest.sparkSession), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_shards(df: DataFrame, tokenizer_path: str, end_id: int = 0, uri: str | None = None, order: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, str]:
    """Write df's shards and return (manifest, their folder)."""
    uri = uri or shared_dir(df.sparkSession)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:/").lstrip("/")
    return write_shards(df, uri, tokenizer_path, end_id, order), uri


def digests(spark: SparkSession, df: DataFrame, tokenizer_path: str, order: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    manifest, uri = encode_to_shards(df, tokenizer_path, order=order)
    return read_shards(manifest, uri)
