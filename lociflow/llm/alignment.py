"""Cross-tokenizer alignment: which ids of tokenizer A and tokenizer B stand for the same bytes.

Both encode a text with one space before it (B adds the space itself).  Where an A
token and a B token end at the same byte a group ends; an A and a B token whose
byte ranges overlap are a link.  An id pair's count is the number of links of all
documents that hold it; a B id's best pairs are those of the highest count.

    encode   texts are encoded in tasks; a chunk of documents becomes one row for each stripe of B
             ids, with its id pairs (cells), their links, and the documents of each cell
    count    cells meet by stripe: np.add.at puts them into the stripe's dense matrix (the stripe's B ids x
             all A ids), and its row maxima give the best pairs
    score    each stripe's counts meet the links of the same stripe, a bounded number of chunks at a time;
             what a document has from one group of stripes is added up before it moves on

A cell goes on once a chunk, so an id pair that holds a third of all links is as
many rows as there are chunks.  Memory is bounded by a chunk (CHUNK_DOCS documents
or about CHUNK_LINKS links, or one longer text), a stripe's matrix, and the sums of
SALT_CHUNKS chunks.

Null and empty texts, and texts that the token bytes do not give back, have no
tokens: zeros and an empty groups_sha256.  Repeated rows and ids are each counted
and returned, a null doc_id stays null, an empty table gives an empty result, and
other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved, shared_dir, spread
from .token_ids import _BYTE_LEVEL, PATTERN

STRIPES, GROUPS = 1024, 32
CHUNK_DOCS, CHUNK_LINKS, SALT_CHUNKS = 2048, 3_000_000, 256
BATCH_BYTES = 1 << 20
CACHE_WORDS = 400_000
SPACE = "▁"

NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
LINKS = "chunk long, stripe int, cells binary, totals binary, sizes binary, docs binary, times binary, doc_ids array<long>, " + ", ".join(f"{c} array<long>" for c in NUMBERS) + ", hashes array<string>"
COUNTS = "stripe int, cells binary, counts binary, best binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_PART = pa.schema([("chunk", pa.int64()), ("best", pa.binary()), ("sums", pa.binary())])


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split(" ") for c in ddl.split(", "))])


class _Words(dict):
    """Ids of the words seen so far, up to CACHE_WORDS of them; the others of a batch stand in ``rest`` while it lasts."""

    def __init__(self):
        super().__init__()
        self.rest: dict[str, bytes | None] = {}

    def __missing__(self, word: str) -> bytes | None:
        return self.rest[word]

    def learn(self, found: dict[str, bytes | None]) -> None:
        self.rest = found
        room = max(0, CACHE_WORDS - len(self))
        self.update(found if len(found) <= room else islice(found.items(), room))


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text.

    A file of the usual splitting pattern whose ids are in the order of its merges is
    the same thing as a table of ranks, which tiktoken encodes faster.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        shown = {chr(c): b for b, c in _BYTE_LEVEL.items()} | {chr(b): b for b in range(256) if b not in _BYTE_LEVEL}
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        found = {i: t.encode() if t in added else bytes(shown[c] for c in t) for t, i in self.tokenizer.get_vocab().items()}
        self.bytes = [found.get(i, b"") for i in range(max(found) + 1)]
        parts = json.loads(self.tokenizer.to_str())
        model, splits = parts["model"], parts["pre_tokenizer"] or {}
        usual = model["type"] == "BPE" and parts["normalizer"] is None and splits.get("type") == "ByteLevel" and not splits.get("add_prefix_space") and splits.get("use_regex", True)
        ranked = usual and all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(model["merges"])) and not model.get("ignore_merges")
        self.by_word = bool(ranked)
        if ranked:
            import tiktoken

            ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
            self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.by_word else self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece model, which adds a space before a text."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        about = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as source:
            about.ParseFromString(source.read())
        rules = about.normalizer_spec
        plain = rules.name == "identity" and not rules.precompiled_charsmap and not rules.normalization_rule_tsv and rules.add_dummy_prefix and not rules.remove_extra_whitespaces and rules.escape_whitespaces
        own = any(p.type == about.SentencePiece.USER_DEFINED for p in about.pieces)
        self.by_word = plain and not own and not any(SPACE in p.lstrip(SPACE) for p in pieces)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


class Pair:
    """Two tokenizers of one worker, with the byte length of every id.

    Words between single spaces are encoded apart, each once as long as the tables
    hold it: neither tokenizer joins anything across such a space.  Texts with other
    white space before a space go through both whole, and so do all texts if a piece
    of B has a space inside or B changes texts before it encodes them.
    """

    _made: dict[tuple[str, str], Pair] = {}

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.by_word = self.a.by_word and self.b.by_word
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in x.bytes], np.int64) for x in (self.a, self.b))
        self.text_a, self.text_b = _decimals(len(self.a.bytes)), _decimals(len(self.b.bytes))
        self.words_a, self.words_b = _Words(), _Words()

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Pair:
        """The pair of this worker, whose tables last from task to task."""
        if (path_a, path_b) not in cls._made:
            cls._made[path_a, path_b] = cls(path_a, path_b)
        return cls._made[path_a, path_b]

    def _learn(self, texts: list[list[str]]) -> None:
        """Encode the words of a batch that are not known; one that both do not give back byte by byte has no ids of B."""
        new = [w for w in set().union(*texts) if w and not w[-1].isspace() and w not in self.words_a]
        a, b = {}, {}
        for word, ids in zip(new, self.b.model.encode(new, num_threads=1) if new else (), strict=True):
            spaced = " " + word
            a[word] = array("i", self.a.ids(spaced)).tobytes()
            b[word] = array("i", ids).tobytes() if b"".join([self.b.bytes[i] for i in ids]) == spaced.encode() else None
        self.words_a.learn(a)
        self.words_b.learn(b)

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a, b, wanted = self.a.ids(" " + text), self.b.ids(text), b" " + text.encode()
        same = all(b"".join([x.bytes[i] for i in ids]) == wanted for x, ids in ((self.a, a), (self.b, b)))
        return (np.array(a, "<i4"), np.array(b, "<i4")) if same else None

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's and B's ids of each text, or None for a text without tokens."""
        split = [t.split(" ") if t and self.by_word else None for t in texts]
        self._learn([s for s in split if s])
        out = []
        for text, words in zip(texts, split, strict=True):
            got = None
            if words:
                try:
                    got = tuple(np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for known in (self.words_a, self.words_b))
                except (KeyError, TypeError):  # other white space before a space, or a word that B does not give back
                    got = self._whole(text)
            elif text:
                got = self._whole(text)
            out.append(got)
        return out


def _decimals(n: int) -> np.ndarray:
    """The decimal digits of 0 .. n - 1 as rows of bytes, zeros before them, and a last byte for what follows."""
    width = len(str(n))
    digits = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + ord("0")
    digits[np.arange(n)[:, None] < 10 ** np.arange(width - 1, -1, -1)] = 0
    digits[:1, -1] = ord("0")
    return np.hstack([digits, np.zeros((n, 1), int)]).astype(np.uint8)


class Aligned:
    """The links and groups of a run of documents, whose tokens are laid end to end."""

    def __init__(self, pair: Pair, found: list[tuple[np.ndarray, np.ndarray]]):
        self.pair = pair
        self.a, self.b = (np.concatenate([f[k] for f in found]).astype(np.int64) for k in (0, 1))
        self.n_a, self.n_b = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 1))
        self.end_a, self.end_b = np.cumsum(pair.lengths_a[self.a]), np.cumsum(pair.lengths_b[self.b])
        # a group ends where both end; the two lists have the same last byte
        self.last_a = self.end_b[np.searchsorted(self.end_b, self.end_a)] == self.end_a
        self.last_b = self.end_a[np.searchsorted(self.end_a, self.end_b)] == self.end_b
        self.doc_a = np.repeat(np.arange(len(found)), self.n_a)
        self.n_groups = np.bincount(self.doc_a, self.last_a, len(found)).astype(np.int64)
        self.n_links = self.n_a + self.n_b - self.n_groups

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, A id, B id) of every link: each stretch between two neighbouring ends lies in one token of each side."""
        ends = np.sort(np.concatenate([self.end_a, self.end_b[~self.last_b]]), kind="stable")
        i, j = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        return self.doc_a[i], self.a[i], self.b[j]

    def hashes(self) -> list[str]:
        """SHA-256 of each document's groups as a text."""
        before_a, before_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        upto_a, upto_b = (np.concatenate([[0], np.flatnonzero(last) + 1]) for last in (self.last_a, self.last_b))
        place_a = np.arange(len(self.a)) + upto_b[before_a]
        place_b = np.arange(len(self.b)) + upto_a[before_b + 1]
        width = max(self.pair.text_a.shape[1], self.pair.text_b.shape[1])
        cells = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        for table, ids, place, last, sign in ((self.pair.text_a, self.a, place_a, self.last_a, "|"), (self.pair.text_b, self.b, place_b, self.last_b, ";")):
            cells[place, width - table.shape[1] :] = table[ids]
            cells[place, -1] = np.where(last, ord(sign), ord(","))
        full = cells != 0
        text, lengths = cells[full].tobytes(), np.concatenate([[0], np.cumsum(full.sum(axis=1))])
        cut = lengths[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(text[s : e - 1]).hexdigest() for s, e in zip(cut[:-1], cut[1:], strict=True)]


class _Chunk:
    """Documents on their way to the stripes."""

    def __init__(self, number: int):
        self.number, self.docs, self.n_links = number, [], 0
        self.links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows(self, n_a: int, n_b: int, stripes: int) -> Iterator[pa.RecordBatch]:
        schema = _arrow(LINKS)
        names = ("doc_ids", *NUMBERS, "hashes")
        about = dict(zip(names, zip(*self.docs, strict=True), strict=True))
        yield pa.RecordBatch.from_pylist([{"chunk": self.number} | {k: list(v) for k, v in about.items()}], schema=schema)
        if not self.n_links:
            return
        doc, a, b = (np.concatenate(x) for x in zip(*self.links, strict=True))
        high = -(-n_b // stripes)
        code = np.sort((((b % stripes * high + b // stripes) * n_a + a) << 16) | doc)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        times, code = np.diff(first, append=len(code)), code[first]
        cell, doc = code >> 16, (code & 0xFFFF).astype("<u2")
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        sizes, totals, cells = np.diff(at, append=len(cell)), np.add.reduceat(times, at), cell[at]
        stripe, place = cells // (high * n_a), cells % (high * n_a)
        starts = np.flatnonzero(np.diff(stripe, prepend=-1))
        out = []
        for s, e in zip(starts, np.append(starts[1:], len(cells)), strict=True):
            x, y = at[s], at[e] if e < len(at) else len(doc)
            most = times[x:y].max()
            out.append({
                "chunk": self.number, "stripe": int(stripe[s]), "cells": place[s:e].astype("<u4").tobytes(), "totals": totals[s:e].astype("<i8").tobytes(),
                "sizes": sizes[s:e].astype("<u2").tobytes(), "docs": doc[x:y].tobytes(), "times": times[x:y].astype("<u1" if most < 256 else "<u4").tobytes(),
            })
        for k in range(0, len(out), 500):
            yield pa.RecordBatch.from_pylist(out[k : k + 500], schema=schema)


def encoded(docs: DataFrame, path_a: str, path_b: str, stripes: int = STRIPES) -> DataFrame:
    """Chunks of documents (stripe null) and their links, a row for each chunk and stripe of B ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, chunk = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            pair = Pair.of(path_a, path_b)
            n_a, n_b = len(pair.a.bytes), len(pair.b.bytes)
            for ids, texts in _runs(batch):
                found = pair.encode(texts)
                full = [f for f in found if f is not None]
                at = {k: i for i, k in enumerate(k for k, f in enumerate(found) if f is not None)}
                if full:
                    run = Aligned(pair, full)
                    hashes, (doc, a, b) = run.hashes(), run.links()
                    cut = np.concatenate([[0], np.cumsum(run.n_links)])
                for k, doc_id in enumerate(ids):
                    chunk = chunk or _Chunk(base + made)
                    if k in at:
                        i, n = at[k], len(chunk.docs)
                        s, e = cut[i], cut[i + 1]
                        chunk.links.append((doc[s:e] * 0 + n, a[s:e], b[s:e]))
                        chunk.n_links += int(e - s)
                        chunk.docs.append((doc_id, int(run.n_a[i]), int(run.n_b[i]), int(run.n_groups[i]), int(run.n_links[i]), hashes[i]))
                    else:
                        chunk.docs.append((doc_id, 0, 0, 0, 0, ""))
                    if len(chunk.docs) >= CHUNK_DOCS or chunk.n_links >= CHUNK_LINKS:
                        yield from chunk.rows(n_a, n_b, stripes)
                        chunk, made = None, made + 1
        if chunk is not None:
            yield from chunk.rows(n_a, n_b, stripes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(encode, LINKS)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], list[str | None]]]:
    """(ids, texts) of about BATCH_BYTES of text at a time; a longer text is a run of its own."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        value = text.as_py()
        n = len(value or "")
        if ids and size + n > BATCH_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(doc_id)
        texts.append(value)
        size += n
    if ids:
        yield ids, texts


def counted(links: DataFrame, n_a: int, n_b: int, stripes: int = STRIPES) -> DataFrame:
    """The counts of all id pairs by stripe, and whether each is a best pair of its B id."""
    high = -(-n_b // stripes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stripe = np.zeros((high, n_a), np.int64), None

        def done() -> pa.RecordBatch:
            flat = block.ravel()
            cells = np.flatnonzero(flat)
            best = flat[cells] == block.max(axis=1)[cells // n_a]
            row = {"stripe": stripe, "cells": cells.astype("<u4").tobytes(), "counts": flat[cells].astype("<i8").tobytes(), "best": best.astype(np.uint8).tobytes()}
            flat[cells] = 0
            return pa.RecordBatch.from_pylist([row], schema=_arrow(COUNTS))

        for batch in batches:
            for number, cells, totals in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if stripe is not None and number != stripe:
                    yield done()
                stripe = number
                np.add.at(block.reshape(-1), np.frombuffer(cells, "<u4"), np.frombuffer(totals, "<i8"))
        if stripe is not None:
            yield done()

    cells = links.where("stripe is not null").select("stripe", "cells", "totals")
    return cells.repartition(spread(links.sparkSession), "stripe").sortWithinPartitions("stripe").mapInArrow(count, COUNTS)


def scored(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(chunk, best, sums): what the documents of a chunk have from one group of stripes."""
    salts = max(1, -(-links.where("stripe is null").count() // SALT_CHUNKS))
    none = F.lit(None).cast("binary")
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")
    mine = links.where("stripe is not null").select(F.col("chunk"), salt.alias("salt"), "stripe", "cells", "sizes", "docs", "times", none.alias("counts"), none.alias("best"))
    told = counts.select(F.lit(-1).cast("long").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "stripe", "cells", *[none.alias(c) for c in ("sizes", "docs", "times")], "counts", "best")
    rows = told.unionByName(mine).withColumn("part", F.col("stripe") % GROUPS)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sums = None, {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"chunk": k, "best": b.tobytes(), "sums": s.tobytes()} for k, (b, s) in sums.items()], schema=_PART)

        for batch in batches:
            for row in batch.to_pylist():
                if (row["part"], row["salt"]) != here:
                    if sums:
                        yield done()
                    here, sums = (row["part"], row["salt"]), {}
                cells = np.frombuffer(row["cells"], "<u4")
                if row["chunk"] < 0:
                    known, count, best = cells, np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["best"], np.uint8)
                    continue
                at = np.repeat(np.searchsorted(known, cells), np.frombuffer(row["sizes"], "<u2"))
                doc = np.frombuffer(row["docs"], "<u2")
                times = np.frombuffer(row["times"], "<u1" if len(row["times"]) == len(doc) else "<u4").astype(np.int64)
                if row["chunk"] not in sums:
                    sums[row["chunk"]] = np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                mine = sums[row["chunk"]]
                np.add.at(mine[0], doc, times * best[at])
                np.add.at(mine[1], doc, times * count[at])
        if sums:
            yield done()

    n = max(spread(links.sparkSession), GROUPS)
    dealt = rows.repartition(n, "part", "salt").sortWithinPartitions("part", "salt", "stripe", "chunk")
    return dealt.select("part", "salt", "chunk", "cells", "sizes", "docs", "times", "counts", "best").mapInArrow(score, "chunk long, best binary, sums binary")


def _gathered(links: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each document: its own numbers and the sums of its parts."""
    about = links.where("stripe is null").select("chunk", F.lit(0).alias("kind"), "doc_ids", *NUMBERS, "hashes", *[F.lit(None).cast("binary").alias(c) for c in ("best", "sums")])
    kinds = dict(about.dtypes)
    sums = parts.select("chunk", F.lit(1).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in ("doc_ids", *NUMBERS, "hashes")], "best", "sums")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, best, total = None, None, None

        def done() -> pa.RecordBatch:
            n = len(own["doc_ids"])
            columns = [own["doc_ids"], *[own[c] for c in NUMBERS], best[:n], total[:n]]
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(own["hashes"], pa.string())], schema=_arrow(RESULT))

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if own is not None:
                        yield done()
                    own, best, total = row, np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64)
                else:
                    best += np.frombuffer(row["best"], "<i8")
                    total += np.frombuffer(row["sums"], "<i8")
        if own is not None:
            yield done()

    return about.unionByName(sums).repartition(spread(links.sparkSession), "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(gather, RESULT)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    links, counts = _linked(docs, path_a, path_b)
    return _gathered(links, scored(links, counts))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, n_links and best of every id pair with a link."""
    n_a, n_b = _sizes(path_a, path_b)
    _, counts = _linked(docs, path_a, path_b)
    high = -(-n_b // STRIPES)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cells = np.frombuffer(row["cells"], "<u4").astype(np.int64)
                a, b = cells % n_a, cells // n_a % high * STRIPES + row["stripe"]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.frombuffer(row["counts"], "<i8")), pa.array(np.frombuffer(row["best"], np.uint8).astype(bool))], names=["a_id", "b_id", "n_links", "best"])

    return counts.mapInArrow(told, "a_id long, b_id long, n_links long, best boolean")


def _sizes(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path_a).get_vocab().values()) + 1, sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def _linked(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """The stored links and counts."""
    folder = shared_dir(docs.sparkSession)
    links = saved(encoded(docs, path_a, path_b), f"{folder}/links")
    return links, saved(counted(links, *_sizes(path_a, path_b)), f"{folder}/counts")
