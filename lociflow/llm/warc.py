"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole WARC/1.1
records up to about ``FRAME_BYTES``, and then a skippable frame with the seek
table of the Zstandard seekable format (compressed and decompressed size of
each frame).  An index row for each record gives its bundle, frame, offset in
the decompressed frame and length, so that one record costs one frame.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with
the smallest page_id is a response and the others are revisits of it, by
SHA-256 digest; shorter payloads are always responses.

Null html is an empty payload; a null url an empty target.  Rows that repeat the
smallest page_id are all responses; rows with a null page_id are revisits if
another row has the payload, responses if none has.  An empty table makes no
bundle.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_join, saved, shared_dir, spread

FRAME_BYTES = 256 * 1024
LEAST_REVISIT = 100
LEVEL = 3
BROADCAST_GROUPS = 500_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, path string, frame int, frame_at long, frame_bytes long, offset long, length long"
_INDEX_PA = pa.schema([("page_id", pa.int64()), ("path", pa.string()), ("frame", pa.int32()), ("frame_at", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, whole boolean"
_RECORD_PA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("whole", pa.bool_())])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with its block."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record; names in lower case."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


class BundleWriter:
    """Writes records to a bundle; holds one frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.open: list[bytes] = []
        self.size, self.at = 0, 0
        self.frames: list[tuple[int, int]] = []

    def add(self, data: bytes) -> tuple[int, int, int]:
        """(frame, offset, length) of the record."""
        if self.open and self.size + len(data) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size, len(data)
        self.open.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.zstd.compress(b"".join(self.open))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.at += len(frame)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, decompressed size) of each frame, from the bundle's footer."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    source.seek(size - 9 - 8 * n)
    flat = struct.unpack(f"<{2 * n}I", source.read(8 * n))
    out, at = [], 0
    for packed, full in zip(flat[::2], flat[1::2], strict=True):
        out.append((at, packed, full))
        at += packed
    return out


def read_record(uri: str, path: str, frame: int, offset: int, length: int) -> bytes:
    """One record by its index row."""
    import zstandard

    store, _ = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as source:
        at, packed, full = seek_table(source, store.get_file_info(path).size)[frame]
        source.seek(at)
        return zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=full)[offset : offset + length]


def with_revisits(pages: DataFrame, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, first_id, revisit) of pages (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digest, n_bytes = F.sha2(payload, 256), F.octet_length(payload).cast("long")
    firsts = pages.select("page_id", digest.alias("digest"), n_bytes.alias("n")).where(F.col("n") >= LEAST_REVISIT)
    groups = firsts.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("group_rows")).where("group_rows > 1")
    # short payloads have no group, so each has a key of its own and none gathers them
    key = F.when(n_bytes >= LEAST_REVISIT, digest).otherwise(F.xxhash64("page_id").cast("string"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), digest.alias("digest"), n_bytes.alias("n_bytes"), key.alias("group"))
    groups = saved(groups.withColumnRenamed("digest", "group"), f"{shared_dir(pages.sparkSession)}/groups")
    rows = rows.join(F.broadcast(groups), "group", "left") if groups.count() <= broadcast_groups else keyed_join(rows, groups, "group", "group_rows", how="left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.withColumn("revisit", revisit).withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))


def write_bundles(pages: DataFrame, uri: str) -> DataFrame:
    """Write every page as a record below uri and return the index.

    A task's file has a new name at each attempt; the index, written by Spark's
    committer, names the files of the attempts that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, places = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    store, base = fs.FileSystem.from_uri(uri)
                    store.create_dir(base, recursive=True)
                    path = f"{base}/bundle-{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path, compression=None)
                    writer = BundleWriter(out)
                data = record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["n_bytes"], row["first_id"], row["revisit"])
                places.append((row["page_id"], *writer.add(data)))
        if writer is not None:
            writer.close()
            out.close()
            at = [0]
            for size, _ in writer.frames:
                at.append(at[-1] + size)
            for i in range(0, len(places), 10_000):
                part = [{"page_id": p, "path": path, "frame": f, "frame_at": at[f], "frame_bytes": writer.frames[f][0], "offset": o, "length": n} for p, f, o, n in places[i : i + 10_000]]
                yield pa.RecordBatch.from_pylist(part, schema=_INDEX_PA)

    rows = with_revisits(pages).select("page_id", "url", "payload", "digest", "n_bytes", "first_id", "revisit")
    return saved(rows.mapInArrow(write, INDEX), f"{uri}/index")


def read_bundles(index: DataFrame, uri: str) -> DataFrame:
    """What the records say: page_id, payload_bytes, payload_digest, record_type, refers_to, and whole (digest and size hold for the stored payload).

    Each task reads one frame at a time by its place in the bundle.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, _ = fs.FileSystem.from_uri(uri)
        unzip, source, frame, data = zstandard.ZstdDecompressor(), None, None, b""
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if (r["path"], r["frame"]) != frame:
                    if frame is None or r["path"] != frame[0]:
                        source = store.open_input_file(r["path"])
                    source.seek(r["frame_at"])
                    data, frame = unzip.decompress(source.read(r["frame_bytes"])), (r["path"], r["frame"])
                warc, http, payload = parsed(data[r["offset"] : r["offset"] + r["length"]])
                digest, n, revisit = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), warc["warc-type"] == "revisit"
                whole = revisit or hashlib.sha256(payload).hexdigest() == digest and len(payload) == n
                ids = [int(x) if x else None for x in (warc["x-page-id"], warc.get("x-refers-to-page-id", ""))]
                rows.append({"page_id": ids[0], "payload_bytes": n if revisit else len(payload), "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": ids[1], "whole": whole})
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD_PA)

    spark = index.sparkSession
    return index.repartition(spread(spark), "path").sortWithinPartitions("path", "frame", "offset").mapInArrow(read, RECORD)


def archived(pages: DataFrame, uri: str | None = None) -> DataFrame:
    """Write pages to bundles and return their records as read back."""
    uri = uri or shared_dir(pages.sparkSession)
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file:///" + uri.removeprefix("file:/").lstrip("/")
    return read_bundles(write_bundles(pages, uri), uri)
