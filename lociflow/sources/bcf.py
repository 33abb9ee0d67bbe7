"""Binary variant calls (BCF 2.2 in BGZF blocks) as a Spark source and sink, with CSI indexes.

The source splits files by bytes.  A split starts at its first BGZF block; the first
record in it is the first place from which several records follow one another, all
with the header's number of samples and known contigs.  Where an index lies beside a
file its chunks give exact starts instead, and with ``contigs`` only their bytes are
read.  Only the fields of the schema that is asked for are decoded, so metadata never
touches the samples' values.

The sink writes a part in each task.  On commit the parts, in the order of the
partitions, become one file with one header (or stay a folder of whole files), with an
index; when a task fails nothing stays.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.exprs import chrom_order
from ..session import importable

SCHEMA = "chrom string, pos long, variant_id string, ref string, alts array<string>, qual double, filter array<string>, intensity_only boolean, lrr array<double>, dosage array<double>"
SAMPLE_FIELDS = ("lrr", "dosage")
SPLIT_BYTES, BATCH_CELLS = 64 << 20, 1 << 20
CHAIN = 4
# fixed values: a BGZF block's head, the block that ends a file, missing numbers, and the shape of an index
BLOCK_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_DATA, MEASURED = 0xFF00, 1 << 16
MISSING_FLOAT = b"\x01\x00\x80\x7f"
INTS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 3: np.dtype("<i4")}
MIN_SHIFT, DEPTH = 14, 5
SUMMARY_BIN = ((1 << 3 * (DEPTH + 1)) - 1) // 7 + 1


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def block(data: bytes) -> bytes:
    """One BGZF block."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return BLOCK_HEAD + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


class Blocks:
    """The data of BGZF blocks one after another, from a file place on; ``place(at)`` gives the block that holds a byte."""

    def __init__(self, source, at: int, size: int):
        self.source, self.next, self.size = source, at, size
        self.data, self.base = b"", 0  # what has been read and not been passed, and how much was passed
        self.starts: list[tuple[int, int]] = []  # (first byte, file place) of each block still held

    def more(self) -> bool:
        """Read one block; False at the end of the file."""
        if self.next >= self.size:
            return False
        self.source.seek(self.next)
        head = self.source.read(18)
        if len(head) < 18 or head[:4] != BLOCK_HEAD[:4] or head[12:14] != b"BC":
            raise ValueError("not a BGZF block")
        length = struct.unpack("<H", head[16:18])[0] + 1
        data = zlib.decompress(self.source.read(length - 18)[:-8], -15)
        if data:
            self.starts.append((self.base + len(self.data), self.next))
            self.data += data
        self.next += length
        return True

    def hold(self, n: int) -> bool:
        """Whether n bytes are there, after reading as many blocks as that takes."""
        while len(self.data) < n:
            if not self.more():
                return False
        return True

    def skip(self, n: int) -> None:
        self.data, self.base = self.data[n:], self.base + n

    def place(self) -> tuple[int, int]:
        """(file place of the block, byte within it) of the next byte."""
        while not self.data and self.more():
            pass
        if not self.data:
            return self.next, 0
        while len(self.starts) > 1 and self.starts[1][0] <= self.base:
            self.starts.pop(0)
        first, at = self.starts[0]
        return at, self.base - first


def first_block(source, at: int, size: int) -> int:
    """The place of the first block at or after a place: a head whose block is followed by another, or by the end."""
    source.seek(at)
    window = source.read(min(size - at, 3 << 16))
    k = window.find(BLOCK_HEAD[:4])
    while k >= 0:
        if window[k + 12 : k + 14] == b"BC" and k + 18 <= len(window):
            follows = at + k + struct.unpack("<H", window[k + 16 : k + 18])[0] + 1
            source.seek(follows)
            if follows == size or source.read(4) == BLOCK_HEAD[:4]:
                return at + k
        k = window.find(BLOCK_HEAD[:4], k + 1)
    return size


@dataclass
class Header:
    """What records need of a header: contigs, samples, names by number, and where the records start."""

    contigs: list[str]
    samples: list[str]
    names: dict[int, str]
    start: tuple[int, int]

    @classmethod
    def read(cls, path: str) -> Header:
        store, name = _store(path)
        with store.open_input_file(name) as source:
            blocks = Blocks(source, 0, source.size())
            if not blocks.hold(9) or blocks.data[:3] != b"BCF":
                raise ValueError(f"{path} is no BCF file")
            length = struct.unpack("<I", blocks.data[5:9])[0]
            blocks.hold(9 + length)
            text = blocks.data[9 : 9 + length].rstrip(b"\0").decode()
            blocks.skip(9 + length)
            return cls(*cls.parsed(text), blocks.place())

    @staticmethod
    def parsed(text: str) -> tuple[list[str], list[str], dict[int, str]]:
        contigs, names, samples = {}, {0: "PASS"}, []
        for line in text.split("\n"):
            kind, _, rest = line.partition("=<")
            if kind in ("##contig", "##FILTER", "##INFO", "##FORMAT"):
                fields = dict(p.split("=", 1) for p in rest.rstrip(">\r").split(",") if "=" in p)
                known = contigs if kind == "##contig" else names
                number = int(fields["IDX"]) if "IDX" in fields else next((k for k, v in known.items() if v == fields["ID"]), max(known, default=-1) + 1)
                known[number] = fields["ID"]
            elif line.startswith("#CHROM"):
                samples = line.rstrip("\r").split("\t")[9:]
        return [contigs.get(i, "") for i in range(max(contigs, default=-1) + 1)], samples, names


def _descriptor(data: bytes, at: int) -> tuple[int, int, int]:
    """(kind, number of values, place of the first) of a typed value."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        many, at = _integers(data, at)
        n = int(many[0])
    return kind, n, at


def _integers(data: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, n, at = _descriptor(data, at)
    if kind not in INTS:
        return np.zeros(0, int), at
    size = INTS[kind].itemsize
    return np.frombuffer(data, INTS[kind], n, at), at + n * size


def _text(data: bytes, at: int) -> tuple[str, int]:
    kind, n, at = _descriptor(data, at)
    n = n if kind == 7 else 0
    return data[at : at + n].rstrip(b"\0").decode(), at + n


def _width(kind: int) -> int:
    return {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}[kind]


class Records:
    """Decodes the fields that are asked for of one record; those of other contigs, and intensity-only ones if they are to go, end before their samples."""

    def __init__(self, header: Header, fields: list[str], samples: list[int] | None, contigs: list[str] | None = None, drop: bool = False):
        self.header, self.fields, self.samples, self.drop = header, fields, samples, drop
        self.by_sample = [f for f in fields if f in SAMPLE_FIELDS]
        self.with_info = drop or "intensity_only" in fields
        self.wanted = None if contigs is None else {i for i, c in enumerate(header.contigs) if c in contigs}

    def sound(self, data: bytes, at: int) -> int:
        """The length of the record at a place, or 0 if there can be none."""
        shared, own, chrom, pos, _ = struct.unpack_from("<IIiii", data, at)
        n_sample = struct.unpack_from("<I", data, at + 28)[0] & 0xFFFFFF
        ok = shared >= 24 and shared < 1 << 28 and own < 1 << 31 and 0 <= chrom < len(self.header.contigs) and self.header.contigs[chrom] and pos >= -1 and n_sample == len(self.header.samples)
        return 8 + shared + own if ok else 0

    def decode(self, shared: bytes, own: bytes) -> dict | None:
        chrom, pos, _, _, n_info_allele, n_fmt_sample = struct.unpack_from("<iiiIII", shared)
        if self.wanted is not None and chrom not in self.wanted:
            return None
        n_info, n_allele = n_info_allele & 0xFFFF, n_info_allele >> 16
        vid, at = _text(shared, 24)
        alleles = []
        for _ in range(n_allele):
            allele, at = _text(shared, at)
            alleles.append(allele)
        row = {"chrom": self.header.contigs[chrom], "pos": pos + 1, "ref": alleles[0] if alleles else None, "alts": alleles[1:]}
        row["variant_id"] = vid if vid not in ("", ".") else f"{row['chrom']}:{pos + 1}:{row['ref'] or ''}:{':'.join(row['alts'])}"
        row["qual"] = None if shared[12:16] == MISSING_FLOAT else struct.unpack_from("<f", shared, 12)[0]
        filters, at = _integers(shared, at)
        row["filter"] = [self.header.names.get(int(i), "") for i in filters]
        if self.with_info:
            row["intensity_only"] = False
            for _ in range(n_info):
                key, at = _integers(shared, at)
                kind, n, at = _descriptor(shared, at)
                at += n * _width(kind)
                row["intensity_only"] |= self.header.names.get(int(key[0])) == "INTENSITY_ONLY"
            if self.drop and row["intensity_only"]:
                return None
        if self.by_sample:
            row |= self._by_sample(own, n_fmt_sample >> 24, n_fmt_sample & 0xFFFFFF)
        return row

    def _by_sample(self, own: bytes, n_fields: int, n_samples: int) -> dict:
        out, at = {f: np.full(n_samples, np.nan) for f in self.by_sample}, 0
        for _ in range(n_fields):
            key, at = _integers(own, at)
            kind, n, at = _descriptor(own, at)
            name, size = self.header.names.get(int(key[0])), n * _width(kind) * n_samples
            if name == "LRR" and "lrr" in out and n == 1 and kind in (*INTS, 5):
                x = np.frombuffer(own, "<f4" if kind == 5 else INTS[kind], n_samples, at)
                with np.errstate(invalid="ignore"):  # the missing value is a signalling one
                    x = x.astype(float) if kind == 5 else np.where(x < np.iinfo(x.dtype).min + 8, np.nan, x)
                out["lrr"] = np.where(np.isfinite(x), x, np.nan)
            if name == "GT" and "dosage" in out and n >= 2 and kind in INTS:
                g = np.frombuffer(own, INTS[kind], n * n_samples, at).reshape(n_samples, n).astype(int)
                ends = g == np.iinfo(INTS[kind]).min + 1
                whole = ~ends[:, :2].any(axis=1) & ends[:, 2:].all(axis=1) & (g[:, :2] >> 1 > 0).all(axis=1)
                out["dosage"] = np.where(whole, (g[:, :2] >> 1).sum(axis=1) - 2.0, np.nan)
            at += size
        return out if self.samples is None else {k: v[self.samples] for k, v in out.items()}


@dataclass
class Split(InputPartition):
    """Bytes of a file: from a record's exact place where ``within`` is known, else from the first record of the bytes; up to the block at ``end``."""

    path: str
    start: int
    end: int
    within: int | None = None
    end_within: int = 0


def read_index(path: str) -> list[list[tuple[int, int]]] | None:
    """(first, end) virtual places of the chunks of each contig, in order, from the CSI index beside a file; None without one."""
    store, name = _store(path + ".csi")
    if store.get_file_info(name).type == fs.FileType.NotFound:
        return None
    with store.open_input_file(name) as source:
        blocks = Blocks(source, 0, source.size())
        while blocks.more():
            pass
        data = blocks.data
    if data[:4] != b"CSI\1":
        raise ValueError(f"{path}.csi is no CSI index")
    n_aux = struct.unpack_from("<i", data, 12)[0]
    n_ref, at = struct.unpack_from("<i", data, 16 + n_aux)[0], 20 + n_aux
    out = []
    for _ in range(n_ref):
        n_bins, at, chunks = struct.unpack_from("<i", data, at)[0], at + 4, []
        for _ in range(n_bins):
            number, _, n = struct.unpack_from("<IQi", data, at)
            at += 16
            chunks += [] if number == SUMMARY_BIN else [struct.unpack_from("<QQ", data, at + 16 * k) for k in range(n)]
            at += 16 * n
        out.append(sorted(chunks))
    return out


def apart(chunks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Chunks in order, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for first, end in chunks:
        if out and first < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.fields = schema.fieldNames()
        unknown = set(self.fields) - {c.split(" ")[0] for c in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"a BCF file has no {', '.join(sorted(unknown))}")
        self.path = options["path"]
        self.contigs = options["contigs"].split(",") if options.get("contigs") else None
        self.samples = [int(i) for i in options["samples"].split(",")] if options.get("samples") else None
        self.drop = options.get("dropintensityonly", "false").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def _files(self) -> list[str]:
        store, name = _store(self.path)
        if store.get_file_info(name).type != fs.FileType.Directory:
            return [self.path]
        found = store.get_file_info(fs.FileSelector(name))
        return [f"{self.path.rstrip('/')}/{f.base_name}" for f in sorted(found, key=lambda f: f.base_name) if f.base_name.endswith(".bcf")]

    def partitions(self) -> list[Split]:
        out = []
        for path in self._files():
            store, name = _store(path)
            size, header, index = store.get_file_info(name).size, Header.read(path), read_index(path)
            if index is None:
                at = [header.start[0], *range((header.start[0] // self.split_bytes + 1) * self.split_bytes, size, self.split_bytes), size]
                out += [Split(path, a, b, header.start[1] if k == 0 else None) for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                continue
            for i, chunks in enumerate(index):
                if self.contigs is None or header.contigs[i] in self.contigs:
                    out += self._cut(path, apart(chunks))
        return out or [Split("", 0, 0)]

    def _cut(self, path: str, chunks: list[tuple[int, int]]) -> list[Split]:
        """Neighbouring chunks together, up to about split_bytes."""
        out: list[Split] = []
        for first, end in chunks:
            (a, a_in), (b, b_in) = ((v >> 16, v & 0xFFFF) for v in (first, end))
            last = out[-1] if out else None
            if last and (last.end, last.end_within) == (a, a_in) and b - last.start <= self.split_bytes:
                last.end, last.end_within = b, b_in
            else:
                out.append(Split(path, a, b, a_in, b_in))
        return out

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.path:
            return
        header = Header.read(split.path)
        records, rows = Records(header, self.fields, self.samples, self.contigs, self.drop), []
        width = len(header.samples) if self.samples is None else len(self.samples)
        most = max(1, min(10_000, BATCH_CELLS // max(1, width * len(records.by_sample)))) if records.by_sample else 10_000
        store, name = _store(split.path)
        with store.open_input_file(name) as source:
            for shared, own in _records(source, split, records):
                row = records.decode(shared, own)
                if row is not None:
                    rows.append(row)
                if len(rows) >= most:
                    yield self._batch(rows)
                    rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"chrom": pa.string(), "pos": pa.int64(), "variant_id": pa.string(), "ref": pa.string(), "alts": pa.list_(pa.string()), "qual": pa.float64(), "filter": pa.list_(pa.string()), "intensity_only": pa.bool_()}
        columns = []
        for f in self.fields:
            if f in SAMPLE_FIELDS:
                x = np.stack([r[f] for r in rows])
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * x.shape[1])
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), mask=np.isnan(x.ravel()))))
            else:
                columns.append(pa.array([r[f] for r in rows], kinds[f]))
        return pa.RecordBatch.from_arrays(columns, names=self.fields)


def _records(source, split: Split, records: Records) -> Iterator[tuple[bytes, bytes]]:
    """The shared and the samples' bytes of the records that start in a split."""
    size = source.size()
    blocks = Blocks(source, split.start if split.within is not None else first_block(source, split.start, size), size)
    if split.within is not None:
        blocks.hold(split.within)
        blocks.skip(split.within)
    elif blocks.next >= split.end or not _found(blocks, records):
        return
    while blocks.place() < (split.end, split.end_within):
        if not blocks.hold(32):
            return
        n = records.sound(blocks.data, 0)
        if not n or not blocks.hold(n):
            raise ValueError(f"{split.path} is cut off or broken at block {blocks.place()[0]}")
        shared = struct.unpack_from("<I", blocks.data)[0]
        need = 8 + shared + (n - 8 - shared if records.by_sample else 0)
        yield blocks.data[8 : 8 + shared], blocks.data[8 + shared : need]
        blocks.skip(n)


def _found(blocks: Blocks, records: Records) -> bool:
    """Move to the first record: the first place from which CHAIN records, or all up to the end, follow one another."""
    at = 0
    while blocks.hold(at + 32):
        end, n = at, 0
        while n < CHAIN and blocks.hold(end + 32):
            length = records.sound(blocks.data, end)
            if not length:
                break
            end, n = end + length, n + 1
        if n == CHAIN or n and end == len(blocks.data) and not blocks.hold(end + 1):
            blocks.skip(at)
            return True
        at += 1
    return False


@dataclass
class _Part(WriterCommitMessage):
    number: int
    path: str | None
    bytes: int = 0
    sums: str | None = None  # a file of number, sum and sum of squares of each sample's values, of the diagnostic markers
    n_measured: int = 0
    places: dict | None = None  # contig: bin: [first, end] virtual places from the part's start


def bin_of(start: int, end: int) -> int:
    """The smallest bin of an index that holds positions start .. end - 1, counted from 0."""
    shift, first = MIN_SHIFT, ((1 << 3 * DEPTH) - 1) // 7
    for level in range(DEPTH, 0, -1):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)
        shift, first = shift + 3, first - (1 << 3 * (level - 1))
    return 0


def _typed(kind: int, n: int) -> bytes:
    return bytes([kind | min(n, 15) << 4]) + (b"" if n < 15 else _int(n))


def _int(x: int) -> bytes:
    kind, code = next((k, c) for k, c, top in ((1, "<b", 127), (2, "<h", 32767), (3, "<i", (1 << 31) - 1)) if x <= top)
    return bytes([kind | 16]) + struct.pack(code, x)


def _string(text: str) -> bytes:
    raw = text.encode()
    return _typed(7, len(raw)) + raw


def header_text(contigs: list[str], samples: list[str], source: str = "", provenance: str = "", dosage: bool = False) -> str:
    """The header of a file with LRR (and GT) of these samples."""
    lines = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="All filters passed",IDX=0>', '##INFO=<ID=INTENSITY_ONLY,Number=0,Type=Flag,Description="Marker without genotypes",IDX=1>']
    lines += ['##FORMAT=<ID=LRR,Number=1,Type=Float,Description="Log R ratio",IDX=2>', '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype",IDX=3>']
    lines += [f"##contig=<ID={c},IDX={i}>" for i, c in enumerate(contigs)] + ([f"##source={source}"] if source else []) + ([f"##correction={provenance}"] if provenance else [])
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]) + "\n"


def record(chrom: int, pos: int, variant_id: str | None, ref: str | None, alts: list[str], intensity_only: bool, lrr: np.ndarray | None, dosage: np.ndarray | None) -> bytes:
    """One record; missing values are NaN, a dosage is written as the genotype with that many copies of the first alternative."""
    alleles = [ref or "N", *(alts or [])]
    fields = []
    if lrr is not None:
        x = lrr.astype("<f4")
        raw = x.view("<u4").copy()
        raw[np.isnan(x)] = 0x7F800001
        fields.append(_int(2) + _typed(5, 1) + raw.tobytes())
    if dosage is not None:
        d = np.nan_to_num(dosage, nan=-1).astype(int)
        both = np.stack([d >= 2, d >= 1], axis=1) * 2 + 2
        fields.append(_int(3) + _typed(1, 2) + np.where((d < 0)[:, None], 0, both).astype("<i1").tobytes())
    n = next((len(v) for v in (lrr, dosage) if v is not None), 0)
    head = struct.pack("<iii", chrom, pos - 1, len(alleles[0])) + MISSING_FLOAT + struct.pack("<II", len(alleles) << 16 | bool(intensity_only), len(fields) << 24 | n)
    info = _int(1) + _typed(0, 0) if intensity_only else b""
    shared = head + _string(variant_id or ".") + b"".join(map(_string, alleles)) + _typed(0, 0) + info
    own = b"".join(fields)
    return struct.pack("<II", len(shared), len(own)) + shared + own


class _Writer(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.names, self.path, self.overwrite = schema.fieldNames(), options["path"].rstrip("/"), overwrite
        self.contigs, self.samples = options["contigs"].split(","), [s for s in options.get("samples", "").split(",") if s]
        self.text = header_text(self.contigs, self.samples, options.get("source", ""), options.get("provenance", ""))
        self.metrics = options.get("metrics")
        self.parts = f"{self.path}.parts-{uuid.uuid4().hex}"
        store, target = _store(self.path)
        if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")
        # made once, so that a task that outlives a failed job finds no folder to write to
        store.create_dir(_store(self.parts)[1], recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Part:
        from pyspark import TaskContext

        number, numbers = TaskContext.get().partitionId(), {c: i for i, c in enumerate(self.contigs)}
        out, name, at, data, places = None, None, 0, bytearray(), {}
        sums, measured = np.zeros((3, len(self.samples) if self.metrics else 0)), 0
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(self.names)}
            plain = {n: c.to_pylist() for n, c in columns.items() if n not in SAMPLE_FIELDS}
            for k in range(batch.num_rows):
                get = lambda n: plain[n][k] if n in plain else None  # noqa: B023, E731
                values = lambda n: None if n not in columns else np.array(columns[n][k].values.to_numpy(zero_copy_only=False), float)  # noqa: B023, E731
                if get("chrom") not in numbers:
                    raise ValueError(f"the header has no contig {get('chrom')}")
                lrr, dosage = values("lrr"), values("dosage")
                for v in (lrr, dosage):
                    if v is not None and len(v) != len(self.samples):
                        raise ValueError(f"a record has {len(v)} values for {len(self.samples)} samples")
                if self.metrics and lrr is not None and get("diagnostic") is not False:
                    x = lrr.astype("<f4").astype(float)
                    known = np.isfinite(x)
                    x[~known] = 0
                    sums += np.stack([known, x, x * x])
                    measured += 1
                chrom, pos, ref = numbers[get("chrom")], get("pos"), get("ref")
                if out is None:
                    name = f"{self.parts}/{number:06d}-{uuid.uuid4().hex}"
                    out = _store(name)[0].open_output_stream(_store(name)[1], compression=None)
                first = at << 16 | len(data)
                data += record(chrom, pos, get("variant_id"), ref, get("alts"), get("intensity_only"), lrr, dosage)
                while len(data) >= BLOCK_DATA:
                    packed = block(bytes(data[:BLOCK_DATA]))
                    out.write(packed)
                    at += len(packed)
                    del data[:BLOCK_DATA]
                bins = places.setdefault(chrom, {})
                chunk = bins.setdefault(bin_of(pos - 1, pos - 1 + len(ref or "N")), [])
                if chunk and chunk[-1][1] == first:
                    chunk[-1][1] = at << 16 | len(data)
                else:
                    chunk.append([first, at << 16 | len(data)])
        if out is None:
            return _Part(number, None)
        if data:
            packed = block(bytes(data))
            out.write(packed)
        out.close()
        if measured:
            with _store(name)[0].open_output_stream(_store(name)[1] + ".sums", compression=None) as told:
                told.write(sums.tobytes())
        return _Part(number, name, at + (len(packed) if data else 0), name + ".sums" if measured else None, measured, places)

    def commit(self, messages: list[_Part | None]) -> None:
        """Join the parts behind one header; bytes are passed on a few MB at a time, and nothing is decoded again."""
        parts = sorted((m for m in messages if m is not None and m.path), key=lambda m: m.number)
        store, target = _store(self.path)
        raw = self.text.encode() + b"\0"
        raw = b"BCF\2\2" + struct.pack("<I", len(raw)) + raw
        head = b"".join(block(raw[i : i + BLOCK_DATA]) for i in range(0, len(raw), BLOCK_DATA))
        joined, starts = f"{self.parts}-joined", []
        with store.open_output_stream(_store(joined)[1], compression=None) as out:
            out.write(head)
            at = len(head)
            for part in parts:
                starts.append(at)
                with store.open_input_stream(_store(part.path)[1], compression=None) as source:
                    while piece := source.read(8 << 20):
                        out.write(piece)
                at += part.bytes
            out.write(END_BLOCK)
        store.move(_store(joined)[1], target)
        with store.open_output_stream(_store(self.path + ".csi")[1], compression=None) as out:
            index = write_index(len(self.contigs), [(s, p.places) for s, p in zip(starts, parts, strict=True)])
            for i in range(0, len(index), BLOCK_DATA):
                out.write(block(index[i : i + BLOCK_DATA]))
            out.write(END_BLOCK)
        if self.metrics:
            self._measure(parts)
        self.abort(messages)

    def _measure(self, parts: list[_Part]) -> None:
        """SD (population) and call rate of each sample over what the tasks have added up and left beside their parts, so many samples at a time."""
        markers, width = sum(p.n_measured for p in parts), len(self.samples)
        with _store(self.metrics)[0].open_output_stream(_store(self.metrics)[1], compression=None) as out:
            out.write(b"SAMPLE\tLRR_SD\tcallrate\tn_markers_used\n")
            for first in range(0, width, MEASURED):
                names = self.samples[first : first + MEASURED]
                sums = np.zeros((3, len(names)))
                for p in (p for p in parts if p.sums):
                    with _store(p.sums)[0].open_input_file(_store(p.sums)[1]) as source:
                        for row in range(3):
                            source.seek(8 * (row * width + first))
                            sums[row] += np.frombuffer(source.read(8 * len(names)))
                lines = [f"{name}\t{max(s / c - (t / c) ** 2, 0) ** 0.5 if c else ''}\t{c / max(markers, 1)}\t{markers}" for name, c, t, s in zip(names, *sums, strict=True)]
                out.write(("\n".join(lines) + "\n").encode())

    def abort(self, messages: list[_Part | None]) -> None:
        """Delete the parts, those of attempts that failed included."""
        store, base = _store(self.parts)
        if store.get_file_info(base).type != fs.FileType.NotFound:
            store.delete_dir(base)


def write_index(n_contigs: int, parts: list[tuple[int, dict]]) -> bytes:
    """The CSI index of parts that start at these file places."""
    out = b"CSI\1" + struct.pack("<iii", MIN_SHIFT, DEPTH, 0) + struct.pack("<i", n_contigs)
    for contig in range(n_contigs):
        bins: dict[int, list[tuple[int, int]]] = {}
        for start, places in parts:
            for number, chunks in (places or {}).get(contig, {}).items():
                bins.setdefault(number, []).extend((a + (start << 16), b + (start << 16)) for a, b in chunks)
        out += struct.pack("<i", len(bins))
        for number, chunks in sorted(bins.items()):
            out += struct.pack("<IQi", number, chunks[0][0], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
    return out + struct.pack("<Q", 0)


class BcfSource(DataSource):
    """``spark.read.format("bcf")`` and ``df.write.format("bcf")``.

    Reading: contigs and samples (numbers) as comma-separated options, splitBytes and dropIntensityOnly; a
    schema of fewer columns decodes fewer fields.  Writing: contigs, samples (names),
    source and provenance as options.
    """

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, overwrite)


def _registered(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(BcfSource)


def samples(path: str) -> list[str]:
    """The sample names of a file, from its header alone."""
    return Header.read(path).samples


def bcf(spark: SparkSession, path: str, columns: list[str] | None = None, contigs: list[str] | None = None, numbers: list[int] | None = None, split_bytes: int = SPLIT_BYTES, drop_intensity_only: bool = False) -> DataFrame:
    """The records of a BCF file, or of a folder of them, with the columns of SCHEMA or some of them.

    LRR that is not finite and genotypes that are not diploid and complete are null.
    contigs keeps these only, and reads only their bytes where a file has an index;
    numbers picks samples, in this order.  drop_intensity_only leaves out the markers
    with that flag before their samples are decoded.
    """
    _registered(spark)
    kinds = dict(c.split(" ", 1) for c in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    if contigs == [] or numbers == []:
        empty = spark.createDataFrame([], schema)
        return empty if contigs == [] else bcf(spark, path, [c for c in columns or kinds if c not in SAMPLE_FIELDS], contigs, None, split_bytes, drop_intensity_only).withColumns({c: F.array().cast("array<double>") for c in SAMPLE_FIELDS if c in (columns or kinds)})
    read = spark.read.format("bcf").schema(schema).option("splitBytes", split_bytes).option("dropIntensityOnly", str(drop_intensity_only).lower())
    read = read if contigs is None else read.option("contigs", ",".join(contigs))
    read = read if numbers is None else read.option("samples", ",".join(map(str, numbers)))
    return read.load(path)


def save(rows: DataFrame, path: str, contigs: list[str], samples: list[str], source: str = "", provenance: str = "", metrics: str | None = None) -> None:
    """Write records in the order that they have, which is sorted if they come from a sorted file; metrics names a table of the samples' SD and call rate over the rows that are not ``diagnostic`` false."""
    _registered(rows.sparkSession)
    known = [*(c.split(" ")[0] for c in SCHEMA.split(", ")), "diagnostic"]
    out = rows.select(*[c for c in known if c in rows.columns]).write.format("bcf").mode("append").option("contigs", ",".join(contigs)).option("samples", ",".join(samples))
    out = out if metrics is None else out.option("metrics", metrics)
    out.option("source", source).option("provenance", provenance).save(path)


def write(rows: DataFrame, path: str, contigs: list[str], samples: list[str], source: str = "", provenance: str = "", parts: int = 64) -> None:
    """Write records (chrom, pos, variant_id, ref, alts and what else SCHEMA has) sorted by contig and position as one indexed file."""
    order = F.array_position(F.lit(list(contigs)), F.col("chrom"))
    save(rows.repartitionByRange(parts, order, "pos").sortWithinPartitions(order, "pos"), path, contigs, samples, source, provenance)


def store(records: DataFrame, path: str, parts: int = 64) -> DataFrame:
    """Records as Parquet by contig, each contig cut by position; a filter on chrom reads its folders only."""
    cut = records.repartitionByRange(parts, chrom_order(F.col("chrom")), "chrom", "pos").sortWithinPartitions("chrom", "pos")
    cut.write.mode("errorifexists").partitionBy("chrom").parquet(path)
    return records.sparkSession.read.schema(records.schema).parquet(path)
