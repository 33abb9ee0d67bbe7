"""The BCF source and sink: round trips, splits, seeks by contig, fewer fields, and what a failed task leaves."""

import os
import struct

import numpy as np
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from lociflow.sources import bcf, readers

CONTIGS = ["chr1", "chr2", "chrX", "chrEmpty"]
SAMPLES = [f"s{i}" for i in range(7)]
KINDS = "chrom string, pos long, variant_id string, ref string, alts array<string>, intensity_only boolean, lrr array<double>, dosage array<double>"


def records(n=3000):
    rng = np.random.default_rng(5)
    out = []
    for i in range(n):
        lrr = [None if x < -1 else float(np.float32(x)) for x in rng.normal(0, 1, len(SAMPLES))]
        dosage = [None if d == 3 else float(d) for d in rng.integers(0, 4, len(SAMPLES))]
        out.append((CONTIGS[i % 3], int(rng.integers(1, 200_000_000)), None if i % 5 == 0 else f"rs{i}", "ACGT"[i % 4] * (1 + i % 20), ["T", "<DEL>"][: i % 3], i % 7 == 0, lrr, dosage))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('bcf')}/calls.bcf"
    rows = records()
    bcf.write(spark.createDataFrame(rows, KINDS).repartition(5), path, CONTIGS, SAMPLES, "a test", "k=2", 6)
    return path, rows


def plain(df):
    names = [c.split(" ")[0] for c in KINDS.split(", ")]
    return sorted([tuple(r[c] for c in names) for r in df.collect()], key=str)


def named(rows):
    """The rows as they read back: an id of their own where they have none."""
    return sorted([(c, p, v or f"{c}:{p}:{r}:{':'.join(a)}", r, a, o, x, d) for c, p, v, r, a, o, x, d in rows], key=str)


def test_round_trip_in_one_and_in_many_splits(spark, written):
    path, rows = written
    assert bcf.samples(path) == SAMPLES and sorted(os.listdir(os.path.dirname(path))) == ["calls.bcf", "calls.bcf.csi"]
    for split in (1 << 26, 20_000):
        out = bcf.bcf(spark, path, split_bytes=split)
        assert plain(out) == named(rows)
    bare = path.replace("calls", "bare")
    with open(path, "rb") as a, open(bare, "wb") as b:
        b.write(a.read())
    for split in (1 << 26, 30_000, 3_000):  # without an index the splits find their first records
        out = bcf.bcf(spark, bare, split_bytes=split)
        assert plain(out) == named(rows)
    assert out.rdd.getNumPartitions() > 20


def test_contigs_by_index_read_their_bytes_only(spark, written, monkeypatch):
    path, rows = written
    for contigs in (["chr2"], ["chrX", "chr1"], ["chrEmpty"], ["none"], []):
        assert plain(bcf.bcf(spark, path, contigs=contigs, split_bytes=20_000)) == named([r for r in rows if r[0] in contigs])
    reader = lambda **o: bcf._Reader(spark.createDataFrame([], "chrom string").schema, {"path": path, **o})
    size = lambda splits: sum((s.end << 16 | s.end_within) - (s.start << 16 | s.within) for s in splits)
    one, every = size(reader(contigs="chr2").partitions()), size(reader().partitions())
    assert 0 < one < every / 2.5
    # every first record of an indexed split is read without a search
    assert all(s.within is not None for s in reader(splitbytes="20000").partitions())


def test_fewer_columns_decode_no_samples(spark, written, monkeypatch):
    path, rows = written
    out = bcf.bcf(spark, path, ["chrom", "pos", "intensity_only"])
    assert out.columns == ["chrom", "pos", "intensity_only"] and "lrr" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == sorted((r[0], r[1], r[5]) for r in rows)
    few = bcf.bcf(spark, path, ["variant_id", "lrr"], numbers=[4, 0])
    assert sorted([(r["variant_id"], r["lrr"]) for r in few.collect()], key=str) == sorted([(v, [x[4], x[0]]) for _, _, v, _, _, _, x, _ in named(rows)], key=str)
    assert {tuple(r["lrr"]) for r in bcf.bcf(spark, path, numbers=[]).collect()} == {()}
    fields = bcf.Records(bcf.Header.read(path), ["pos"], None)
    monkeypatch.setattr(fields, "_by_sample", None)
    with fs.LocalFileSystem().open_input_file(path) as source:
        header = bcf.Header.read(path)
        got = [fields.decode(*r) for r in bcf._records(source, bcf.Split(path, header.start[0], os.path.getsize(path), header.start[1]), fields)]
    assert len(got) == len(rows)


def test_intensity_only_records_and_other_contigs_end_before_their_samples(spark, written, monkeypatch):
    path, rows = written
    assert plain(bcf.bcf(spark, path, drop_intensity_only=True, contigs=["chr1"])) == named([r for r in rows if not r[5] and r[0] == "chr1"])
    header = bcf.Header.read(path)
    fields, seen = bcf.Records(header, ["lrr"], None, ["chrX"], True), []
    monkeypatch.setattr(fields, "_by_sample", lambda *a: seen.append(1) or {})
    with fs.LocalFileSystem().open_input_file(path) as source:
        got = [fields.decode(*r) for r in bcf._records(source, bcf.Split(path, header.start[0], os.path.getsize(path), header.start[1]), fields)]
    assert len(got) == len(rows) and len(seen) == sum(r is not None for r in got) == sum(r[0] == "chrX" and not r[5] for r in rows)


def test_records_come_in_order_of_contig_and_position(spark, written):
    path, rows = written
    with fs.LocalFileSystem().open_input_file(path) as source:
        header = bcf.Header.read(path)
        fields = bcf.Records(header, ["pos"], None)
        got = [fields.decode(*r) for r in bcf._records(source, bcf.Split(path, header.start[0], os.path.getsize(path), header.start[1]), fields)]
    keys = [(CONTIGS.index(r["chrom"]), r["pos"]) for r in got]
    assert keys == sorted(keys)


def test_equals_the_text_reader_on_the_same_records(spark, written, tmp_path):
    _, rows = written
    cell = lambda x, d: f"{'.' if x is None else repr(x)}:{'./.' if d is None else ['0/0', '0/1', '1/1'][int(d)]}"
    lines = [f"{c}\t{p}\t{v or '.'}\t{r}\t{','.join(a) or '.'}\t.\tPASS\t{'INTENSITY_ONLY' if o else '.'}\tLRR:GT\t" + "\t".join(map(cell, x, d)) for c, p, v, r, a, o, x, d in rows]
    path = tmp_path / "calls.vcf"
    path.write_text("##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *SAMPLES]) + "\n" + "\n".join(lines) + "\n")
    assert plain(readers.vcf(spark, str(path))) == plain(bcf.bcf(spark, written[0]))


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([r if i != 900 else (*r[:6], [1.0], r[7]) for i, r in enumerate(records(1000))], KINDS).repartition(4)
    with pytest.raises(Exception, match="1 values for 7 samples"):
        bcf.write(rows, f"{tmp_path}/calls.bcf", CONTIGS, SAMPLES)
    assert os.listdir(tmp_path) == []
    good = spark.createDataFrame(records(10), KINDS)
    bcf.write(good, f"{tmp_path}/calls.bcf", CONTIGS, SAMPLES)
    with pytest.raises(Exception, match="is there already"):
        bcf.write(good, f"{tmp_path}/calls.bcf", CONTIGS, SAMPLES)
    assert sorted(os.listdir(tmp_path)) == ["calls.bcf", "calls.bcf.csi"]
    bcf.write(good.where("false"), f"{tmp_path}/none.bcf", CONTIGS, SAMPLES)
    assert bcf.bcf(spark, f"{tmp_path}/none.bcf").collect() == [] and bcf.samples(f"{tmp_path}/none.bcf") == SAMPLES


def test_numbers_of_the_header_and_odd_genotypes():
    contigs, samples, names = bcf.Header.parsed('##FILTER=<ID=PASS,Description="x">\n##INFO=<ID=A,Number=1>\n##FORMAT=<ID=LRR,Number=1>\n##INFO=<ID=B,IDX=9>\n##contig=<ID=c1>\n##contig=<ID=c2,length=5>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\n')
    assert (contigs, samples, names) == (["c1", "c2"], ["x", "y"], {0: "PASS", 1: "A", 2: "LRR", 9: "B"})
    fields = bcf.Records(bcf.Header(["c"], ["a", "b", "c", "d"], {0: "PASS", 3: "GT"}, (0, 0)), ["dosage"], None)
    # 0|1, a haploid 1, ./1 and 1/2, three places each
    gt = struct.pack("12b", 2, 5, -127, 4, -127, -127, 0, 4, -127, 4, 6, -127)
    out = fields._by_sample(bcf._int(3) + bcf._typed(1, 3) + gt, 1, 4)["dosage"]
    assert out[0] == 1 and np.isnan(out[1]) and np.isnan(out[2]) and out[3] == 3


def test_a_broken_file_is_refused(spark, written, tmp_path):
    with open(written[0], "rb") as source:
        data = source.read()
    (tmp_path / "cut.bcf").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="broken|BGZF|incomplete|truncated"):
        bcf.bcf(spark, f"{tmp_path}/cut.bcf").collect()


def test_a_store_by_contig_is_pruned(spark, written, tmp_path):
    kept = bcf.store(bcf.bcf(spark, written[0], ["chrom", "pos", "lrr"]), f"{tmp_path}/store", 8)
    own = kept.where(F.col("chrom").isin("chrX"))
    assert own.count() == sum(r[0] == "chrX" for r in written[1])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chrom" in plan and "(1 paths)" in plan
    read = {r["f"] for r in own.select(F.col("_metadata.file_path").alias("f")).collect()}
    assert read and all("chrom=chrX" in f for f in read)


def test_parts_send_no_sums(spark, tmp_path, monkeypatch):
    """What a task sends to the driver has no value by sample; with metrics the sums are files beside the parts."""
    import pyarrow as pa
    import pyspark

    monkeypatch.setattr(bcf, "MEASURED", 3)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    names = [f"s{i}" for i in range(2000)]
    x = np.random.default_rng(1).normal(size=(3, 2000)).astype("<f4").astype(float)
    batch = pa.RecordBatch.from_pydict({"chrom": ["chr1"] * 3, "pos": [1, 2, 3], "variant_id": ["a", "b", "c"], "ref": ["A"] * 3, "alts": [["C"]] * 3, "lrr": x.tolist()})
    schema = spark.createDataFrame([], "chrom string, pos long, variant_id string, ref string, alts array<string>, lrr array<double>").schema
    for told in ({}, {"metrics": f"{tmp_path}/m.tsv"}):
        w = bcf._Writer(schema, {"path": f"{tmp_path}/x{len(told)}.bcf", "contigs": "chr1", "samples": ",".join(names), **told}, False)
        part = w.write(iter([batch]))
        assert not isinstance(part.sums, bytes) and len(str(part)) < 2000
        w.commit([part])
    lines = [line.split("\t") for line in open(f"{tmp_path}/m.tsv").read().splitlines()[1:]]
    assert [r[0] for r in lines] == names and np.allclose([float(r[1]) for r in lines], x.std(axis=0)) and {r[2] for r in lines} == {"1.0"}
