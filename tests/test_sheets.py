"""Readers of sheets, id lists and parts of a matrix."""

import pytest

from lociflow.operators import samples
from lociflow.sources import readers


def test_parts_of_a_matrix(spark, tmp_path):
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\n"
    (tmp_path / "a.vcf").write_text(head + "".join(f"{c}\t{p}\trs{p}\tA\tG\t.\t.\t.\tLRR\t{p}.0\t{p}.25\t{p}.5\n" for c, p in (("1", 1), ("2", 2), ("X", 3), ("1", 4))))
    path = str(tmp_path / "a.vcf")
    assert [(r["pos"], list(r["lrr"])) for r in readers.vcf(spark, path, ["1", "Z", "1"], [2, 0]).orderBy("pos").collect()] == [(1, [1.5, 1.0]), (4, [4.5, 4.0])]
    (tmp_path / "a.bim").write_text("1\trs4\t0\t4\tA\tG\n2 rs2 0 2 A G\n")
    ids = readers.bim_ids(spark, str(tmp_path / "a.bim"))
    assert sorted(r["pos"] for r in readers.selected(readers.vcf(spark, path), ids).collect()) == [2, 4]


def test_sections_of_a_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text('[Header]\nInvestigator,x\n\n[Data]\nSample_ID,Sample_Group,Gender\n1,A,M\n2,B,"F, maybe"\n3,A,F\n4,,F\n[Other]\n5,C,M\n')
    got = {r["sample"]: (r["Sample_ID"], r["Gender"]) for r in readers.sectioned(spark, str(tmp_path / "s.csv")).collect()}
    assert got == {"A": ("3", "F"), "B": ("2", "F, maybe")}
    (tmp_path / "t.csv").write_text("id,v\nA,1\nA,2\n")
    assert [tuple(r) for r in readers.sectioned(spark, str(tmp_path / "t.csv")).collect()] == [("A", "A", "2")]
    with pytest.raises(ValueError):
        readers.sectioned(spark, str(tmp_path / "s.csv"), "Missing")


def test_sex_and_exclusions_of_a_sheet(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("Sample_ID\tcall_rate\tlrr_sd\texcluded_het_outlier\tcomputed_gender\tf_sex\nA\t.99\t.1\ttrue\tU\t0.61\nB\t.99\t.1\tno\tf\t0.9\nC\t.99\t.1\t\t\t0.5\nD\t.99\t.1\t0\t\t0.4\n")
    sheet = readers.sample_sheet(spark, str(tmp_path / "c.tsv"))
    assert {r["sample"]: (r["sex"], r["sex_source"]) for r in sheet.collect()} == {"A": (1, "f_sex"), "B": (2, "computed_gender"), "C": (None, None), "D": (2, "f_sex")}
    assert {r["source"]: r["n"] for r in samples.sex_sources(sheet).collect()} == {"f_sex": 2, "computed_gender": 1}
    assert {r["sample"]: (list(r["reasons"]), r["in_grm"]) for r in samples.exclusions(sheet).collect()}["A"] == (["het_outlier"], False)


def test_merged_sheets_and_number_columns(spark):
    a = spark.createDataFrame([("A", "1"), ("B", "x")], "sample string, v string")
    b = spark.createDataFrame([("A", "7", "z")], "sample string, V string, w string")
    out = readers.joined_sheets(a, b)
    assert out.columns == ["sample", "v", "V_illumina", "w"] and out.orderBy("sample").collect()[0]["V_illumina"] == "7"
    t = spark.createDataFrame([("1", "a", ""), ("2", "3", None), ("na", "4", " "), ("4", "5", ""), ("5.5", "6", "")], "x string, y string, z string")
    assert readers.numeric_columns(t) == ["x", "y", "z"] and readers.numeric_columns(t, 0.9) == ["z"]


def test_last_phenotype_and_first_qc_hold(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("sample_id\ty\nA\t1\nB\t2\nA\t3\n")
    assert {r["sample_id"]: r["phenotype"] for r in readers.phenotypes(spark, str(tmp_path / "p.tsv")).collect()} == {"A": 3.0, "B": 2.0}
    head = "\t".join(["variant_id", *(readers.QC_COLUMNS[f] for f in (*readers.QC_NEEDED, "chrx_hwe_pass"))])
    (tmp_path / "q.tsv").write_text(f"{head}\nv\t1\t1\t1\tNA\nv\t0\t0\t0\t1\nw\t1\t0\t1\tTrue\n")
    assert {r["variant_id"]: (r["hwe_pass"], r["chrx_hwe_pass"], r["qc_pass"]) for r in readers.variant_qc(spark, str(tmp_path / "q.tsv")).collect()} == {"v": (True, None, None), "w": (False, True, None)}
    (tmp_path / "none.tsv").write_text(head + "\n")
    with pytest.raises(ValueError):
        readers.variant_qc(spark, str(tmp_path / "none.tsv"))


def test_strict_and_lenient_association_tables(spark, tmp_path):
    head = "\t".join("chrom pos variant_id beta se stat p_value n_samples method".split())
    (tmp_path / "good.tsv").write_text(f"{head}\n1\t5\tv\t.5\t1\t2\t0.5\t9\tols\n")
    (tmp_path / "bad.tsv").write_text(f"{head}\n1\tx\tv\t.5\t1\t2\t0.5\t9\tols\n")
    assert readers.association_strict(spark, str(tmp_path / "good.tsv")).first()["pos"] == 5
    with pytest.raises(Exception, match="(?i)malformed|parse|failfast"):
        readers.association_strict(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "more.tsv").write_text(f"{head}\tnote\n1\t5\tv\tbad\t1\t2\t0.5\t9\tols\thello\n")
    row = readers.association_records(spark, str(tmp_path / "more.tsv")).first()
    assert (row["beta"], row["note"]) == (None, "hello")
