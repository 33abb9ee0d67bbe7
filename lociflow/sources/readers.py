"""Readers of the engine's file formats, all as Spark scans of text: nothing passes through the driver but headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import finite, number, sex_code, truth, variant_id

# fixed values: columns of a VCF record before its samples, and of a refGene line; the sheet's columns that tell
# the sex, best first, and the F statistics of X from which a sample is male and up to which it is female; the
# columns of variant QC
VCF_FIXED = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")
SEX_COLUMNS = ("predicted_sex", "computed_gender", "peddy_sex_predicted_sex", "peddy_sex", "f_sex")
LEAST_MALE_F, MOST_FEMALE_F = 0.6, 0.4
QC_COLUMNS = {
    "call_rate_pass": "all_ancestries_call_rate_pass",
    "hwe_pass": "all_ancestries_hwe_pass",
    "maf_pass": "all_ancestries_maf_pass",
    "qc_pass": "all_ancestries_qc_pass",
    "chrx_hwe_pass": "all_ancestries_chrX_female_hwe_pass",
    "chrx_call_rate_pass": "all_ancestries_chrX_call_rate_pass",
}
QC_NEEDED = ("call_rate_pass", "hwe_pass", "maf_pass")
REFGENE = {"chrom": 2, "strand": 3, "start": 4, "end": 5, "name": 1, "name2": 12}


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """The sample names of a VCF, from its #CHROM line; none if it has no such line."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return line["value"].rstrip("\r\n").split("\t")[len(VCF_FIXED) :] if line else []


def _sample_field(field: str) -> Column:
    """One text a sample of a FORMAT field; null where the record does not have it."""
    at = F.array_position(F.split("format", ":"), field)
    return F.transform("samples", lambda s: F.when(at > 0, F.get(F.split(s, ":"), (at - 1).cast("int"))))


def vcf(spark: SparkSession, path: str, contigs: list[str] | None = None, samples: list[int] | None = None, numbered: bool = False) -> DataFrame:
    """chrom, pos, variant_id, ref, alts, intensity_only, lrr (array<double>) and dosage (array<double>) of each record.

    Columns that are not selected are not parsed.  LRR that is not finite and
    genotypes that are not diploid and complete are null.  A dosage is the sum of the
    two allele numbers.  A record whose position is no number is left out.
    contigs keeps the lines of these only, before they are split; samples numbers
    those whose values are read, in this order; numbered adds record, the line's number,
    by which the input order is kept.
    """
    cells = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = numbered_lines(spark, path).withColumnRenamed("line", "record") if numbered else spark.read.text(path)
    lines = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    number = ["record"] if numbered else []
    if contigs is not None:
        lines = lines.where(F.substring_index("value", "\t", 1).isin(sorted(set(contigs))))
    rows = lines.select(*number, cells.alias("c"))
    rows = rows.select(*number, *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(VCF_FIXED)], F.slice("c", len(VCF_FIXED) + 1, F.greatest(F.size("c") - len(VCF_FIXED), F.lit(0))).alias("samples"))
    if samples is not None:
        rows = rows.withColumn("samples", F.transform(F.lit(samples) if samples else F.array().cast("array<int>"), lambda i: F.get("samples", i)))
    alts = F.when(F.col("alt") == ".", F.array().cast("array<string>")).otherwise(F.split("alt", ","))
    pos = F.col("pos").try_cast("long")
    allele = lambda g, i: F.get(F.split(g, r"[/|]"), F.lit(i)).try_cast("double")
    dosage = F.transform(_sample_field("GT"), lambda g: F.when(F.size(F.split(g, r"[/|]")) == 2, allele(g, 0) + allele(g, 1)))
    return rows.where(pos.isNotNull()).select(
        *number,
        "chrom",
        pos.alias("pos"),
        variant_id(F.col("chrom"), pos, F.col("id"), F.col("ref"), alts).alias("variant_id"),
        "ref",
        alts.alias("alts"),
        F.array_contains(F.split("info", ";"), "INTENSITY_ONLY").alias("intensity_only"),
        F.transform(_sample_field("LRR"), lambda v: finite(v.try_cast("double"))).alias("lrr"),
        dosage.alias("dosage"),
    )


def selected(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records whose variant_id is among ids (a column variant_id)."""
    return records.join(ids.select("variant_id").distinct(), "variant_id", "left_semi")


def bim_ids(spark: SparkSession, path: str) -> DataFrame:
    """variant_id of each line of a BIM file, its second column."""
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(cells) >= 2).select(F.get(cells, F.lit(1)).alias("variant_id"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line, its number in the files from 0: the lines of the splits before it (a small table of counts, summed up) and its place within its own."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(splits, ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def _place() -> Column:
    """A line's place in its files: splits are not read in order, so it is its split's and then its own within the split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _at(place: tuple) -> Column:
    """A place that was read, as a value."""
    return F.struct(*[F.lit(v) for v in place]).cast("struct<file: string, block: bigint, line: bigint>")


def sectioned(spark: SparkSession, path: str, section: str = "Data", key: str = "Sample_Group") -> DataFrame:
    """The rows of one section of a comma-separated sheet, or of a sheet without sections that is tab-separated, every column a text, and sample: the key column, or else the first.

    A file without sections is read whole, by tabs if its header has any.  Of rows with one sample the last holds; rows without one are left out.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", _place().alias("place"))
    heads = sorted((r["place"], r["value"].strip().strip(",")) for r in lines.where(F.trim("value").startswith("[")).collect())
    mine = [k for k, (_, name) in enumerate(heads) if name.lower() == f"[{section}]".lower()]
    if mine:
        place, ends = heads[mine[0]][0], [h[0] for h in heads[mine[0] + 1 :][:1]]
        lines = lines.where(F.col("place") > _at(place))
        lines = lines.where(F.col("place") < _at(ends[0])) if ends else lines
    elif heads:
        raise ValueError(f"the sheet has no section [{section}]")
    first = lines.orderBy("place").first()
    if first is None:
        raise ValueError("the sheet has no header")
    sep = "\t" if not heads and "\t" in first["value"] else ","
    names = [c.strip() for c in first["value"].rstrip("\r").split(sep)]
    rows = lines.where(F.col("place") > _at(first["place"])).select("place", F.from_csv(F.regexp_replace("value", "\r$", ""), ", ".join(f"`{c}` string" for c in names), {"sep": sep}).alias("row"))
    known = next((c for c in names if c == key), next((c for c in names if c.lower() == key.lower()), names[0]))
    rows = rows.withColumn("sample", F.trim(F.col("row").getField(known))).where("sample is not null and sample != ''")
    return rows.groupBy("sample").agg(F.max_by("row", "place").alias("row")).select("sample", "row.*")


def joined_sheets(left: DataFrame, right: DataFrame, key: str = "sample", suffix: str = "_illumina") -> DataFrame:
    """left with the columns of right by key; those of a name that left has get the suffix."""
    taken = {c.lower() for c in left.columns}
    renamed = right.select(key, *[F.col(c).alias(c + suffix if c.lower() in taken else c) for c in right.columns if c != key])
    return left.join(renamed, key, "left")


def numeric_columns(texts: DataFrame, share: float = 0.8) -> list[str]:
    """The columns of which at least a share of the values that are not empty are numbers; one of nothing but empty values counts too."""
    full = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) != ""
    if not texts.columns:
        return []
    found = texts.agg(*[F.struct(F.count_if(full(c)).alias("n"), F.count_if(full(c) & number(F.col(c)).isNotNull()).alias("k")).alias(f"c{i}") for i, c in enumerate(texts.columns)]).first()
    return [c for i, c in enumerate(texts.columns) if found[i]["k"] >= share * found[i]["n"]]


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header, every column a text."""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=False, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _column(df: DataFrame, *names: str) -> str | None:
    """The column of one of these names; an exact match before one that differs by case."""
    for name in names:
        found = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        if found:
            return found[0]
    return None


def phenotypes(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """sample_id, phenotype and the other columns as doubles; name defaults to the first column after the id."""
    t = delimited(spark, path)
    key = _column(t, "sample_id")
    if key is None:
        raise ValueError("a phenotype file needs a sample_id column")
    others = [c for c in t.columns if c != key]
    if not others:
        raise ValueError("a phenotype file needs a column beside sample_id")
    name = name or others[0]
    # of several lines of a sample the last holds
    last = t.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in t.columns]).alias("_row"), _place().alias("_place")).groupBy("_key").agg(F.max_by("_row", "_place").alias("_row"))
    t = last.select("_row.*")
    return t.select(F.col(key).alias("sample_id"), number(F.col(name)).alias("phenotype"), *[number(F.col(c)).alias(c) for c in others if c != name])


def sample_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A compiled sample sheet with the names and types that the exclusions take; columns that it lacks are null."""
    t = delimited(spark, path)
    text = lambda *names: F.col(c) if (c := _column(t, *names)) else F.lit(None).cast("string")
    f = number(text("f_sex"))
    told = {c: sex_code(text(c)) for c in SEX_COLUMNS[:-1]} | {SEX_COLUMNS[-1]: F.when(f >= LEAST_MALE_F, 1).when(f <= MOST_FEMALE_F, 2)}
    pcs = [c for c in t.columns if c.upper().startswith("PC") and c[2:].isdigit()]
    return t.select(
        text("Sample_ID").alias("sample"),
        *[number(text(c)).alias(c) for c in ("call_rate", "lrr_sd", "baf_sd")],
        F.upper(text("sex_status")).alias("sex_status"),
        number(text("inbreeding_F")).alias("inbreeding_f"),
        truth(text("pre_pca_excluded")).alias("pre_pca"),
        truth(text("excluded_relatedness")).alias("related"),
        truth(text("excluded_het_outlier")).alias("het_outlier"),
        F.coalesce(*told.values()).alias("sex"),
        F.coalesce(*[F.when(v.isNotNull(), F.lit(c)) for c, v in told.items()]).alias("sex_source"),
        *[number(F.col(c)).alias(c) for c in pcs],
    )


def variant_qc(spark: SparkSession, path: str) -> DataFrame:
    """variant_id and the flags of QC_COLUMNS, those that the file lacks null; of an id that comes twice the first line in file order holds.

    A file without variant_id or one of the flags of QC_NEEDED is refused, and so is one without rows.
    """
    t = delimited(spark, path)
    names = {f: _column(t, c) for f, c in QC_COLUMNS.items()}
    lost = [QC_COLUMNS[f] for f in QC_NEEDED if names[f] is None]
    if lost or _column(t, "variant_id") is None:
        raise ValueError(f"a variant QC file needs variant_id and {', '.join(lost or QC_NEEDED)}")
    if t.isEmpty():
        raise ValueError("the variant QC file has no rows")
    flags = [(truth(F.col(c)) if c else F.lit(None).cast("boolean")).alias(f) for f, c in names.items()]
    rows = t.select(F.col(_column(t, "variant_id")).alias("variant_id"), *flags, _place().alias("place"))
    first = rows.groupBy("variant_id").agg(F.min_by(F.struct(*QC_COLUMNS), "place").alias("q"))
    return first.select("variant_id", "q.*")


ASSOCIATION = "chrom string, pos long, variant_id string, beta double, se double, stat double, p_value double, n_samples long, method string"


def association_strict(spark: SparkSession, path: str) -> DataFrame:
    """An association table of exactly these columns; reading a value that is no number fails."""
    return spark.read.csv(path, sep="\t", header=True, schema=ASSOCIATION, mode="FAILFAST", enforceSchema=False)


def association_records(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, variant_id, beta, se, stat, p, n_samples, method of an association table, and its other columns as texts; rows without a position go, other bad numbers are null."""
    t = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    usual = {"chrom", "pos", "variant_id", "beta", "se", "stat", "p_value", "n_samples", "method"}
    out = t.select("chrom", F.col("pos").try_cast("long").alias("pos"), "variant_id", *[finite(number(F.col(c))).alias(c) for c in ("beta", "se", "stat")], finite(number(F.col("p_value"))).alias("p"), F.col("n_samples").try_cast("long").alias("n_samples"), "method", *[c for c in t.columns if c not in usual])
    return out.where("pos is not null")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """The first cell of each line, without a header."""
    cell = F.trim(F.get(F.split("value", "\t"), F.lit(0)))
    return spark.read.text(path).select(cell.alias("sample")).where((F.col("sample") != "") & ~F.lower("sample").isin("sample_id", "sample", "sampleid")).distinct()


def refgene(spark: SparkSession, path: str) -> DataFrame:
    """chrom, symbol, start (1-based), end, strand of each transcript of a refGene file; short lines go."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where((F.size(c) >= 13) & ~F.col("value").startswith("#")).select(*[F.get(c, F.lit(i)).alias(n) for n, i in REFGENE.items()])
    start, end = F.col("start").try_cast("long"), F.col("end").try_cast("long")
    return rows.select("chrom", F.coalesce(F.nullif("name2", F.lit("")), "name").alias("symbol"), (start + 1).alias("start"), end.alias("end"), "strand").where("start is not null and end is not null")


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, symbol, start, end, strand of each transcript of a GTF file; the gene's name, or else its id."""
    c = F.split("value", "\t")
    attribute = lambda n: F.nullif(F.regexp_extract(F.get(c, F.lit(8)), f'{n} "([^"]+)"', 1), F.lit(""))
    rows = spark.read.text(path).where((F.size(c) >= 9) & ~F.col("value").startswith("#") & (F.get(c, F.lit(2)) == "transcript"))
    out = rows.select(F.get(c, F.lit(0)).alias("chrom"), F.coalesce(attribute("gene_name"), attribute("gene_id")).alias("symbol"), F.get(c, F.lit(3)).try_cast("long").alias("start"), F.get(c, F.lit(4)).try_cast("long").alias("end"), F.get(c, F.lit(6)).alias("strand"))
    return out.where("symbol is not null and start is not null and end is not null")
