"""Genome builds: names, detection from a VCF header, and their regions as tables.

Regions are (chrom, start, end), 1-based and inclusive, some dozens of rows a build.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: names of builds, in the order in which they are looked for, and lengths of chromosome 1
ALIASES = {"T2T-CHM13": ("t2t-chm13", "chm13v2.0", "chm13v2", "chm13", "hs1"), "GRCh38": ("grch38", "hg38"), "GRCh37": ("grch37", "hg19")}
CHR1_LENGTH = {"T2T-CHM13": 248_387_328, "GRCh38": 248_956_422, "GRCh37": 249_250_621}
LENGTH_TOLERANCE = 100_000

# fixed values: centromeres, the HLA region of chr6 and the immunoglobulin loci of chr2, chr14 and chr22
EXCLUDED = {
    "GRCh37": """
chr1 121535434 124535434
chr2 92326171 95326171
chr2 89156874 89630436
chr3 90504854 93504854
chr4 49660117 52660117
chr5 46405641 49405641
chr6 58830166 61830166
chr6 28477797 33448354
chr7 58054331 61054331
chr8 43838887 46838887
chr9 47367679 50367679
chr10 39254935 42254935
chr11 51644566 54644566
chr12 34856694 37856694
chr13 16000000 19000000
chr14 16000000 19000000
chr14 106032614 107288051
chr15 17000000 20000000
chr16 35335801 38335801
chr17 22263006 25263006
chr18 15460898 18460898
chr19 24681782 27681782
chr20 26369569 29369569
chr21 11288129 14288129
chr22 13000000 16000000
chr22 22380474 23265085""",
    "GRCh38": """
chr1 122026460 124932724
chr2 92188146 94090557
chr2 88857361 89331083
chr3 90772459 93655574
chr4 49708101 51743951
chr5 46485901 50059807
chr6 58553889 59829934
chr6 28510120 33480577
chr7 58169654 60828234
chr8 44033745 45338887
chr9 43236168 45518558
chr10 39686683 41593521
chr11 51078349 54425074
chr12 34769408 37185252
chr13 16000001 18051248
chr14 16000001 18173523
chr14 105586437 106879844
chr15 17083674 19725254
chr16 36311159 38280682
chr17 22813680 26885980
chr18 15460900 20861206
chr19 24498981 27190874
chr20 26436233 30038348
chr21 10864561 12915808
chr22 12954789 15054318
chr22 22026076 22922913""",
    "T2T-CHM13": """
chr1 121700000 143300000
chr2 91500000 94700000
chr2 88857361 89331083
chr3 90000000 96500000
chr4 49000000 54000000
chr5 46000000 51800000
chr6 57000000 60800000
chr6 28510120 33480577
chr7 58000000 62500000
chr8 43000000 47500000
chr9 42000000 67500000
chr10 38500000 42500000
chr11 50000000 55500000
chr12 34000000 37800000
chr13 13000000 18500000
chr14 10000000 13800000
chr14 105586437 106879844
chr15 14500000 20500000
chr16 35000000 39000000
chr17 22000000 27500000
chr18 15000000 21800000
chr19 24000000 28500000
chr20 26000000 31000000
chr21 10000000 13500000
chr22 12500000 17500000
chr22 22026076 22922913""",
}

# fixed values: pseudoautosomal and X-transposed regions
PSEUDOAUTOSOMAL = {
    "GRCh37": """
chrX 60001 2699520
chrX 2699520 6100000
chrX 154931044 155260560
chrY 10001 2649520
chrY 59034050 59363566""",
    "GRCh38": """
chrX 10001 2781479
chrX 2781479 6400000
chrX 155701383 156030895
chrY 10001 2781479
chrY 56887903 57217415""",
    "T2T-CHM13": """
chrX 0 2781479
chrX 2781479 6400875
chrX 155701382 156040895
chrY 0 2458320
chrY 2458320 6400875
chrY 62122809 62460029""",
}


def build_name(text: str) -> str:
    """The build that a name or an alias of it stands for."""
    for build, aliases in ALIASES.items():
        if text.lower() in (build.lower(), *aliases):
            return build
    raise ValueError(f"unknown genome build {text!r}; known are {', '.join(ALIASES)}")


def detect_build(spark: SparkSession, path: str) -> str | None:
    """The build of a VCF by the names in its contig lines, or else by the length of chromosome 1; None if neither tells."""
    line = F.lower("value")
    length = F.regexp_extract(line, r"[<,]length=(\d+)", 1).try_cast("long")
    found = (
        spark.read.text(path)
        .where(F.col("value").startswith("##contig"))
        .agg(
            *[F.coalesce(F.max(F.greatest(*[line.contains(a) for a in aliases], F.lit(False))), F.lit(False)).alias(build) for build, aliases in ALIASES.items()],
            F.max(F.when(line.rlike(r"[<,]id=(chr)?1[,>]"), length)).alias("chr1"),
        )
        .first()
    )
    named = [b for b in ALIASES if found[b]]
    near = [b for b, n in sorted(CHR1_LENGTH.items(), key=lambda x: abs((found["chr1"] or 0) - x[1])) if abs((found["chr1"] or 0) - n) <= LENGTH_TOLERANCE]
    return (named or near or [None])[0]


def regions(spark: SparkSession, build: str, catalogue: dict[str, str] | None = None, prefixed: bool = True) -> DataFrame:
    """A build's regions, by default those that are excluded; contigs with or without chr."""
    rows = [line.split() for line in (catalogue or EXCLUDED)[build_name(build)].split("\n") if line]
    return spark.createDataFrame([(c if prefixed else c.removeprefix("chr"), int(a), int(b)) for c, a, b in rows], "chrom string, start long, end long")


def prefixed_like(markers: DataFrame) -> bool:
    """Whether any contig of markers is named with chr."""
    return not markers.where(F.col("chrom").startswith("chr")).isEmpty()
