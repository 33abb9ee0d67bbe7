"""Queries over files that Spark stages from the benchmark tables: binary records, their index, and what is written while it is corrected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear
from ..session import working_folder
from ..sources import adapters as A
from ..sources import bcf
from .association import _n_samples, _sql

CONTIGS = ["chr1", "chr2", "chr3", "chr4"]


def staged_intensity(spark: SparkSession, d: str) -> tuple[str, int]:
    """A BCF file of the intensities as 32-bit floats, a record for each dimension, and the number of samples."""
    n = _n_samples(spark, d)
    rows = linear.rows_of(A.intensity(spark, d), n).selectExpr("concat('chr', marker % 4 + 1) as chrom", "marker * 1000 + 1 as pos", "concat('m', marker) as variant_id", "'A' as ref", "array('C') as alts", "marker % 9 = 0 as intensity_only", "x as lrr")
    path = f"{working_folder(spark)}/intensity.bcf"
    bcf.write(rows, path, CONTIGS, [f"s{i}" for i in range(n)], "lociflow")
    return path, n


def bcf_intensity(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the staged file, read as records."""
    records = bcf.bcf(spark, staged_intensity(spark, d)[0], ["variant_id", "pos", "intensity_only", "lrr"])
    return records.select("variant_id", "pos", "intensity_only", F.posexplode("lrr").alias("sample", "value")).withColumn("sample", F.col("sample").cast("long"))


def bcf_contigs(spark: SparkSession, d: str) -> DataFrame:
    """The metadata of all markers staged as one file without samples, read by two contigs' places in its index."""
    markers = A.adapted(spark, d, A.MARKERS).selectExpr("chrom", "marker as pos", "case when marker % 3 <> 0 then variant_id end as variant_id", "'G' as ref", "array('A', 'T') as alts", "marker % 5 = 0 as intensity_only")
    path = f"{working_folder(spark)}/markers.bcf"
    bcf.write(markers, path, CONTIGS, [])
    return bcf.bcf(spark, path, ["chrom", "pos", "variant_id", "ref", "alts", "intensity_only"], ["chr2", "chr4"]).select("chrom", "pos", "variant_id", "ref", F.array_join("alts", ",").alias("alts"), "intensity_only")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (bcf_intensity, bcf_contigs)}

ORACLE_SQL: dict[str, str] = {
    k: _sql(_sql(v))
    for k, v in {
        "bcf_intensity": "SELECT 'm' || CAST(marker AS VARCHAR) AS variant_id, marker * 1000 + 1 AS pos, marker % 9 = 0 AS intensity_only, sample, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value FROM <INTENSITY> x",
        "bcf_contigs": """SELECT chrom, marker AS pos, CASE WHEN marker % 3 <> 0 THEN variant_id ELSE chrom || ':' || CAST(marker AS VARCHAR) || ':G:A:T' END AS variant_id, 'G' AS ref, 'A,T' AS alts, marker % 5 = 0 AS intensity_only
 FROM <MARKERS> m WHERE chrom IN ('chr2', 'chr4')""",
    }.items()
}
