"""Queries of the association call, exclusions by stratum, required samples and links by number, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dispatch, linear, markers, report, segments, strata
from ..sources import adapters as A
from . import strata as by_stratum
from .association import ORACLE_SQL as ASSOCIATION_SQL
from .association import _RUNS, GAP, _n_samples, _sql, r6


def _labels(spark: SparkSession, d: str) -> np.ndarray:
    return np.array([r["label"] for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label").orderBy("vec_id").collect()], dtype=float)


def association(spark: SparkSession, d: str) -> DataFrame:
    """Least squares by the one call; every seventh dimension has one value, every ninth is intensity only, and odd ones have no id."""
    n = _n_samples(spark, d)
    values = A.intensity(spark, d).withColumn("value", F.when(F.col("marker") % 7 == 0, F.when(F.col("value").isNotNull(), 1.0)).otherwise(F.col("value")))
    rows = linear.rows_of(values, n).selectExpr("marker", "concat('chr', marker % 4 + 1) as chrom", "marker * 100 as pos", "case when marker % 2 = 0 then concat('m', marker) end as variant_id", "marker % 9 = 0 as intensity_only", "x")
    out, _ = dispatch.associate(rows, _labels(spark, d), np.column_stack([np.arange(n) % 2]), "ols")
    return out.select("chrom", "pos", "variant_id", r6("beta"), r6("se"), r6("stat"), "n_samples", "method")


def sex_scan_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Markers of each mode, those tested and those of one value in its samples: of every fifth dimension the males (every third sample) have one."""
    n = _n_samples(spark, d)
    values = A.intensity(spark, d).withColumn("value", F.when((F.col("marker") % 5 == 0) & (F.col("sample") % 3 == 0), F.when(F.col("value").isNotNull(), 0.5)).otherwise(F.col("value")))
    rows = linear.rows_of(values, n).selectExpr("marker", f"{by_stratum.CONTIG} as chrom", "x")
    return strata.mode_exclusions(strata.sex_scan_rows(rows, np.array([(1, 2, 0)[i % 3] for i in range(n)]), _labels(spark, d)))


def required_samples(spark: SparkSession, d: str) -> DataFrame:
    """The sheet's samples, all of which are customers: the check passes."""
    known = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sample"))
    return dispatch.required(A.adapted(spark, d, A.SHEET).select("sample", "call_rate"), known)


def nearest_gene_bare(spark: SparkSession, d: str) -> DataFrame:
    """The nearest genes of hits whose contigs are named without chr."""
    hits = A.adapted(spark, d, A.MARKERS).selectExpr("marker as hit_id", "substr(chrom, 4) as chrom", "pos * 20 as pos")
    return report.nearest_genes(hits, A.adapted(spark, d, A.TRANSCRIPTS))


def ld_pairs_by_number(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs among the next 12 dimensions of each."""
    n = _n_samples(spark, d)
    return markers.ld_pairs_by_number(linear.rows_of(A.dosage(spark, d), n), n, 12, 0.001).select("a", "b", r6("r2"))


def subset_audit(spark: SparkSession, d: str) -> DataFrame:
    """How many dimensions each marker filter includes and excludes, from the audit trail of the filters."""
    x = A.intensity(spark, d)
    rows = spark.range(A.N_DIMENSIONS).selectExpr("id as marker", "case id % 4 when 0 then 'chrX' else 'chr2' end as chrom", "id * 100 as pos")
    regions = spark.sql("select 'chr2' as chrom, 1000L as start, 2100L as `end` union all select 'chrX', 0L, 400L")
    records = markers.subset_audit(markers.stage_masks(rows, markers.marker_stats(x, _n_samples(spark, d)), regions, 0.9, 0.001))
    return records.groupBy("stage", "reason", "included").agg(F.count("*").alias("n"))


def segment_methods(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the method of their first record; methods change with the records' order."""
    records = A.adapted(spark, d, A.RECORDS).withColumn("method", F.when(F.col("ord") % 3 == 0, "lmm").otherwise("ols"))
    return segments.threshold_segments(records, 1e-3, GAP).select("chrom", "start", "end", "n_markers", "method")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (association, sex_scan_exclusions, required_samples, nearest_gene_bare, ld_pairs_by_number, subset_audit, segment_methods)}

ORACLE_SQL: dict[str, str] = {
    "association": f"""SELECT 'chr' || CAST(marker % 4 + 1 AS VARCHAR) AS chrom, marker * 100 AS pos, CASE WHEN marker % 2 = 0 THEN 'm' || CAST(marker AS VARCHAR) ELSE 'chr' || CAST(marker % 4 + 1 AS VARCHAR) || ':' || CAST(marker * 100 AS VARCHAR) END AS variant_id,
 beta, se, stat, n_samples, 'ols' AS method FROM ({by_stratum.ORACLE_SQL["excluded_scan"]}) s""",
    "sex_scan_exclusions": _sql(f"""WITH v AS (SELECT marker, sample % 3 AS kind, CASE WHEN marker % 5 = 0 AND sample % 3 = 0 THEN CASE WHEN value IS NOT NULL THEN CAST(0.5 AS DOUBLE) END ELSE value END AS value, CASE marker % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'M' END AS contig FROM <INTENSITY> q),
j AS (SELECT mode, marker, coalesce(min(value) = max(value), true) AS gone FROM v JOIN {by_stratum._MODES} ON m.contig = v.contig AND (who = 'all' OR who = 'male' AND kind = 0 OR who = 'female' AND kind = 1) GROUP BY mode, marker)
SELECT mode, count(*) AS n_markers, CAST(count_if(NOT gone) AS BIGINT) AS n_tested, CAST(count_if(gone) AS BIGINT) AS n_monomorphic FROM j GROUP BY mode"""),
    "subset_audit": f"""WITH m AS ({by_stratum.ORACLE_SQL["stage_masks"]}),
r AS (SELECT 'correction_marker_call_rate' AS stage, 'failed_call_rate' AS reason, call_rate_ok AS included FROM m UNION ALL SELECT 'correction_marker_variance', 'failed_variance', variance_ok FROM m
 UNION ALL SELECT 'correction_marker_autosome', 'non_autosomal', autosome_ok FROM m UNION ALL SELECT 'correction_marker_complexity', 'complexity_region', region_ok FROM m)
SELECT stage, CASE WHEN included THEN '' ELSE reason END AS reason, included, count(*) AS n FROM r GROUP BY ALL""",
    "segment_methods": _sql(_sql(f"""WITH f AS (SELECT *, CASE WHEN first_pos - lag(last_pos) OVER (PARTITION BY chrom ORDER BY ord) <= {GAP} THEN 0 ELSE 1 END AS far FROM {_RUNS.format(p="1e-3")} x),
g AS (SELECT *, sum(far) OVER (PARTITION BY chrom ORDER BY ord) AS seg FROM f)
SELECT chrom, min(first_pos) - 1 AS start, max(last_pos) AS "end", CAST(sum(n) AS BIGINT) AS n_markers, CASE WHEN min(ord) % 3 = 0 THEN 'lmm' ELSE 'ols' END AS method FROM g GROUP BY chrom, seg""")),
    "required_samples": _sql("SELECT sample, call_rate FROM <SHEET> s"),
    "nearest_gene_bare": ASSOCIATION_SQL["nearest_gene"],
    "ld_pairs_by_number": _sql("""WITH c AS (SELECT marker, sample, coalesce(value - avg(value) OVER (PARTITION BY marker), 0) AS x FROM <DOSAGE> q)
SELECT a, b, round(r2, 6) AS r2 FROM (SELECT i.marker AS a, j.marker AS b, sum(i.x * j.x) * sum(i.x * j.x) / (sum(i.x * i.x) * sum(j.x * j.x)) AS r2 FROM c i JOIN c j ON i.sample = j.sample AND j.marker > i.marker AND j.marker <= i.marker + 12 GROUP BY 1, 2) y WHERE r2 > CAST(0.001 AS DOUBLE)"""),
}
