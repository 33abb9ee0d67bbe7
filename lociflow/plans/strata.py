"""Queries of the scans by sex, marker exclusions, figure data and audits over the benchmark tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import linear, markers, report, samples, segments, strata
from ..sources import adapters as A
from .association import _RUNS, GAP, _n_samples, _sql, r6

CONTIG = "CASE marker % 4 WHEN 0 THEN 'chrX' WHEN 1 THEN 'Y' WHEN 2 THEN 'chrM' ELSE 'chr1' END"
SEX_SOURCES = "CASE WHEN c_custkey % 6 = 0 THEN 'predicted_sex' WHEN c_custkey % 6 < 3 THEN 'computed_gender' WHEN c_custkey % 6 < 5 THEN 'f_sex' END"


def sex_scans(spark: SparkSession, d: str) -> DataFrame:
    """The seven scans outside the autosomes: dimensions as markers of X, Y, M and 1, samples male, female and unknown in turn."""
    n = _n_samples(spark, d)
    label = np.array([r["label"] for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label").orderBy("vec_id").collect()], dtype=float)
    rows = linear.rows_of(A.intensity(spark, d), n).selectExpr("marker", f"{CONTIG} as chrom", "x")
    out = strata.sex_scans(rows, np.array([(1, 2, 0)[i % 3] for i in range(n)]), label)
    return out.select("mode", "marker", r6("beta"), r6("se"), r6("stat"), "n_samples", "method")


def _excluding(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = _n_samples(spark, d)
    label = np.array([r["label"] for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "label").orderBy("vec_id").collect()], dtype=float)
    values = A.intensity(spark, d).withColumn("value", F.when(F.col("marker") % 7 == 0, F.when(F.col("value").isNotNull(), 1.0)).otherwise(F.col("value")))
    rows = linear.rows_of(values, n).select("marker", (F.col("marker") % 9 == 0).alias("intensity_only"), "x")
    return strata.excluded_scan(rows, label, np.column_stack([np.ones(n), np.arange(n) % 2]))


def marker_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Every seventh marker has one value, every ninth is intensity only."""
    return _excluding(spark, d)[1]


def exclusion_info(spark: SparkSession, d: str) -> DataFrame:
    return strata.exclusion_info(_excluding(spark, d)[1])


def excluded_scan(spark: SparkSession, d: str) -> DataFrame:
    """The scan of the other markers; of the covariates one is constant and dropped."""
    return _excluding(spark, d)[0].select("marker", r6("beta"), r6("se"), r6("stat"), "n_samples")


def stage_masks(spark: SparkSession, d: str) -> DataFrame:
    """The four marker filters on the dimensions as markers, each on its own and all together."""
    x = A.intensity(spark, d)
    rows = spark.range(A.N_DIMENSIONS).selectExpr("id as marker", "case id % 4 when 0 then 'chrX' else 'chr2' end as chrom", "id * 100 as pos")
    regions = spark.sql("select 'chr2' as chrom, 1000L as start, 2100L as `end` union all select 'chrX', 0L, 400L")
    return markers.stage_masks(rows, markers.marker_stats(x, _n_samples(spark, d)), regions, 0.9, 0.001).drop("chrom", "pos")


def sample_exclusion_het(spark: SparkSession, d: str) -> DataFrame:
    """The sample exclusions of a sheet that also flags heterozygosity outliers."""
    sheet = A.adapted(spark, d, A.SHEET).withColumn("het_outlier", F.col("sample") % 29 == 0)
    return samples.exclusions(sheet).select("sample", F.array_join("reasons", ";").alias("reasons"), "in_grm", "analysed")


def analysed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a positive balance as phenotype, among those that the sheet does not exclude."""
    p = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("phenotype"))
    return strata.analysed(p, samples.exclusions(A.adapted(spark, d, A.SHEET)).where("analysed").select("sample"))


def high_quality_split(spark: SparkSession, d: str) -> DataFrame:
    return samples.split_by_quality(samples.sample_metrics(A.intensity(spark, d), A.N_DIMENSIONS), 0.9, 0.125).select("sample", "high_quality")


def case_counts(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("label") == 3).cast("int").alias("y"))
    return samples.case_counts(p, "y").select("n", "n_cases", "n_controls", r6("case_fraction"), "imbalanced")


def sex_sources(spark: SparkSession, d: str) -> DataFrame:
    return samples.sex_sources(spark.read.parquet(f"{d}/customer.parquet").selectExpr(f"{SEX_SOURCES} as sex_source"))


def _audited(spark: SparkSession, d: str) -> DataFrame:
    out = samples.exclusions(A.adapted(spark, d, A.SHEET))
    return out.select(F.lit("association_sample_qc").alias("stage"), F.lit("sample").alias("id_type"), F.col("sample").alias("id"), F.col("analysed").alias("included"), F.array_join("reasons", ";").alias("reason"))


def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    return samples.audit_reasons(_audited(spark, d))


def named_segments(spark: SparkSession, d: str) -> DataFrame:
    records = A.adapted(spark, d, A.RECORDS)
    return segments.named(segments.threshold_segments(records, 5e-8, GAP, 2), records).select("chrom", "start", "end", "name", "n_markers")


def qq_thinned(spark: SparkSession, d: str) -> DataFrame:
    return report.qq_thinned(A.adapted(spark, d, A.RECORDS), 500, 100).select("marker", "p", "rank")


def regional_points(spark: SparkSession, d: str) -> DataFrame:
    return report.regional_points(A.adapted(spark, d, A.RECORDS), "chrclick", 1_000_000, 200_000).select("marker", "pos", "p")


def lambda_gc_of_p(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(report.lambda_gc_of_p(A.adapted(spark, d, A.RECORDS)),)], "lambda_gc double").select(r6("lambda_gc"))


def manhattan_points(spark: SparkSession, d: str) -> DataFrame:
    """The drawn points: all strong ones and a fixed number of others by hash; no SQL, as the hash is Spark's."""
    return report.manhattan_points(A.adapted(spark, d, A.RECORDS), 1000).select("marker", "chrom", "pos", "p")


def qq_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The bounds of every hundredth rank; no SQL, as it has no Beta quantile."""
    n = A.adapted(spark, d, A.RECORDS).count()
    return spark.createDataFrame(report.qq_envelope(n, list(range(1, n + 1, max(1, n // 100)))), "rank long, lower double, upper double").select("rank", r6("lower"), r6("upper"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sex_scans, marker_exclusions, exclusion_info, excluded_scan, stage_masks, sample_exclusion_het, analysed_samples, high_quality_split, case_counts, sex_sources, audit_reasons,
        named_segments, qq_thinned, regional_points, lambda_gc_of_p, manhattan_points, qq_envelope,
    )
}

_MODES = "(VALUES " + ", ".join(f"('{m}', '{c}', '{w}', '{s}')" for m, c, w, s in (line.split() for line in strata.MODES.split("\n") if line)) + ") AS m(mode, contig, who, with_sex)"
_CONSTANT = "(SELECT marker, sample, CASE WHEN marker % 7 = 0 THEN CASE WHEN value IS NOT NULL THEN CAST(1 AS DOUBLE) END ELSE value END AS value FROM <INTENSITY> q)"
_JUDGED = f"""(SELECT *, concat_ws(';', CASE WHEN intensity_only THEN 'intensity_only' END, CASE WHEN monomorphic THEN 'monomorphic_lrr' END) AS reasons FROM
 (SELECT marker, marker % 9 = 0 AS intensity_only, coalesce(min(value) = max(value), true) AS monomorphic FROM {_CONSTANT} v GROUP BY marker) w)"""
_HET = """(SELECT *, list_filter([CASE WHEN call_rate < CAST(0.97 AS DOUBLE) THEN 'call_rate' END, CASE WHEN lrr_sd > CAST(0.35 AS DOUBLE) THEN 'lrr_sd' END, CASE WHEN baf_sd > CAST(0.15 AS DOUBLE) THEN 'baf_sd' END,
 CASE WHEN sex_status = 'DISCORDANT' THEN 'sex_discordant' END, CASE WHEN abs(inbreeding_f) > CAST(0.2 AS DOUBLE) THEN 'inbreeding' END, {het}CASE WHEN pre_pca THEN 'pre_pca' END, CASE WHEN related THEN 'relatedness' END], lambda x: x IS NOT NULL) AS reasons FROM <SHEET> s)"""
_WITH_HET, _NO_HET = _HET.replace("{het}", "CASE WHEN sample % 29 = 0 THEN 'het_outlier' END, "), _HET.replace("{het}", "")

ORACLE_SQL: dict[str, str] = {
    k: _sql(_sql(v))
    for k, v in {
        "sex_scans": f"""WITH d AS (SELECT marker, sample, value AS x, CAST(label AS DOUBLE) AS y, sample % 3 AS kind, CASE marker % 4 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'M' END AS contig FROM <INTENSITY> q JOIN embeddings e ON e.vec_id = q.sample WHERE value IS NOT NULL),
m AS (SELECT mode, marker, with_sex, x, y, CASE WHEN kind = 0 AND with_sex = 'yes' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS s FROM d JOIN {_MODES} ON m.contig = d.contig AND (who = 'all' OR who = 'male' AND kind = 0 OR who = 'female' AND kind = 1)),
c AS (SELECT mode, marker, with_sex, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, s - avg(s) OVER w AS s FROM m WINDOW w AS (PARTITION BY mode, marker)),
r AS (SELECT mode, marker, with_sex, CASE WHEN with_sex = 'yes' THEN x - s * sum(x * s) OVER w / sum(s * s) OVER w ELSE x END AS x, CASE WHEN with_sex = 'yes' THEN y - s * sum(y * s) OVER w / sum(s * s) OVER w ELSE y END AS y FROM c WINDOW w AS (PARTITION BY mode, marker)),
b AS (SELECT mode, marker, count(*) AS n, sum(x * y) / sum(x * x) AS beta, sqrt((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / (count(*) - CASE WHEN with_sex = 'yes' THEN 3 ELSE 2 END) / sum(x * x)) AS se FROM r GROUP BY mode, marker, with_sex)
SELECT mode, marker, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS stat, n AS n_samples, 'ols' AS method FROM b""",
        "marker_exclusions": f"SELECT marker, intensity_only, monomorphic, reasons, reasons = '' AS tested FROM {_JUDGED} j",
        "exclusion_info": f"SELECT count(*) AS n_markers, CAST(count_if(reasons = '') AS BIGINT) AS n_tested, CAST(count_if(reasons <> '') AS BIGINT) AS n_excluded, CAST(count_if(intensity_only) AS BIGINT) AS n_intensity_only, CAST(count_if(monomorphic) AS BIGINT) AS n_monomorphic FROM {_JUDGED} j",
        "excluded_scan": f"""WITH d AS (SELECT q.marker, value AS x, CAST(label AS DOUBLE) AS y, CAST(sample % 2 AS DOUBLE) AS s FROM {_CONSTANT} q JOIN embeddings e ON e.vec_id = q.sample JOIN {_JUDGED} j ON j.marker = q.marker AND reasons = '' WHERE value IS NOT NULL),
c AS (SELECT marker, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, s - avg(s) OVER w AS s FROM d WINDOW w AS (PARTITION BY marker)),
r AS (SELECT marker, x - s * sum(x * s) OVER w / sum(s * s) OVER w AS x, y - s * sum(y * s) OVER w / sum(s * s) OVER w AS y FROM c WINDOW w AS (PARTITION BY marker)),
b AS (SELECT marker, count(*) AS n, sum(x * y) / sum(x * x) AS beta, sqrt((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / (count(*) - 3) / sum(x * x)) AS se FROM r GROUP BY marker)
SELECT marker, round(beta, 6) AS beta, round(se, 6) AS se, round(beta / se, 6) AS stat, n AS n_samples FROM b""",
        "stage_masks": """SELECT *, call_rate_ok AND variance_ok AND autosome_ok AND region_ok AS passes FROM (SELECT marker, count(value) / count(*) >= CAST(0.9 AS DOUBLE) AS call_rate_ok, coalesce(var_pop(value) >= CAST(0.001 AS DOUBLE), false) AS variance_ok,
 marker % 4 <> 0 AS autosome_ok, NOT (marker % 4 <> 0 AND marker * 100 BETWEEN 1000 AND 2100 OR marker % 4 = 0 AND marker * 100 BETWEEN 0 AND 400) AS region_ok FROM <INTENSITY> x GROUP BY marker) y""",
        "sample_exclusion_het": f"SELECT sample, array_to_string(reasons, ';') AS reasons, NOT list_has_any(reasons, ['call_rate', 'lrr_sd', 'baf_sd', 'sex_discordant', 'inbreeding', 'het_outlier']) AS in_grm, len(reasons) = 0 AS analysed FROM {_WITH_HET} e",
        "analysed_samples": f"SELECT c_custkey AS sample, c_acctbal AS phenotype FROM customer JOIN {_NO_HET} e ON e.sample = c_custkey AND len(reasons) = 0 WHERE c_acctbal > 0",
        "high_quality_split": "SELECT sample, coalesce(count(value) / CAST(64 AS DOUBLE) >= CAST(0.9 AS DOUBLE) AND stddev_pop(value) <= CAST(0.125 AS DOUBLE), false) AS high_quality FROM <INTENSITY> x GROUP BY sample",
        "case_counts": "SELECT n, n_cases, n - n_cases AS n_controls, round(n_cases / n, 6) AS case_fraction, NOT (n_cases / n BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE)) AS imbalanced FROM (SELECT count(*) AS n, CAST(count_if(label = 3) AS BIGINT) AS n_cases FROM embeddings) x",
        "sex_sources": f"SELECT {SEX_SOURCES} AS source, count(*) AS n FROM customer WHERE c_custkey % 6 < 5 GROUP BY 1",
        "audit_reasons": f"SELECT 'association_sample_qc' AS stage, 'sample' AS id_type, array_to_string(reasons, ';') AS reason, count(*) AS n FROM {_NO_HET} e WHERE len(reasons) > 0 GROUP BY 3",
        "named_segments": f"""WITH f AS (SELECT *, CASE WHEN first_pos - lag(last_pos) OVER (PARTITION BY chrom ORDER BY ord) <= {GAP} THEN 0 ELSE 1 END AS far FROM {_RUNS.format(p='5e-8')} x),
g AS (SELECT *, sum(far) OVER (PARTITION BY chrom ORDER BY ord) AS seg FROM f),
s AS (SELECT chrom, min(first_pos) - 1 AS start, max(last_pos) AS "end", CAST(sum(n) AS BIGINT) AS n_markers FROM g GROUP BY chrom, seg HAVING sum(n) >= 2),
o AS (SELECT chrom, min(marker) AS first_marker FROM <RECORDS> r GROUP BY chrom)
SELECT chrom, start, "end", concat('region_', CAST(row_number() OVER (ORDER BY first_marker, chrom, start) AS STRING)) AS name, n_markers FROM s JOIN o USING (chrom)""",
        "qq_thinned": """WITH q AS (SELECT marker, p, row_number() OVER (ORDER BY p, marker) AS rank, count(*) OVER () AS n FROM <RECORDS> r WHERE p > 0 AND p <= 1)
SELECT marker, p, rank FROM q WHERE n <= 500 OR rank <= 100 OR rank IN (SELECT CAST(floor(100 + i * ((SELECT max(n) FROM q) - 1 - 100) / CAST(399 AS DOUBLE)) AS BIGINT) + 1 FROM (SELECT unnest(range(0, 400)) AS i) k)""",
        "regional_points": "SELECT marker, pos, p FROM <RECORDS> r WHERE chrom = 'click' AND p > 0 AND p <= 1 AND pos BETWEEN 800000 AND 1200000",
    }.items()
}
