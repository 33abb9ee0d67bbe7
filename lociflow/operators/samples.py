"""Sample metrics and exclusions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .markers import middle


def sample_metrics(lrr: DataFrame, n_markers: int) -> DataFrame:
    """Population SD, call rate and number of values of each sample of (marker, sample, value)."""
    return lrr.groupBy("sample").agg(F.stddev_pop("value").alias("lrr_sd"), (F.count("value") / F.lit(n_markers)).alias("call_rate"), F.count("value").alias("n_markers_used"))


def exclusions(sheet: DataFrame, least_call_rate: float = 0.97, most_lrr_sd: float = 0.35, most_baf_sd: float = 0.15, most_f: float = 0.2) -> DataFrame:
    """Add reasons (array), hard and soft to a sample sheet; a sample is analysed without any reason, and in the relationship matrix without a hard one."""
    rules = [
        ("call_rate", True, F.coalesce(F.col("call_rate") < least_call_rate, F.lit(True))),
        ("lrr_sd", True, F.coalesce(F.col("lrr_sd") > most_lrr_sd, F.lit(True))),
        ("baf_sd", True, F.coalesce(F.col("baf_sd") > most_baf_sd, F.lit(False))),
        ("sex_discordant", True, F.coalesce(F.col("sex_status") == "DISCORDANT", F.lit(False))),
        ("inbreeding", True, F.coalesce(F.abs(F.col("inbreeding_f")) > most_f, F.lit(False))),
        *([("het_outlier", True, F.coalesce(F.col("het_outlier"), F.lit(False)))] if "het_outlier" in sheet.columns else []),
        ("pre_pca", False, F.coalesce(F.col("pre_pca"), F.lit(False))),
        ("relatedness", False, F.coalesce(F.col("related"), F.lit(False))),
    ]
    out = sheet.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, _, bad in rules])))
    hard = F.arrays_overlap("reasons", F.array(*[F.lit(name) for name, is_hard, _ in rules if is_hard]))
    return out.withColumns({"in_grm": ~hard, "analysed": F.size("reasons") == 0})


def split_by_quality(metrics: DataFrame, least_call_rate: float = 0.97, most_lrr_sd: float = 0.35) -> DataFrame:
    """Metrics (sample, lrr_sd, call_rate) with high_quality; a sample without a value fails."""
    ok = (F.col("call_rate") >= least_call_rate) & (F.col("lrr_sd") <= most_lrr_sd) & ~F.isnan("lrr_sd")
    return metrics.withColumn("high_quality", F.coalesce(ok, F.lit(False)))


def case_counts(p: DataFrame, column: str) -> DataFrame:
    """Cases, controls, the share of cases, and whether they are so few or so many (outside 10 to 90 %) that a scan should warn."""
    n, cases = F.count(column), F.count_if(F.col(column) == 1)
    return p.agg(n.alias("n"), cases.alias("n_cases"), F.count_if(F.col(column) == 0).alias("n_controls"), (cases / n).alias("case_fraction")).withColumn("imbalanced", ~F.col("case_fraction").between(0.1, 0.9))


def sex_sources(sheet: DataFrame) -> DataFrame:
    """How many samples each column of the sheet told the sex of: (source, n) from (sample, sex_source)."""
    return sheet.where("sex_source is not null").groupBy(F.col("sex_source").alias("source")).agg(F.count("*").alias("n"))


def reason_counts(excluded: DataFrame) -> DataFrame:
    """How many samples each reason holds for."""
    return excluded.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def audit(records: DataFrame) -> DataFrame:
    """Totals and the included share of each stage of (stage, id_type, id, included)."""
    n, kept = F.count("*"), F.count_if("included")
    return records.groupBy("stage", "id_type").agg(n.alias("total_input"), kept.alias("total_included"), (n - kept).alias("total_excluded"), (kept / n).alias("included_fraction"))


def audit_reasons(records: DataFrame) -> DataFrame:
    """Ids of each stage and reason of (stage, id_type, id, included, reason): one row a reason, with the number of ids."""
    return records.where(~F.col("included")).groupBy("stage", "id_type", "reason").agg(F.count("*").alias("n"))


def latest(records: DataFrame) -> DataFrame:
    """Of several records (stage, id_type, id, order, ...) of one id the last in order; exclusions of a later scan override those before."""
    rest = [c for c in records.columns if c not in ("stage", "id_type", "id", "order")]
    last = records.groupBy("stage", "id_type", "id").agg(F.max_by(F.struct(*rest), "order").alias("last"))
    return last.select("stage", "id_type", "id", "last.*")


def phenotype_summary(p: DataFrame, column: str) -> DataFrame:
    """Count, mean, median, population SD, median absolute deviation, least and most; the medians come from ranks, not from one task."""
    middle_of = lambda value: (lambda m: F.lit(sum(m) / len(m) if m else None).cast("double"))(middle(p, value))
    median = middle_of(F.col(column))
    mad = middle_of(F.abs(F.col(column) - median))
    out = p.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("sd"), F.min(column).alias("least"), F.max(column).alias("most"))
    return out.select("n", "mean", median.alias("median"), "sd", "least", "most", mad.alias("mad"))
