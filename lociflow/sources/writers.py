"""Writers of text formats as folders of parts whose names are in the order of their rows.

The parts one after another are the file.  Header lines sort before all rows, so
they are in the first part, and no task holds more than its range of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import chrom_order

# fixed values: the columns of a BED file and of an audit trail, and how the latter counts included ids
BED_COLUMNS = ("chrom", "start", "end", "name", "n_markers", "min_p", "mean_beta", "max_abs_stat")


def ordered_text(lines: DataFrame, header: list[str], path: str, parts: int = 64) -> None:
    """Write lines (k1, k2, k3, line) in the order of the keys below header; k1 is 0 or more, k2 a text, k3 a long."""
    spark = lines.sparkSession
    top = spark.createDataFrame([(-1, "", i, h) for i, h in enumerate(header)], "k1 int, k2 string, k3 long, line string")
    rows = top.unionByName(lines.select(F.col("k1").cast("int").alias("k1"), "k2", F.col("k3").cast("long").alias("k3"), "line"))
    rows.repartitionByRange(parts, "k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3").select("line").write.mode("errorifexists").text(path)


def _cells(*cells: Column) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in cells])


def vcf(rows: DataFrame, samples: list[str], path: str, field: str = "LRR", source: str = "", parts: int = 64) -> None:
    """Records (chrom, pos, variant_id, ref, alts, x) sorted by contig and position, x as one FORMAT field; missing is a dot."""
    header = ["##fileformat=VCFv4.2", *([f"##source={source}"] if source else []), f'##FORMAT=<ID={field},Number=1,Type=Float,Description="Value of each sample">']
    header.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ","))
    values = F.array_join(F.transform("x", lambda v: F.coalesce(v.cast("string"), F.lit("."))), "\t")
    dot = F.lit(None).cast("string")
    line = _cells(F.col("chrom"), F.col("pos"), F.col("variant_id"), F.col("ref"), alt, dot, dot, dot, F.lit(field), values)
    ordered_text(rows.select(chrom_order(F.col("chrom")).alias("k1"), F.col("chrom").alias("k2"), F.col("pos").alias("k3"), line.alias("line")), header, path, parts)


def bed(segments: DataFrame, path: str) -> None:
    """Segments (chrom, start, end, name, n_markers, ...) with a #-prefixed header; without names each has its contig and bounds."""
    name = F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    rows = segments if "name" in segments.columns else segments.withColumn("name", name)
    line = _cells(*[F.col(c) for c in BED_COLUMNS])
    ordered_text(rows.select(chrom_order(F.col("chrom")).alias("k1"), F.col("chrom").alias("k2"), F.col("start").alias("k3"), line.alias("line")), ["#" + "\t".join(BED_COLUMNS)], path, 1)


def table(df: DataFrame, order: Column, path: str, parts: int = 64) -> None:
    """A tab-separated table with a header, in the order of a long column; missing values are empty."""
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    ordered_text(df.select(F.lit(0).alias("k1"), F.lit("").alias("k2"), order.alias("k3"), line.alias("line")), ["\t".join(df.columns)], path, parts)


def markers_used(masks: DataFrame, markers: DataFrame, path: str, parts: int = 64) -> None:
    """variant_id, chrom and pos of the markers that a decomposition learnt from, in the order of their numbers; masks: (marker, passes)."""
    used = markers.join(masks.where("passes").select("marker"), "marker", "left_semi")
    line = F.concat_ws("\t", "variant_id", "chrom", F.col("pos").cast("string"))
    ordered_text(used.select(F.lit(0).alias("k1"), F.lit("").alias("k2"), F.col("marker").alias("k3"), line.alias("line")), ["variant_id\tchrom\tpos"], path, parts)


def audit(records: DataFrame, path: str, parts: int = 64) -> None:
    """An audit trail of (stage, id_type, id, included, reason): a line with the number of included ids of each stage, then its excluded ids."""
    kept = records.where("included").groupBy("stage", "id_type").agg(F.concat(F.lit("n="), F.count("*").cast("string")).alias("id"))
    kept = kept.select("stage", "id_type", "id", F.lit("included_summary").alias("status"), F.lit("").alias("reason"), F.lit(0).alias("k3"))
    gone = records.where(~F.col("included")).select("stage", "id_type", F.col("id").cast("string").alias("id"), F.lit("excluded").alias("status"), "reason", F.lit(1).alias("k3"))
    columns = ("stage", "id_type", "id", "status", "reason")
    lines = kept.unionByName(gone).select(F.lit(0).alias("k1"), F.col("stage").alias("k2"), "k3", F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in columns]).alias("line"))
    ordered_text(lines, ["\t".join(columns)], path, parts)


def audit_summary(totals: DataFrame, reasons: DataFrame, path: str) -> None:
    """One line a stage: totals, fractions and the number of ids of each reason as JSON."""
    counts = reasons.groupBy("stage", "id_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).alias("excluded_reason_counts"))
    rows = totals.join(counts, ["stage", "id_type"], "left").withColumn("excluded_fraction", 1 - F.col("included_fraction"))
    columns = ("stage", "id_type", "total_input", "total_included", "total_excluded", "included_fraction", "excluded_fraction", "excluded_reason_counts")
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("{}" if c == columns[-1] else "")) for c in columns])
    ordered_text(rows.select(F.lit(0).alias("k1"), F.col("stage").alias("k2"), F.lit(0).alias("k3"), line.alias("line")), ["\t".join(columns)], path, 1)
