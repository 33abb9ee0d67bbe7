"""Marker statistics and masks over a long matrix (marker, sample, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import autosomal
from ..session import working_folder
from .linear import matrix


def marker_stats(lrr: DataFrame, n_samples: int) -> DataFrame:
    """Call rate, mean, population variance, range and monomorphism of each marker."""
    return lrr.groupBy("marker").agg(
        (F.count("value") / F.lit(n_samples)).alias("call_rate"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("variance"),
        F.coalesce(F.min("value") == F.max("value"), F.lit(True)).alias("monomorphic"),
    )


def masked_markers(stats: DataFrame, least_call_rate: float = 0.95, least_variance: float = 0.001, most_variance: float | None = None) -> DataFrame:
    """Each mask as a column of its own, so that every filter can be reported; a marker passes if all do."""
    in_range = (F.col("variance") >= least_variance) & (F.lit(True) if most_variance is None else F.col("variance") <= most_variance)
    masks = stats.withColumns({"call_rate_ok": F.col("call_rate") >= least_call_rate, "variance_ok": F.coalesce(in_range, F.lit(False))})
    return masks.withColumn("passes", F.col("call_rate_ok") & F.col("variance_ok"))


def outside_regions(markers: DataFrame, regions: DataFrame, width: int = 10_000) -> DataFrame:
    """Markers (chrom, pos) outside every inclusive region (chrom, start, end).

    A place is inside if, of the regions that start at or before it, the largest end
    reaches it.  That is a running maximum along the contig: over the distinct places and
    region starts of a bin of so many bases, and over the bins that have regions, one row each.
    The markers then meet the places that are inside by an anti join on equal places.
    """
    starts = regions.where("chrom is not null and start is not null").groupBy("chrom", F.col("start").alias("pos")).agg(F.max("end").alias("end"))
    places = markers.where("chrom is not null and pos is not null").select("chrom", "pos").distinct()
    every = starts.unionByName(places.withColumn("asked", F.lit(True)), allowMissingColumns=True).withColumn("bin", F.floor(F.col("pos") / width))
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("chrom", "bin").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    bins = every.groupBy("chrom", "bin").agg(F.max("end").alias("end")).select("chrom", "bin", F.max("end").over(earlier).alias("before"))
    near = every.withColumn("reach", F.max("end").over(here)).where("asked").join(bins, ["chrom", "bin"])
    inside = near.where(F.greatest("reach", "before") >= F.col("pos")).select("chrom", "pos")
    return markers.join(inside, ["chrom", "pos"], "left_anti").select(*markers.columns)


def qc_reasons(markers: DataFrame, qc: DataFrame, flags: list[str], composite: str | None = None) -> DataFrame:
    """Markers with the ;-joined names of the failed flags, or not_in_variant_qc.

    composite names a flag that decides alone where the QC has it.
    """
    flags = [composite] if composite in qc.columns else flags
    known = qc.select("variant_id", *flags, F.lit(True).alias("_known"))
    failed = F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(F.col(f), F.lit(False)), F.lit(f)) for f in flags])), ";")
    out = markers.join(known, "variant_id", "left").withColumn("reasons", F.when(F.col("_known").isNull(), "not_in_variant_qc").otherwise(failed))
    return out.select(*markers.columns, "reasons", (F.col("reasons") == "").alias("passes"))


def stage_masks(markers: DataFrame, stats: DataFrame, regions: DataFrame | None = None, least_call_rate: float = 0.95, least_variance: float = 0.001, most_variance: float | None = None) -> DataFrame:
    """Markers (marker, chrom, pos) with call_rate_ok, variance_ok, autosome_ok, region_ok and passes.

    Each mask is judged on all markers, so that every filter can be reported on its own.
    """
    judged = markers.join(masked_markers(stats, least_call_rate, least_variance, most_variance).select("marker", "call_rate_ok", "variance_ok"), "marker", "left")
    inside = markers if regions is None else outside_regions(markers, regions)
    judged = judged.join(inside.select("marker", F.lit(True).alias("region_ok")), "marker", "left")
    flags = ("call_rate_ok", "variance_ok", "autosome_ok", "region_ok")
    judged = judged.withColumn("autosome_ok", autosomal(F.col("chrom"))).withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("call_rate_ok", "variance_ok", "region_ok")})
    return judged.select(*markers.columns, *flags, (F.col(flags[0]) & F.col(flags[1]) & F.col(flags[2]) & F.col(flags[3])).alias("passes"))


# fixed values: the stage and the reason of each filter in an audit trail
AUDITED = """
call_rate_ok correction_marker_call_rate failed_call_rate
variance_ok correction_marker_variance failed_variance
autosome_ok correction_marker_autosome non_autosomal
region_ok correction_marker_complexity complexity_region"""


def subset_audit(masks: DataFrame, name: str = "marker") -> DataFrame:
    """An audit record (stage, id_type, id, included, reason) of each marker of stage_masks for each of its filters; every filter is judged on all markers."""
    rules = [line.split() for line in AUDITED.split("\n") if line]
    each = F.array(*[F.struct(F.lit(stage).alias("stage"), F.col(flag).alias("included"), F.when(~F.col(flag), F.lit(reason)).otherwise("").alias("reason")) for flag, stage, reason in rules])
    return masks.select(F.col(name).cast("string").alias("id"), F.explode(each).alias("r")).select("r.stage", F.lit("marker").alias("id_type"), "id", "r.included", "r.reason")


def without_qc(markers: DataFrame) -> DataFrame:
    """The result of qc_reasons where no QC table is given: every marker passes."""
    return markers.withColumns({"reasons": F.lit(""), "passes": F.lit(True)})


def every_nth(df: DataFrame, order: str, n_rows: int, target: int) -> DataFrame:
    """At most target rows at an even stride in order: ranks come from per-range counts, not from one ordered task."""
    step = max(1, n_rows // target)
    ranked = ranks(df, [F.col(order)])
    return ranked.where(((F.col("rank") - 1) % step == 0) & ((F.col("rank") - 1) / step < target)).drop("rank")


def ranks(df: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """Add a global 1-based rank: rows are cut into ranges, ranked in each, and shifted by the counts before it.

    The cut is stored, so that the counts and the ranks come from the same ranges.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    cut = cut.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    path = working_folder(spark)
    cut.write.parquet(path)
    cut = spark.read.schema(cut.schema).parquet(path)
    before = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return cut.join(F.broadcast(before), "_part").withColumn("rank", (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def middle(df: DataFrame, value: Column) -> list[float]:
    """The one or two middle values in order, from ranks; none of an empty table."""
    known = df.select(value.alias("v")).where("v is not null and not isnan(v)")
    n = known.count()
    found = ranks(known, [F.col("v")]).where(F.col("rank").isin((n + 1) // 2, n // 2 + 1)).select("v").collect() if n else []
    return sorted(r["v"] for r in found)


def mean_imputed(lrr: DataFrame) -> DataFrame:
    """Missing values replaced by the marker's mean, or 0 where a marker has none."""
    means = lrr.groupBy("marker").agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"))
    return lrr.join(means, "marker").withColumn("value", F.coalesce("value", "mean")).drop("mean")


def allele_frequencies(dosage: DataFrame, n_samples: int, least_maf: float = 0.01, least_call_rate: float = 0.9) -> DataFrame:
    """Frequency of each marker of (marker, sample, value) that passes the call-rate and then the frequency filter."""
    f = dosage.groupBy("marker").agg((F.count("value") / F.lit(n_samples)).alias("call_rate"), (F.avg("value") / 2).alias("freq"))
    f = f.where(F.col("call_rate") >= least_call_rate).withColumn("maf", F.least("freq", 1 - F.col("freq")))
    return f.where(F.col("maf") >= least_maf)


TILE = 512


def ld_pairs(rows: DataFrame, positions: DataFrame, n_samples: int, window: int = 1_000_000, least_r2: float = 0.2) -> DataFrame:
    """Pairs of markers of a contig within window base pairs whose squared correlation is above least_r2.

    rows: (marker, x), x an array of one dosage a sample.  Markers are put in bins of
    window base pairs and, in a bin, in tiles of TILE markers one after another.  Two
    tiles meet in a task of their own, as one matrix product, if the second comes
    later and starts within the window of the first.
    """
    binned = positions.select("chrom", "marker", "pos", F.floor(F.col("pos") / window).alias("bin"))
    order = Window.partitionBy("chrom", "bin").orderBy("pos", "marker")
    placed = binned.withColumn("tile", F.floor((F.row_number().over(order) - 1) / TILE).cast("int"))
    tiles = placed.groupBy("chrom", "bin", "tile").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    here = tiles.select("chrom", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("b_bin"), F.col("bin").alias("a_bin"), F.col("tile").alias("a_tile"), F.col("high"))
    after = here.join(tiles.select("chrom", F.col("bin").alias("b_bin"), F.col("tile").alias("b_tile"), "low"), ["chrom", "b_bin"])
    after = after.where(((F.col("b_bin") > F.col("a_bin")) | (F.col("b_tile") >= F.col("a_tile"))) & (F.col("low") <= F.col("high") + window)).drop("high", "low")
    side = lambda which, of: placed.join(after.withColumns({"bin": F.col(f"{of}_bin"), "tile": F.col(f"{of}_tile")}), ["chrom", "bin", "tile"]).withColumn("side", F.lit(which))
    dealt = side(0, "a").unionByName(side(1, "b")).join(rows.select("marker", "x"), "marker")

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        x, y = (matrix(s["x"]) for s in sides)
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "r2": []}).astype({"a": "int64", "b": "int64"})
        centred = []
        for v in (x, y):
            seen = np.isfinite(v)
            mean = np.where(seen, v, 0).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
            centred.append(np.where(seen, v - mean[:, None], 0.0))
        (x, y), (pos_x, pos_y) = centred, (s["pos"].to_numpy() for s in sides)
        both = (x * x).sum(axis=1)[:, None] * (y * y).sum(axis=1)[None, :]
        r2 = np.divide((x @ y.T) ** 2, both, out=np.zeros_like(both), where=both > 0)
        i, j = np.nonzero((pos_y[None, :] > pos_x[:, None]) & (pos_y[None, :] <= pos_x[:, None] + window) & (r2 > least_r2))
        return pd.DataFrame({"a": sides[0]["marker"].to_numpy()[i], "b": sides[1]["marker"].to_numpy()[j], "r2": r2[i, j]})

    return dealt.groupBy("chrom", "a_bin", "a_tile", "b_bin", "b_tile").applyInPandas(linked, "a long, b long, r2 double")


def ld_pairs_by_number(rows: DataFrame, n_samples: int, window: int = 1000, least_r2: float = 0.2) -> DataFrame:
    """As ld_pairs where markers have no places: each meets the next ``window`` of them in the order of their numbers."""
    order = ranks(rows.select("marker"), [F.col("marker")]).select("marker", F.lit("").alias("chrom"), F.col("rank").alias("pos"))
    return ld_pairs(rows, order, n_samples, window, least_r2)


def ld_pruned(markers: DataFrame, pairs: DataFrame) -> DataFrame:
    """Markers (marker, chrom, pos; without places by number) left by the greedy forward walk: a marker goes if a kept one before it is linked with it.

    pairs (a, b): b comes after a.  One pass: the links of a contig stream by the place
    of b, so that whether a stays is known before b is asked; a task remembers the
    markers that have gone.  Contigs are walked side by side, and so are the stretches
    of a contig that no link spans.
    """
    has = set(markers.columns)
    places = markers.select("marker", F.col("chrom") if "chrom" in has else F.lit("").alias("chrom"), F.col("pos").cast("long") if "pos" in has else F.col("marker").alias("pos"))
    links = pairs.select("a", "b").distinct().join(places.toDF("b", "chrom", "pos"), "b").join(places.toDF("a", "_chrom", "first"), "a").select("a", "b", "chrom", "first", "pos")
    # a stretch starts where all links that began before have ended
    before = Window.partitionBy("chrom").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    starts = links.groupBy("chrom", "first").agg(F.max("pos").alias("pos"))
    starts = starts.withColumn("new", F.coalesce(F.max("pos").over(before) < F.col("first"), F.lit(True)).cast("int"))
    starts = starts.select("chrom", "first", F.sum("new").over(Window.partitionBy("chrom").orderBy("first")).alias("stretch"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, gone = None, set()
        for pdf in batches:
            out = []
            for stretch, a, b in zip(zip(pdf["chrom"], pdf["stretch"], strict=True), pdf["a"], pdf["b"], strict=True):
                if stretch != here:
                    here, gone = stretch, set()
                if a not in gone and b not in gone:
                    gone.add(b)
                    out.append(b)
            if out:
                yield pd.DataFrame({"marker": out})

    dealt = links.join(starts, ["chrom", "first"]).repartition("chrom", "stretch").sortWithinPartitions("chrom", "stretch", "pos", "b")
    return markers.join(dealt.select("chrom", "stretch", "a", "b").mapInPandas(walk, "marker long"), "marker", "left_anti")


def chrx_qc(markers: DataFrame, qc: DataFrame) -> DataFrame:
    """Markers of X with passes: their own flags where the QC has any, else the composite flag, else call rate and HWE; a marker without QC fails.

    qc: variant_id, chrx_hwe_pass, chrx_call_rate_pass, qc_pass, call_rate_pass, hwe_pass.
    """
    own = F.col("chrx_hwe_pass").isNotNull() | F.col("chrx_call_rate_pass").isNotNull()
    both = F.coalesce("chrx_hwe_pass", F.lit(True)) & F.coalesce("chrx_call_rate_pass", F.lit(True))
    other = F.coalesce("qc_pass", F.coalesce("call_rate_pass", F.lit(False)) & F.coalesce("hwe_pass", F.lit(False)))
    judged = qc.select("variant_id", F.when(own, both).otherwise(other).alias("passes"))
    return markers.join(judged, "variant_id", "left").withColumn("passes", F.coalesce("passes", F.lit(False)))
