"""Genomic segments from association records (chrom, ord, pos, p, beta, stat)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import minus_log10
from .markers import ranks

STATS = ("n_markers", "min_p", "mean_beta", "max_abs_stat")


def runs(records: DataFrame, flag) -> DataFrame:
    """Maximal runs of flagged records along each contig: equal difference of two row numbers."""
    along = Window.partitionBy("chrom").orderBy("ord")
    within = Window.partitionBy("chrom", "_flag").orderBy("ord")
    marked = records.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_run", F.row_number().over(along) - F.row_number().over(within))
    return _summed(marked.where("_flag"), "_run")


def _summed(rows: DataFrame, key: str) -> DataFrame:
    first = [F.min_by("method", "ord").alias("method")] if "method" in rows.columns else []
    return rows.groupBy("chrom", key).agg(*first, F.min("ord").alias("ord"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n_markers"), F.min("p").alias("min_p"), F.sum("beta").alias("sum_beta"), F.max(F.abs("stat")).alias("max_abs_stat")).drop(key)


def merged(found: DataFrame, most_gap: int = 1_000_000, least_markers: int = 1) -> DataFrame:
    """Runs of a contig no more than most_gap apart joined; 0-based half-open segments, with the method of the first record where records have one."""
    along = Window.partitionBy("chrom").orderBy("ord")
    far = F.coalesce((F.col("first_pos") - F.lag("last_pos").over(along) > most_gap).cast("int"), F.lit(1))
    grouped = found.withColumn("_far", far).withColumn("_seg", F.sum("_far").over(along))
    first = [F.min_by("method", "ord").alias("method")] if "method" in found.columns else []
    out = grouped.groupBy("chrom", "_seg").agg(*first, (F.min("first_pos") - 1).alias("start"), F.max("last_pos").alias("end"), F.sum("n_markers").alias("n_markers"), F.min("min_p").alias("min_p"), (F.sum("sum_beta") / F.sum("n_markers")).alias("mean_beta"), F.max("max_abs_stat").alias("max_abs_stat"))
    return out.where(F.col("n_markers") >= least_markers).select("chrom", "start", "end", *STATS, *(["method"] if first else []))


def threshold_segments(records: DataFrame, p_threshold: float = 5e-8, most_gap: int = 1_000_000, least_markers: int = 1) -> DataFrame:
    return merged(runs(records, F.col("p") <= p_threshold), most_gap, least_markers)


def viterbi_states(records: DataFrame, null_rate: float = float(np.log(10)), signal_rate: float = 0.1, prior: float = 1e-3, switch: float = 1e-4, width: int = 50_000) -> DataFrame:
    """Most likely path of a two-state chain with exponential emissions of -log10 p, contig by contig; ties go to state 0.

    Only the lead d of state 1 over state 0 matters.  A step clips it to [-top, top] and adds the record's gain, and
    steps in a row are again one clipped shift, so ranges of width values of ord are reduced each in a task of its
    own, and a contig's few ranges are put in a row.  On the way back a record whose lead is above top is in state 1,
    one at -top or below in state 0, and any other in the state of the next record.
    """
    top = float(np.log(1 - switch) - np.log(switch))
    start = float(np.log(prior) - np.log(1 - prior))

    def gains(pdf: pd.DataFrame) -> list[float]:
        return (np.log(signal_rate / null_rate) - (signal_rate - null_rate) * pdf["_x"].to_numpy()).tolist()

    def leads(gain: list[float], at: float) -> np.ndarray:
        """The lead after each record; at, the lead before, is clipped already."""
        out = []
        for g in gain:
            at = g + at
            out.append(at)
            at = min(max(at, -top), top)
        return np.array(out)

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        """The range as a lead's way through it: min(max(lead + shift, low), high)."""
        gain = gains(pdf.sort_values("ord"))
        low, high = leads(gain, -np.inf)[-1], leads(gain, np.inf)[-1]
        return pdf[["chrom", "_range"]].head(1).assign(low=low, high=high, shift=float(np.sum(gain)))

    def entered(pdf: pd.DataFrame) -> pd.DataFrame:
        """The clipped lead before each range of a contig, and whether it is the contig's last."""
        pdf, at, before = pdf.sort_values("_range"), start, []
        for low, high, shift in zip(pdf["low"], pdf["high"], pdf["shift"], strict=True):
            before.append(at)
            at = min(max(min(max(at + shift, low), high), -top), top)
        return pdf[["chrom", "_range"]].assign(_lead=before, _last=np.arange(len(pdf)) == len(pdf) - 1)

    def settled(pdf: pd.DataFrame) -> pd.Series:
        """The states that a record's own lead tells, else missing; pdf in order."""
        lead = leads(gains(pdf), pdf["_lead"].iloc[0])
        own = np.where(lead > top, 1.0, np.where(lead <= -top, 0.0, np.nan))
        if pdf["_last"].iloc[0]:
            own[-1] = float(lead[-1] > 0)
        return pd.Series(own, index=pdf.index)

    def first_settled(pdf: pd.DataFrame) -> pd.DataFrame:
        own = settled(pdf.sort_values("ord")).dropna()
        return pdf[["chrom", "_range"]].head(1).assign(_first=own.iloc[0] if len(own) else None).astype({"_first": "float64"})

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        state = settled(pdf).bfill().fillna(pdf["_next"].iloc[0]).astype("int64")
        return pdf.drop(columns=["_x", "_range", "_lead", "_last", "_next"]).assign(state=state)

    def with_ranges(rows: DataFrame, ranges: DataFrame, *cols: str) -> DataFrame:
        r, s = rows.alias("r"), ranges.alias("s")
        same = F.col("r.chrom").eqNullSafe(F.col("s.chrom")) & F.col("r._range").eqNullSafe(F.col("s._range"))
        return r.join(F.broadcast(s), same).select("r.*", *[f"s.{c}" for c in cols])

    rows = records.withColumn("_x", minus_log10(F.col("p"))).withColumn("_range", F.floor(F.col("ord") / width).cast("long"))
    thin, of_range = rows.select("chrom", "_range", "ord", "_x"), records.select("chrom").withColumn("_range", F.lit(0).cast("long"))
    ways = thin.groupBy("chrom", "_range").applyInPandas(reduced, of_range.selectExpr("*", "cast(null as double) low", "cast(null as double) high", "cast(null as double) shift").schema)
    before = ways.groupBy("chrom").applyInPandas(entered, of_range.selectExpr("*", "cast(null as double) _lead", "cast(null as boolean) _last").schema)
    firsts = with_ranges(thin, before, "_lead", "_last").groupBy("chrom", "_range").applyInPandas(first_settled, of_range.selectExpr("*", "cast(null as double) _first").schema)
    firsts = firsts.where("_first is not null and not isnan(_first)")
    after = Window.partitionBy("chrom").orderBy(F.col("_range").asc_nulls_last()).rowsBetween(1, Window.unboundedFollowing)
    told = firsts.toDF("_c", "_r", "_first")
    marked = before.join(told, F.col("chrom").eqNullSafe(F.col("_c")) & F.col("_range").eqNullSafe(F.col("_r")), "left")
    ranges = marked.select("chrom", "_range", "_lead", "_last", F.first("_first", ignorenulls=True).over(after).alias("_next"))
    out = records.withColumn("state", F.lit(0).cast("long")).schema
    return with_ranges(rows, ranges, "_lead", "_last", "_next").groupBy("chrom", "_range").applyInPandas(decode, out)


def named(segments: DataFrame, records: DataFrame) -> DataFrame:
    """Segments with name region_1, region_2, ... in the order of their contigs' first records, then of their starts.

    records tell the order of the contigs by the smallest marker; segments that a
    filter took out get no number.
    """
    contigs = records.groupBy("chrom").agg(F.min("marker").alias("first_marker"))
    placed = ranks(segments.join(F.broadcast(contigs), "chrom"), [F.col("first_marker"), F.col("chrom"), F.col("start")])
    return placed.select("chrom", "start", "end", F.concat(F.lit("region_"), F.col("rank").cast("string")).alias("name"), *[c for c in segments.columns if c not in ("chrom", "start", "end")])


def hmm_segments(records: DataFrame, least_markers: int = 1) -> DataFrame:
    found = runs(viterbi_states(records), F.col("state") == 1)
    return found.where(F.col("n_markers") >= least_markers).select("chrom", (F.col("first_pos") - 1).alias("start"), F.col("last_pos").alias("end"), "n_markers", "min_p", (F.col("sum_beta") / F.col("n_markers")).alias("mean_beta"), "max_abs_stat")
