"""Report data: top hits, inflation, counts, genes, positions and ranks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import chrom_order, tested
from .markers import middle, ranks
from .scans import beta_quantile

# fixed value: the median of the chi-squared distribution with one degree of freedom
CHI2_MEDIAN = 0.4549364


def top_hits(records: DataFrame, n: int = 10) -> DataFrame:
    """The n records of smallest p, then by contig and position."""
    return records.where(tested(F.col("p"))).orderBy("p", chrom_order(F.col("chrom")), "chrom", "pos").limit(max(0, n))


def lambda_gc(records: DataFrame) -> DataFrame:
    """Genomic inflation from the test statistics, and how many there are."""
    square = F.col("stat") * F.col("stat")
    m = middle(records, square)
    return records.agg(F.lit(sum(m) / len(m) / CHI2_MEDIAN if m else None).cast("double").alias("lambda_gc"), F.count("stat").alias("n"))


def chi2_upper(p: float) -> float:
    """The value that chi-squared with one degree of freedom exceeds with probability p, by bisection on the complementary error function."""
    low, high = 0.0, 60.0
    for _ in range(200):
        half = (low + high) / 2
        low, high = (half, high) if math.erfc(half / math.sqrt(2)) > p else (low, half)
    return low * low


def lambda_gc_of_p(records: DataFrame) -> float:
    """Genomic inflation from p-values: the median of their chi-squared values, NaN for fewer than two.

    As chi-squared falls with p, only the middle one or two p-values are turned into it.
    """
    m = middle(records.where(tested(F.col("p"))), F.col("p"))
    if records.where(tested(F.col("p"))).limit(2).count() < 2:
        return math.nan
    return sum(chi2_upper(p) for p in m) / len(m) / CHI2_MEDIAN


def mode_counts(records: DataFrame) -> DataFrame:
    """Tests, the smallest p, genome-wide and suggestive hits (which include the former)."""
    ok = records.where(tested(F.col("p")))
    return ok.agg(F.count("*").alias("n_tested"), F.min("p").alias("min_p"), F.count_if(F.col("p") < 5e-8).alias("n_genome_wide"), F.count_if(F.col("p") < 1e-5).alias("n_suggestive"))


def gene_spans(transcripts: DataFrame) -> DataFrame:
    """One span a contig and symbol; where transcripts have a strand it is that of the first, by ``record`` (the line's number) if they have one."""
    extent = [F.min("start").alias("start"), F.max("end").alias("end")]
    if "strand" in transcripts.columns:
        order = F.col("record") if "record" in transcripts.columns else F.struct("start", "end")
        extent.append(F.min_by("strand", order).alias("strand"))
    return transcripts.groupBy("chrom", "symbol").agg(*extent)


def _distance() -> F.Column:
    return F.when(F.col("pos") < F.col("start"), F.col("start") - F.col("pos")).when(F.col("pos") > F.col("end"), F.col("pos") - F.col("end")).otherwise(0)


def _bare(df: DataFrame) -> DataFrame:
    """df with contigs as one of both sides names them: 1 and chr1 are the same."""
    return df.withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))


def _places(hits: DataFrame) -> DataFrame:
    return hits.where("chrom is not null and pos is not null").select("chrom", "pos").distinct()


def nearest_genes(hits: DataFrame, genes: DataFrame, width: int = 10_000) -> DataFrame:
    """The nearest gene of each hit (hit_id, chrom, pos): distance 0 inside, ties by start, end and symbol; -1 where there is none.

    Of the genes that end at or after a place, the one of smallest start is the nearest, and of the others the
    one of largest end.  Both are running minima along the contig: over the places and gene ends of a bin of so
    many bases, and over the bins, one row each.  Genes without a bound or a symbol are left out.
    """
    hits, genes = _bare(hits), _bare(genes)
    known = genes.where("start is not null and `end` is not null and symbol is not null")
    ends = known.select("chrom", F.greatest(F.col("end"), F.col("start") - 1).alias("pos"), F.struct("start", "end", "symbol").alias("ahead"), F.struct((-F.col("end")).alias("back"), "start", "symbol").alias("behind"))
    ends = ends.groupBy("chrom", "pos").agg(F.min("ahead").alias("ahead"), F.min("behind").alias("behind"))
    every = ends.unionByName(_places(hits).withColumn("asked", F.lit(True)), allowMissingColumns=True).withColumn("bin", F.floor(F.col("pos") / width))

    def before(order, *key: str):
        return Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    bins = every.groupBy("chrom", "bin").agg(F.min("ahead").alias("a"), F.min("behind").alias("b"))
    bins = bins.select("chrom", "bin", F.min("a").over(before(F.col("bin").desc(), "chrom")).alias("ahead_of_bin"), F.min("b").over(before(F.col("bin"), "chrom")).alias("behind_bin"))
    up, down = Window.partitionBy("chrom", "bin").orderBy("pos"), Window.partitionBy("chrom", "bin").orderBy(F.col("pos").desc())
    near = every.withColumn("behind", F.min("behind").over(up.rangeBetween(Window.unboundedPreceding, -1))).withColumn("ahead", F.min("ahead").over(down.rangeBetween(Window.unboundedPreceding, 0)))
    near = near.where("asked").join(bins, ["chrom", "bin"])
    near = near.select("chrom", "pos", F.least("ahead", "ahead_of_bin").alias("ahead"), F.least("behind", "behind_bin").alias("behind"))
    right = F.when(F.col("ahead").isNotNull(), F.struct(F.greatest(F.col("ahead.start") - F.col("pos"), F.lit(0)).cast("long").alias("distance"), F.col("ahead.start").alias("start"), F.col("ahead.end").alias("end"), F.col("ahead.symbol").alias("symbol")))
    left = F.when(F.col("behind").isNotNull(), F.struct((F.col("pos") + F.col("behind.back")).cast("long").alias("distance"), F.col("behind.start").alias("start"), (-F.col("behind.back")).alias("end"), F.col("behind.symbol").alias("symbol")))
    found = near.select("chrom", "pos", F.least(left, right).alias("g"))
    best = hits.join(found, ["chrom", "pos"], "left").groupBy("hit_id").agg(F.min("g").alias("g"))
    return best.select("hit_id", F.col("g.symbol").alias("gene"), F.coalesce("g.distance", F.lit(-1)).cast("long").alias("distance"))


def genes_in_region(genes: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    return genes.where((F.regexp_replace("chrom", "^chr", "") == chrom.removeprefix("chr")) & (F.col("end") >= start) & (F.col("start") <= end))


def contig_offsets(records: DataFrame, gap: int = 1_000_000) -> DataFrame:
    """Where each contig starts on one axis; one row a contig."""
    last = records.groupBy("chrom").agg(F.max("pos").alias("last_pos"))
    before = Window.orderBy(chrom_order(F.col("chrom")), "chrom").rowsBetween(Window.unboundedPreceding, -1)
    return last.withColumn("offset", F.coalesce(F.sum(F.col("last_pos") + gap).over(before), F.lit(0)))


def qq_points(records: DataFrame) -> DataFrame:
    """Observed and expected p by rank."""
    ok = records.where(tested(F.col("p"))).select("marker", "p")
    n = ok.count()
    return ranks(ok, [F.col("p"), F.col("marker")]).withColumn("expected", F.col("rank") / F.lit(n + 1))


def kept_ranks(n: int, most: int = 8000, tail: int = 1000) -> list[int]:
    """The ranks that a thinned QQ plot keeps of n: the smallest ones, and so many evenly spaced ones after them; at most ``most`` numbers."""
    if n <= most:
        return list(range(1, n + 1))
    tail = min(tail, n)
    return sorted({*range(1, tail + 1), *(np.linspace(tail, n - 1, most - tail, dtype=int) + 1).tolist()})


def qq_thinned(records: DataFrame, most: int = 8000, tail: int = 1000) -> DataFrame:
    """The points of a QQ plot that a figure draws."""
    points = qq_points(records)
    keep = kept_ranks(points.count(), most, tail)
    ranks_ = records.sparkSession.range(0, len(keep)).select(F.get(F.lit(keep) if keep else F.array().cast("array<int>"), F.col("id").cast("int")).cast("long").alias("rank"))
    return points.join(F.broadcast(ranks_), "rank", "left_semi")


def qq_envelope(n: int, at: list[int], level: float = 0.95) -> list[tuple[int, float, float]]:
    """(rank, lower, upper) of the p-value of each rank of n under the null: quantiles of Beta(rank, n - rank + 1)."""
    rest, a = (1 - level) / 2, np.array(at, float)
    lower, upper = (beta_quantile(q, a, n - a + 1) for q in (rest, 1 - rest))
    return list(zip(at, lower.tolist(), upper.tolist(), strict=True))


def manhattan_points(records: DataFrame, most: int = 8000, seed: int = 0, always: float = 1e-5) -> DataFrame:
    """The records that a Manhattan plot draws: all of p below ``always``, and ``most`` of the others by hash."""
    ok = records.where(tested(F.col("p")))
    others = ok.where(F.col("p") >= always).orderBy(F.xxhash64(F.lit(seed), "marker"), "marker").limit(most)
    return ok.where(F.col("p") < always).unionByName(others)


def loci(hits: list[tuple[str, int]], window: int = 500_000, most: int = 10) -> list[tuple[str, int]]:
    """Of the top hits (chrom, pos), best first, those not within window of one before; at most so many."""
    kept: list[tuple[str, int]] = []
    for chrom, pos in hits:
        bare = chrom.removeprefix("chr")
        if len(kept) < most and not any(c.removeprefix("chr") == bare and abs(pos - p) < window for c, p in kept):
            kept.append((chrom, pos))
    return kept


def regional_points(records: DataFrame, chrom: str, pos: int, half_width: int = 500_000) -> DataFrame:
    """The tested records around a locus, contigs named with or without chr."""
    bare = F.regexp_replace("chrom", "^chr", "")
    return records.where(tested(F.col("p")) & (bare == chrom.removeprefix("chr")) & F.col("pos").between(pos - half_width, pos + half_width))


def mode_summary(records: DataFrame, genes: DataFrame | None = None, n: int = 10, window: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """One row of counts and inflation of a mode, and its top hits with nearest gene, distance and genes in the window."""
    counts = mode_counts(records).withColumn("lambda_gc", F.lit(lambda_gc_of_p(records)))
    best = top_hits(records, n)
    if genes is None:
        return counts, best
    ids = best.select(F.col("marker").alias("hit_id"), "chrom", "pos")
    near = nearest_genes(ids, genes).join(genes_in_window(ids, genes, window), "hit_id", "left")
    return counts, best.join(near.withColumnRenamed("hit_id", "marker"), "marker", "left")


def genes_in_window(hits: DataFrame, genes: DataFrame, window: int = 500_000, most: int = 20) -> DataFrame:
    """hit_id, genes (the nearest ones within window, ;-joined by distance and symbol) and n of them, at most so many a hit.

    An equi-join of the hits' distinct places with genes on bins of positions: a gene stands in every bin that its window reaches.
    A hit of one place, the usual case, takes the place's text as it is; only those of several places send lists of genes on.
    """
    hits, genes, width = _bare(hits), _bare(genes), max(window, 10_000)
    reach = F.sequence(F.floor((F.col("start") - window) / width), F.floor((F.col("end") + window) / width))
    binned = genes.where("start <= `end`").select("chrom", "symbol", "start", "end", F.explode(reach).alias("bin"))
    near = _places(hits).withColumn("bin", F.floor(F.col("pos") / width)).join(binned, ["chrom", "bin"]).withColumn("distance", _distance()).where(F.col("distance") <= window)
    first = near.withColumn("k", F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("distance", "symbol"))).where(F.col("k") <= most)
    listed = first.groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("distance", "symbol"))).alias("g"))
    told = lambda g: [F.array_join(F.transform(g, lambda x: x["symbol"]), ";").alias("genes"), F.size(g).cast("long").alias("n")]
    asked = hits.where("hit_id is not null").groupBy("hit_id").agg(F.collect_list(F.struct("chrom", "pos")).alias("at"))
    unnamed = hits.where("hit_id is null").select("hit_id", "chrom", "pos")
    once = asked.where(F.size("at") == 1).select("hit_id", F.col("at")[0]["chrom"].alias("chrom"), F.col("at")[0]["pos"].alias("pos"))
    single = once.join(listed.select("chrom", "pos", *told(F.col("g"))), ["chrom", "pos"]).select("hit_id", "genes", "n")
    several = asked.where(F.size("at") > 1).select("hit_id", F.explode("at").alias("a")).select("hit_id", "a.chrom", "a.pos").unionByName(unnamed)
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list("g"))), 1, most)
    merged = several.join(listed, ["chrom", "pos"]).groupBy("hit_id").agg(nearest.alias("g")).select("hit_id", *told(F.col("g")))
    return single.unionByName(merged)


def effect_summary(records: DataFrame) -> DataFrame:
    """Least, largest and mean absolute slope."""
    return records.agg(F.min("beta").alias("least"), F.max("beta").alias("most"), F.avg(F.abs("beta")).alias("mean_abs"))
