"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source gets a target of words: the weights share ``share`` times all
words, no source takes more than ``most`` times its own, and what a full source
cannot take is shared again by weight (a water level, found from running sums).

A source's documents are dealt by hash into blocks of about ``block_words``
words.  Each pass over a source orders its blocks by hash and takes whole blocks
up to the target; the block at the border gives documents.  With whole documents,
as in op2 and the pipeline, the document at the border is taken whole or not at
all, whichever leaves the source nearer to its target; without, it counts with so
many words that the source's taken words equal its target rounded to a word.
Sums and ranks over a source's blocks are taken in two levels, ranges of the hash
and blocks within a range, about the square root of their number in each, so that
no task holds all blocks of a source.

The taken blocks go to output shards by a splitting tree: a node holds how many
blocks of each source lie below it, and its left half is a multivariate
hypergeometric draw, source after source, by inverse distribution function from
a hash of (seed, node, source).  Only values within ``DEVIATIONS`` standard
deviations of the mean are gone through; the rest has less weight than doubles
can add.  A leaf's quotas are exact, and each shard draws its own run of the
source's permuted blocks, so shards are disjoint.  ``mixed_rows`` gathers each
shard and puts its rows in hash order.

Only DataFrame functions are used.  Null text has size 0; null source is a
source, last in order; sizes of 0 take 0; repeated rows are mixed as separate
rows, whose order is settled by size and text; other columns pass through, but
for those of the names that ``mix`` adds; an empty table gives an empty mix.  One
row of the tree holds a number for each source, and the sources are ranked in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, shared_dir, spread, without

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 20_000
SHARD_WORDS = 1_000_000
DEVIATIONS = 12
LEVELS_AT_ONCE = 6
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add weight and target to (source, source_size), one row a source.

    With the level L at which the targets min(most * size, L * weight) add up to
    share * total, sources are full in the order of size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = (
        ranked.withColumn("goal", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final_level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"])
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap")))
    return ranked.select("source", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def _uniform(*key: Column) -> Column:
    """A number in (0, 1) from a hash of key."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """The u-quantile of the number of good ones in so many draws from total without replacement.

    The logs of the probabilities are built up from their ratios; a first pass over
    the values near the mean sums them up, scaled by the largest, a second finds u.
    """
    whole = F.greatest(total, F.lit(1)).cast("double")
    mean = draws * good / whole
    reach = DEVIATIONS * (F.sqrt(F.greatest(mean * (1 - good / whole) * (whole - draws) / whole, F.lit(0.0))) + 1)
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good), F.floor(mean - reach).cast("long"))
    high = F.least(draws, good, F.ceil(mean + reach).cast("long"))
    zero = F.lit(0.0)

    def log_ratio(k: Column) -> Column:
        """log p(k) - log p(k - 1)"""
        d = k.cast("double")
        return F.log((good - d + 1) * (draws - d + 1)) - F.log(d * (total - good - draws + d))

    def step(acc: Column, k: Column) -> Column:
        lp = F.when(k == low, zero).otherwise(acc["lp"] + log_ratio(k))
        top = F.greatest(acc["top"], lp)
        return F.struct(lp.alias("lp"), top.alias("top"), (acc["sum"] * F.exp(acc["top"] - top) + F.exp(lp - top)).alias("sum"))

    start = F.struct(zero.alias("lp"), zero.alias("top"), zero.alias("sum"))
    values = F.sequence(low, high)
    scale = F.aggregate(values, start, step)

    def seek(acc: Column, k: Column) -> Column:
        lp = F.when(k == low, zero).otherwise(acc["lp"] + log_ratio(k))
        below = acc["sum"] + F.exp(lp - acc["top"])
        found = F.coalesce(acc["found"], F.when(below >= acc["goal"], k))
        return F.struct(lp.alias("lp"), acc["top"].alias("top"), below.alias("sum"), acc["goal"].alias("goal"), found.alias("found"))

    return F.aggregate(
        F.array(scale),
        high,
        lambda acc, s: F.aggregate(values, F.struct(zero.alias("lp"), s["top"].alias("top"), zero.alias("sum"), (s["sum"] * u).alias("goal"), F.lit(None).cast("long").alias("found")), seek, lambda x: F.coalesce(x["found"], high)),
    )


def _drawing(seed: int, level: int):
    """The step that draws one source's blocks for the left half of a node."""

    def draw(acc: Column, x: Column) -> Column:
        take = _hypergeometric(acc["total"], x["n"], acc["left"], _uniform(F.lit(seed), F.lit(level), F.col("node"), x["source"]))
        return F.struct((acc["total"] - x["n"]).alias("total"), (acc["left"] - take).alias("left"), F.concat(acc["taken"], F.array(take)).alias("taken"))

    return draw


def shard_quotas(quotas: DataFrame, levels: int, seed: int, folder: str) -> DataFrame:
    """(source, shard, first, quota): how many blocks of each source each of 2**levels shards gets.

    quotas holds (source, n), one row a source, so one row holds the vector at the
    root.  Each level turns a node into its two halves; a node's draws go through
    the sources in order, conditional on what is left to draw.
    """
    root = quotas.where("n > 0").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("v"))
    node = root.where(F.size("v") > 0).select(F.lit(0).cast("long").alias("node"), "v")
    for level in range(levels):
        total = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        half = F.floor((total + F.pmod(F.col("node"), F.lit(2))) / 2).cast("long")

        first = F.struct(total.alias("total"), half.alias("left"), F.array().cast("array<bigint>").alias("taken"))
        node = node.withColumn("taken", F.aggregate("v", first, _drawing(seed, level), lambda x: x["taken"]))
        left = F.zip_with("v", "taken", lambda x, t: F.struct(x["source"].alias("source"), t.alias("n")))
        right = F.zip_with("v", "taken", lambda x, t: F.struct(x["source"].alias("source"), (x["n"] - t).alias("n")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("v")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("v")))
        node = node.select(F.explode(halves).alias("h")).select("h.node", "h.v")
        if level % LEVELS_AT_ONCE == LEVELS_AT_ONCE - 1:
            node = saved(node.repartition(spread(node.sparkSession), "node"), f"{folder}/level{level}")
    leaf = node.select(F.col("node").alias("shard"), F.explode("v").alias("x")).select("shard", "x.source", F.col("x.n").alias("quota"))
    return _running(saved(leaf, f"{folder}/leaves"), ["source"], F.floor(F.sqrt("shard")).cast("long"), [F.col("shard")], "quota", "first")


def _running(df: DataFrame, by: list[str], coarse: Column, order: list[Column], amount: str, name: str) -> DataFrame:
    """df with the sum of amount over the rows before, by order within by.

    coarse is a number that never falls in that order: sums of its values come
    first, then those of the rows within a value, so that no task has all rows of
    a group.  df is read twice.
    """
    df = df.withColumn("_coarse", coarse)
    ranges = df.groupBy(*by, "_coarse").agg(F.sum(amount).alias("_sum"))
    upper = Window.partitionBy(*by).orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_coarse", F.coalesce(F.sum("_sum").over(upper), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*by, "_coarse").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    return inside.join(ranges, [*by, "_coarse"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_coarse", "_before", "_inside")


ADDED = ("size", "source_size", "target", "taken", "takes")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Add size, source_size, target, taken and takes to docs (doc_id, source, text, ...).

    takes: an array of (pass, shard, words, order), one for each time that the
    document goes into the mix; words is its size but for the one document at the
    border of a source's target, unless whole documents are asked for.  how: the
    parameters of ``_mixed``.  docs is read more than once; give a stored table.
    """
    kept = [F.col("row").getField(c).alias(c) for c in without(docs, *ADDED).columns]
    return _mixed(docs, **how).select(*kept, *ADDED)


def _mixed(docs: DataFrame, seed: int = 17, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, whole: bool = False, size: str | None = None) -> DataFrame:
    """row (a struct of docs' columns) and the columns that ``mix`` adds; size names a column that already has the word counts."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    keys = ["source_no", "block"]
    counted = word_count(F.col("row.text")) if size is None else F.coalesce(F.col("row").getField(size).cast("long"), F.lit(0).cast("long"))
    packed = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"doc_id": F.col("row.doc_id"), "source": F.col("row.source")})
    thin = packed.select("doc_id", "source", counted.alias("size"))
    if size is None:
        thin = saved(thin, f"{folder}/sizes")

    totals = saved(thin.groupBy("source").agg(F.sum("size").alias("source_size")), f"{folder}/totals")
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    sources = source_targets(totals, share, most, weights).withColumns({"source_no": number, "n_blocks": n_blocks, "goal": F.floor(F.col("target") + 0.5).cast("long")})
    sources = saved(sources.withColumnRenamed("source", "of_source"), f"{folder}/sources")
    sent = F.broadcast if sources.count() <= BROADCAST_SOURCES else lambda df: df

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.join(sent(sources), F.col("source").eqNullSafe(F.col("of_source")))
        return rows.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("n_blocks")))

    blocks = dealt(thin).where("size > 0").groupBy(*keys).agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("source_size", "goal", "n_blocks")])
    place = lambda salt: F.pmod(F.xxhash64(F.lit(seed + salt), "pass", *keys), F.lit(1 << 40))
    coarse = lambda at: F.floor(F.col(at) * F.ceil(F.sqrt("n_blocks")) / F.lit(float(1 << 40))).cast("long")
    blocks = blocks.withColumn("pass", F.explode(F.array([F.lit(i) for i in range(most)]))).withColumns({"at": place(2), "drawn": place(3)})
    amount = F.least(F.greatest(F.col("goal") - F.col("pass") * F.col("source_size"), F.lit(0)), F.col("source_size"))
    taken = _running(saved(blocks, f"{folder}/passes"), ["source_no", "pass"], coarse("at"), [F.col("at"), F.col("block")], "words", "start")
    taken = taken.withColumn("take", F.least(F.greatest(amount - F.col("start"), F.lit(0)), F.col("words"))).where("take > 0")
    taken = saved(taken.select(*keys, "pass", "words", "take", "drawn", "n_blocks", F.lit(1).cast("long").alias("one")), f"{folder}/taken")
    ranked = _running(taken, ["source_no"], coarse("drawn"), [F.col("drawn"), F.col("pass"), F.col("block")], "one", "rank")
    ranked = saved(ranked.select(*keys, "pass", "words", "take", "rank"), f"{folder}/ranked")

    words = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    levels = 0
    while shard_words << levels < words:
        levels += 1
    quotas = shard_quotas(ranked.groupBy(F.col("source_no").alias("source")).agg(F.count("*").alias("n")), levels, seed, folder).where("quota > 0")
    ranks = quotas.select(F.col("source").alias("source_no"), "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)).alias("rank"))
    placed = ranked.join(ranks, ["source_no", "rank"])
    placed = placed.groupBy(*keys).agg(F.collect_list(F.struct("pass", "shard", "take")).alias("draws"), F.max(F.col("take") < F.col("words")).alias("border"))
    placed = saved(placed, f"{folder}/placed")

    def takes(words_of) -> Column:
        """The draws of a document's block as its own takes, those of no words left out."""
        own = F.transform("draws", lambda x: F.struct(x["pass"].alias("pass"), x["shard"].alias("shard"), words_of(x).alias("words"), F.xxhash64(F.lit(seed + 4), x["pass"], F.col("doc_id")).alias("order")))
        none = F.array().cast("array<struct<pass:int,shard:bigint,words:bigint,order:bigint>>")
        return F.array_sort(F.filter(F.coalesce(own, none), lambda x: x["words"] > 0))

    # at most one block a source and pass is cut by the target; only its documents need their place in it
    cut = placed.where("border").select(*keys, F.col("draws").alias("cut"))
    rows = dealt(packed).join(sent(cut), keys, "left")
    whole_blocks = rows.where("cut is null").join(placed.where("not border").select(*keys, "draws"), keys, "left").withColumn("size", counted)
    whole_blocks = whole_blocks.withColumn("takes", takes(lambda x: F.col("size")))
    tie = F.xxhash64(F.lit(seed + 5), F.col("row.text")) if "text" in docs.columns else F.lit(0)
    border = rows.where("cut is not null").withColumnRenamed("cut", "draws").withColumn("size", counted)
    inside = Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size", tie).rowsBetween(Window.unboundedPreceding, -1)
    border = border.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def cut_words(x: Column) -> Column:
        part = F.least(F.greatest(x["take"] - F.col("start"), F.lit(0)), F.col("size"))
        return F.when(2 * part > F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long")) if whole else part

    border = border.withColumn("takes", takes(cut_words))
    columns = ["row", "size", "source_size", "target", "takes"]
    out = whole_blocks.select(columns).unionByName(border.select(columns))
    return out.withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself, of whole documents: docs' columns, a row each time a document is taken, plus shard and order.

    Every shard is whole in one partition, its rows in hash order: written as
    they are, the files are the shards one after another, shuffled locally.
    """
    kept = [F.col("row").getField(c).alias(c) for c in without(docs, "shard", "order").columns]
    rows = _mixed(docs, whole=True, **how).select("row", F.explode("takes").alias("take"))
    rows = rows.select(*kept, F.col("take.shard").alias("shard"), F.col("take.order").alias("order"))
    return rows.repartition(spread(docs.sparkSession), "shard").sortWithinPartitions("shard", "order", "doc_id", *(["text"] if "text" in docs.columns else []))
