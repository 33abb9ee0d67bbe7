"""Exact duplicates by deterministic block naming.

A text's UTF-8 bytes are cut into fixed-size blocks.  Equal blocks get equal
integer names, different blocks different ones: blocks are dealt to 2**31
buckets by hash, and a block's name is its bucket and its rank among the
bucket's blocks in sorted order, so the bytes themselves decide and a hash
collision only makes a bucket longer.  Then adjacent names are paired and the
pairs are named in the same way, until one name is left.  A text of k blocks
takes ceil(log2 k) rounds, a last block without a neighbour being paired with
nothing, so (k, name) is one identity without collisions.

Values that over a thousandth of a round's rows share (so at most a thousand)
are named first, from their distinct values, and handed to their rows by a
broadcast join; those rows are then dealt out evenly instead of by value.  Large
groups of equal texts get their kept row by broadcast too.

Only DataFrame functions are used.  Null text counts as empty, and all empty
texts are equal.  Of equal texts the row with the largest doc_id stays; if rows
repeat that doc_id, one of them stays; rows with a null doc_id stay only if no
other row is equal.  An empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, keyed_join, saved, shared_dir

BLOCK_BYTES = 4096
HOT_PARTS = 1000
HOT_LEAST = 1000


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, doc_id, k, pos, block, sha) of docs (doc_id, text): k blocks a row, sha on the first."""
    bytes_ = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", bytes_.alias("_bytes"), F.sha2(bytes_, 256).alias("_sha"))
    k = F.greatest(F.lit(1), F.ceil(F.octet_length("_bytes") / block_bytes)).cast("long")
    cut = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("pos"), F.substring(F.col("_bytes"), (i * block_bytes + 1).cast("int"), F.lit(block_bytes)).alias("block")))
    rows = rows.select("row_id", "doc_id", k.alias("k"), "_sha", F.explode(cut).alias("b"))
    return rows.select("row_id", "doc_id", "k", "b.pos", "b.block", F.when(F.col("b.pos") == 0, F.col("_sha")).alias("sha"))


def _bucket() -> Column:
    return F.pmod(F.col("_hash"), F.lit(1 << 31))


def named(df: DataFrame, columns: list[str], folder: str) -> DataFrame:
    """Replace columns by an integer ``name``, equal where they are all equal and only there.

    df has a row_id and is evaluated more than once.
    """
    df = df.withColumn("_hash", F.xxhash64(*columns))
    counts = saved(df.groupBy("_hash").count().where(F.col("count") >= HOT_LEAST), f"{folder}/counts")
    total = df.select("row_id").count() if counts.head(1) else 0
    hot = [r[0] for r in counts.where(F.col("count") * HOT_PARTS > total).select("_hash").collect()]
    order = [F.col(c) for c in columns]
    key, name = _bucket(), None
    if hot:
        values = df.where(F.col("_hash").isin(hot)).select("_hash", *columns).distinct()
        rank = F.dense_rank().over(Window.partitionBy(_bucket()).orderBy(*order))
        values = values.withColumn("_hot_name", F.shiftleft(_bucket(), 32) + rank * 2 + 1)
        df = df.join(F.broadcast(values), ["_hash", *columns], "left")
        spread_out = -1 - F.pmod(F.xxhash64("row_id"), F.lit(1 << 31))
        df = df.withColumn("_key", F.when(F.col("_hot_name").isNotNull(), spread_out).otherwise(_bucket()))
        df = df.withColumns({c: F.when(F.col("_hot_name").isNull(), F.col(c)) for c in columns})
        key, name = F.col("_key"), F.col("_hot_name")
    cold = F.shiftleft(_bucket(), 32) + F.dense_rank().over(Window.partitionBy(key).orderBy(*order)) * 2
    return df.withColumn("name", cold if name is None else F.coalesce(name, cold)).drop(*columns, "_hash", "_key", "_hot_name")


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, doc_id, k, name, sha), a row for each row of docs; (k, name) is equal for equal texts only."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    rows = saved(named(blocks(docs, block_bytes), ["block"], f"{folder}/b"), f"{folder}/0")
    longest = rows.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    done = rows.where("k = 1").select("row_id", "doc_id", "k", "name", "sha")
    left, n_round = rows.where("k > 1"), 0
    while 1 << n_round < longest:
        n_round += 1
        half = F.shiftright("pos", 1).alias("pos")
        even = F.col("pos") % 2 == 0
        pairs = left.groupBy("row_id", "doc_id", "k", half).agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"), F.max("sha").alias("sha"))
        pairs = saved(pairs, f"{folder}/p{n_round}")
        rows = saved(named(pairs, ["a", "b"], f"{folder}/b"), f"{folder}/{n_round}")
        dropped(spark, f"{folder}/p{n_round}")
        over = F.col("k") <= 1 << n_round
        done = done.unionByName(rows.where(over).select("row_id", "doc_id", "k", "name", "sha"))
        left = rows.where(~over)
    return done


def duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs (doc_id, text)."""
    folder = shared_dir(docs.sparkSession)
    ids = saved(identities(docs, block_bytes), f"{folder}/ids")
    groups = ids.groupBy("k", "name").agg(F.count("*").alias("group_size"), F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("doc_id"), (-F.col("row_id")).alias("row"))).alias("keep"))
    groups = saved(groups, f"{folder}/groups").withColumn("rows", F.col("group_size"))
    return keyed_join(ids, groups, ["k", "name"], "rows").select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("keep.row") == -F.col("row_id")).alias("kept"), F.col("sha").alias("text_sha256"))
