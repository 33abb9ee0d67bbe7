"""A bounded, reproducible sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sampled_ids(labels: DataFrame, label: Column, most: int, seed: int = 0) -> DataFrame:
    """(doc_id, label) of at most ``most`` ids of each label, the first by hash; ids without a label are left out.

    The hash order is the same at every size and partitioning.  An id with several
    labels has the largest.
    """
    one = labels.select("doc_id", label.alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    # the threshold keeps about twice what is needed, so that the ranking below is small
    counts = one.groupBy("label").count()
    share = F.broadcast(counts.select("label", (F.lit(2.0 * most) / F.col("count")).alias("share")))
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = one.join(share, "label").where((u < F.col("share")) | (F.col("share") >= 0.5)).withColumn("u", u)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("u", "doc_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "label")


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label), one row for each sampled id that docs has; of rows that share an id that with the first hash of its text.

    The ids are few enough to broadcast by their documented bound, and so are the rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("row")).select("doc_id", "row.*")
