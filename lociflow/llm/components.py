"""Connected components by alternating large-star and small-star steps.

Each step is a grouping for the smallest neighbour and a join with it; nodes with
very many links get their smallest neighbour by broadcast.  Every round is
written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, keyed_join, saved


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    return keyed_join(both, least, "u", "n", total=2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = keyed_join(e, least, "u", "n", total=n).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, component) of every node of links (a, b), each node once; component is its smallest node."""
    e = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = saved(e, f"{folder}/cc0")
    state = lambda x: x.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    was, n = state(e), 0
    while was[0]:
        n += 1
        large = saved(_large_star(e, was[0]), f"{folder}/large")
        new = saved(_small_star(large, 2 * was[0]), f"{folder}/cc{n}")
        now = state(new)
        dropped(e.sparkSession, f"{folder}/cc{n - 1}")
        e = new
        if now == was:
            break
        was = now
    dropped(e.sparkSession, f"{folder}/large")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
