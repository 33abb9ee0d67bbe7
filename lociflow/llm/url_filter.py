"""URL rules by a blocked Bloom filter before an exact hash join.

A rule is (host, path, verdict).  It fits a URL whose host is the rule's or a
subdomain of it and whose path starts with the rule's; the longest rule wins.
The rules' canonical URLs, host followed by path, are listed in a blocked Bloom
filter: a hash picks one 64-bit block and sets a few bits in it.  A URL asks
for each host suffix with each of the path lengths that the rules have.  Those
whose block has all bits are possible hits, and an equi-join with the rules
removes the false positives.  The filter has at most ``MOST_BLOCKS`` rows of 16
bytes, which bounds what is broadcast; the rules themselves are joined by
shuffle unless Spark sees that they are small.

A URL asks with as many labels of its host as the rule of most labels has.  The
URLs are judged once for each distinct (host, path), and verdicts of pairs that
many rows share are handed out by broadcast.

Only DataFrame functions are used.  A null URL, or one without ``://``, has an
empty host and path and fits no rule.  What fits no rule gets the default
verdict, by default ``allow``.  Repeated rows are each judged; null ids, other
columns and empty tables pass through; columns of the added names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import block_of, bloom_filter, may_contain
from .shared import keyed_join, without

MOST_BLOCKS = 1 << 20
ADDED = ("host", "path", "rule", "verdict")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host after the first :// up to / ? # or the end, A-Z lower-cased; the path from there up to ? # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages, in the place of columns of these names; rules has (host, path, verdict).

    pages is read more than once.
    """
    host, path = url_parts(F.col("row").getField(url))
    rows = pages.select(F.struct(*pages.columns).alias("row")).select("row", host.alias("host"), path.alias("path"))
    listed = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    listed = listed.withColumn("key", F.concat_ws("/", "rule_host", F.expr("substring(rule_path, 2)")))
    most = F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(1))
    figures = listed.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.length("rule_path"))).alias("lengths"), most.alias("labels")).first()
    n_blocks = max(16, min(MOST_BLOCKS, 1 << max(0, figures["n"] // 4).bit_length()))
    labels = F.split(F.col("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(figures["labels"]))), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))
    starts = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in figures["lengths"]] or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
    asked = F.flatten(F.transform(suffixes, lambda h: F.transform(starts, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    counts = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    asking = counts.where("host != ''").select("host", "path", F.explode(asked).alias("a")).select("host", "path", F.col("a.h").alias("rule_host"), F.col("a.p").alias("rule_path"))
    asking = asking.withColumn("key", F.concat_ws("/", "rule_host", F.expr("substring(rule_path, 2)")))
    possible = asking.withColumn("block", block_of(F.col("key"), n_blocks)).join(F.broadcast(bloom_filter(listed, n_blocks)), "block")
    possible = possible.where(may_contain(F.col("bits"), F.col("key")))
    hits = possible.join(listed.drop("key"), ["rule_host", "rule_path"])
    text = F.concat("rule_host", "rule_path")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    out = keyed_join(rows, best, ["host", "path"], "n", counts, "left")
    kept = [F.col("row").getField(c).alias(c) for c in without(pages, *ADDED).columns]
    return out.select(*kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
