r"""Quality rules: counts of a text, and a log-likelihood ratio of hashed n-grams.

Words are ``[^\x20\x09-\x0D]+``.  The base counts are the words' characters, the
signs, the lines that came before, and the words in windows of three words that
the text has twice or more; a text with too few words or too many repeated ones
fails.

The n-grams are the endings (last ``ENDING`` characters) of two neighbouring words
(the last word stands alone), hashed to ``BUCKETS`` places.  Two multinomials over the places,
that of the trusted target texts and that of the raw corpus, give each n-gram the
logarithm of its ratio; a text's score is the mean over all its n-grams, so that
long and short texts compare.  The texts with a score of ``LEAST_SCORE`` or more are
kept, each by itself and always alike: nothing is drawn.

Endings show junk (signs hung on words, shouting, lists, the same word again and
again) with few different n-grams, so the counts are dense and rare words do not
blur the score.  The raw corpus is all of docs; the target is the texts of all trusted ids.

All is DataFrame expressions: each text is judged where it is read, and nothing is
shuffled but the counts of the places and, with more than ``BROADCAST_MOST`` trusted
ids, the texts that meet them.  Null and empty texts have no words, score 0
and fail.  Without a trusted text every score is 0, and the base rules decide.
Repeated rows are each judged, an empty table gives an empty result, and other
columns pass through, but for those of the names that are added.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, saved, shared_dir, without

BUCKETS, ENDING, LEAST_SCORE, BROADCAST_MOST = 1 << 14, 3, -0.09, 1_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50
# fixed values: what is between words, what is a word, and the characters that count as signs
SPACES, WORD, SIGNS = " \t\n\x0b\x0c\r", r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
PLACE_BITS = (1 << 30) - 1
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _buckets(words: Column) -> Column:
    """The places of the endings of each word and the one after it; the last place is that of the last word alone."""
    endings = F.transform(words, lambda w: F.substring(w, -ENDING, ENDING))
    return _let(endings, lambda e: F.transform(e, lambda x, i: F.xxhash64(x, F.get(e, i + 1)).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with weights, the log ratio of every place; trusted has a column doc_id.

    Counts are raised by one, so that a place without texts has a ratio too.
    """
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(1).alias("label")).where("doc_id is not null").distinct()
    # every id counts either way: so many are sent to all tasks, more meet the texts by a shuffle
    few = ids.limit(BROADCAST_MOST + 1).count() <= BROADCAST_MOST
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = told.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left").select(F.col("label").isNotNull().alias("trusted"), _words(F.col("text")).alias("words"))
    grams = told.select("trusted", F.explode(_buckets(F.col("words"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("trusted").alias("target"))
    counts = saved(counts, f"{shared_dir(docs.sparkSession)}/counts")
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    share = lambda name: F.ln((F.coalesce(name, F.lit(0)) + 1) / F.lit(float(total[name] + BUCKETS)))
    weight = share("target") - share("raw") if total["target"] else F.lit(0.0)
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", weight.alias("weight")))), lambda r: r["weight"]).alias("weights"))


def _hashed_windows(words: Column) -> Column:
    """For every window of three words the upper bits of its hash, and its place below them; sorted."""
    upper = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~PLACE_BITS))
    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: upper(w, i).bitwiseOR(i.cast("long")))
    return F.sort_array(_let(words, lambda w: F.when(F.size(w) > 3, windows(w)).otherwise(F.array().cast("array<long>"))))


def _near(hashed: Column) -> Column:
    """The places of the windows that have a neighbour with the same upper bits."""
    same = lambda x, y: F.coalesce(F.shiftright(x, 30) == F.shiftright(y, 30), F.lit(False))
    return _let(hashed, lambda h: F.transform(F.filter(h, lambda x, k: same(x, F.get(h, k - 1)) | same(x, F.get(h, k + 1))), lambda x: x.bitwiseAND(F.lit(PLACE_BITS)).cast("int")))


def _alike(a: Column, b: Column) -> Column:
    return F.coalesce((a["a"] == b["a"]) & (a["b"] == b["b"]) & (a["c"] == b["c"]), F.lit(False))


def _covered(places: Column, words: Column) -> Column:
    """How many words are in the windows at these places that come twice or more among them."""
    window = lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))
    twice = lambda s: F.filter(s, lambda x, k: _alike(x, F.get(s, k - 1)) | _alike(x, F.get(s, k + 1)))
    at = _let(F.sort_array(F.transform(places, window)), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
    steps = _let(at, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda n, step: n + step)


def judged(docs: DataFrame, weights: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    docs = without(docs, *ADDED)
    own = docs.columns
    full, words, hashed, near = (free_name(docs, n) for n in ("full", "words", "hashed", "near"))
    text = docs.withColumn(full, F.coalesce(F.col("text").cast("string"), F.lit("")))
    bare = F.col(full)
    for c in SPACES:  # every one is a single byte
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    d = text.select(
        *own,
        _words(F.col(full)).alias(words),
        (F.length(full) - F.octet_length(full) + F.octet_length(bare)).cast("long").alias("word_chars"),
        F.regexp_count(full, F.lit(SIGNS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    d = d.withColumn("n_words", F.size(words).cast("long")).withColumn(hashed, _hashed_windows(F.col(words)))
    d = d.withColumn(near, _near(F.col(hashed)))
    covered = _let(F.col(words), lambda w: _covered(F.col(near), w))
    d = d.withColumn("n_repeat_words", F.when(F.size(near) > 0, covered).otherwise(0))
    # BUCKETS numbers, as one constant of the plan
    table = F.from_json(F.lit(json.dumps(weights.first()["weights"])), "array<double>")
    total = F.aggregate(_buckets(F.col(words)), F.lit(0.0), lambda n, b: n + F.get(table, b))
    d = d.withColumn("score", F.when(F.col("n_words") > 0, total / F.col("n_words")).otherwise(0.0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    return d.select(*own, *ADDED[:-1], (~F.col("base_failed") & (F.col("score") >= least_score)).alias("kept"))
