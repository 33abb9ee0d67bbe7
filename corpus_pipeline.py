"""A corpus pipeline: five operators, each working on all that the one before kept.

    toxicity        documents scored 0.5 or more go
    ngram_join      of each group of near copies one row stays, that with the smallest id (null last)
    decontaminate   documents that contain a benchmark item go
    mix             sources are mixed to target weights; a whole document comes once each time it is taken,
                    in the locally shuffled shards of the mix
    token_ids       the mix is written as bit-packed token shards in its own order, which is that of the rows in
                    the files that the stage before has written; the result is their digest

Null and empty texts pass every filter, but the mix takes none of them: their
size is 0 words, and so is that of a text of nothing but white space.  Rows are
told apart by their texts and places, so rows that repeat a doc_id go or stay
each for itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociflow.llm import decontam, mixing, ngram_join, token_ids, toxicity
from lociflow.llm.shared import dropped, fold, made, released, saved, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    machine = toxicity.trained(table(spark, sf_dir, "documents"), labels)
    return toxicity.scored(docs, machine).where("toxic_score < 0.5").select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.without_copies(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs).select(*COLUMNS)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return token_ids.digests(spark, placed, public_tokenizers.path("byte_bpe_50k.json"), ("file", "row"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_copies),
    ("decontaminate", without_benchmark),
    ("mix", to_target_weights),
    ("token_ids", to_token_ids),
]

# The scores, the draws of the mix and the token ids have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs, folder, last = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        since, path = len(made()), f"{folder}/{k}-{name}"
        docs = saved(stage(spark, docs, sf_dir), path)
        if k < len(STAGES) - 1:  # the last stage's folders hold the token shards
            released(spark, since)
        if last:
            dropped(spark, last)
        last = path
    return docs
