"""The opN queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, centroids, decontam, exact_dedup, langid, mixing, ngram_join, quality, quality_rules, token_ids, toxicity, url_filter, warc
from .shared import fold, saved, shared_dir, table

URL_RULES = "SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block') AS rules(host, path, verdict)"


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.digests(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(saved(docs, shared_dir(spark)), whole=True, size="size").select("doc_id", "size", "source_size", "target", "taken", "source", "takes")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 5 is 0), expected_grade, tail, top_tail, keep.

    Ratings have three grades: 0 for bad quality, 1 for good quality with toxic
    words, 2 for good quality without; grade 1 or more is kept.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.trained(docs, labels.where(fold("doc_id", 5) != 0).select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("rating")))
    return quality.graded(docs.select("doc_id", "text"), model, 1).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "expected_grade", "tail", "top_tail", "keep")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.trained(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.scored(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.trained(docs, docs.where(fold("doc_id", 3) != 1).select("doc_id", "lang"))
    return langid.labelled(docs.select("doc_id", "text"), network).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(URL_RULES)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, item_shingles, shared, containment of every item found in a document."""
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target is the texts that the labels call good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_rules.ratios(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    return quality_rules.judged(docs, weights).drop("text")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_ids, op2_mixing, op3_ngram_join, op4_quality, op5_exact_dedup, op6_toxicity, op7_language_id, op8_url_filter, op9_warc, op10_decontamination, op11_centroids, op12_quality_rules, op13_alignment)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_SHINGLES = """
    SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s, len(w) AS n_words
    FROM (SELECT {id} AS id, {words} AS w FROM {table})"""

_DISTANCE = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
_NEAREST = f"(SELECT v.vec_id, arg_min(struct_pack(k := c.k, d := {_DISTANCE}), ({_DISTANCE}, c.k)) AS a FROM v, c{{r}} AS c GROUP BY v.vec_id)"


def _centroid_rounds() -> str:
    """The rounds one after another: c0 are the seeds, c1 .. c5 the moved centroids."""
    rounds = []
    for r in range(centroids.ROUNDS):
        means = f"""SELECT k, list(m ORDER BY i) AS x FROM (SELECT a.k AS k, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
 FROM {_NEAREST.format(r=r)} n JOIN v USING (vec_id), (SELECT unnest(range(1, 65)) AS i) s GROUP BY a.k, i) g GROUP BY k"""
        rounds.append(f"c{r + 1} AS (SELECT o.k, coalesce(n.x, o.x) AS x FROM c{r} o LEFT JOIN ({means}) n ON n.k = o.k)")
    return ",\n".join(rounds)


ORACLE_SQL: dict[str, str] = {
    "op11_centroids": f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h LIMIT 40) s),
{_centroid_rounds()},
f AS (SELECT vec_id, a.k AS k, a.d AS d FROM {_NEAREST.format(r=centroids.ROUNDS)} n)
SELECT vec_id, CAST(f.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(x, ',')) AS centroid_sha256 FROM f JOIN c5 ON c5.k = f.k""",
    "op3_ngram_join": f"""
WITH RECURSIVE sh AS ({_SHINGLES.format(id="doc_id", words=_WORDS, table="documents")}),
sizes AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs p JOIN sizes x ON x.id = p.a JOIN sizes y ON y.id = p.b WHERE 100 * p.n >= 75 * (x.n + y.n - p.n)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.id)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN sizes s ON s.id = d.doc_id JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) r ON r.id = d.doc_id""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op8_url_filter": r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, translate(coalesce(regexp_extract(r, '^[^/?#]*'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
         FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)""",
    "op9_warc": """
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to, true AS whole
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
             CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first_id FROM pages)""",
    "op10_decontamination": f"""
WITH q AS ({_SHINGLES.format(id="item_id", words=_WORDS, table="benchmark")}),
d AS ({_SHINGLES.format(id="doc_id", words=_WORDS, table="documents")}),
n AS (SELECT id, count(*) AS n FROM q GROUP BY id),
pairs AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) AS k FROM q JOIN d ON q.s = d.s GROUP BY 1, 2)
SELECT doc_id, item_id, n AS item_shingles, k AS shared, k / n AS containment FROM pairs JOIN n ON n.id = item_id WHERE 4 * k >= 3 * n""",
}
