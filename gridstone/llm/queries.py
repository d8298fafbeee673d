"""The training-data queries, as `__spark_entry__` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridstone.llm import bpe, centroids, chat, decontam, editprints, licenses, quality, resampling, simhash, substring, tokens_orc, toxicity, urls
from gridstone.llm.common import table
from gridstone.session import ship

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap the benchmark: doc_id, n_items, first_word, last_word, most. Nulls, empty texts and empty tables: see `decontam`."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections of every document. A null or empty text has none."""
    return licenses.report(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of what they decode to. A null text is an empty one."""
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a smaller document has. A null text has no words."""
    return substring.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document. A null text fails; a null language is one of its own."""
    return quality.report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document by its nearest labelled examples. An empty text has the rate of texts without neighbours."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as read back from the prefix tree. A null text or role is empty."""
    return chat.report(table(spark, sf_dir, "conversations"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url. A null url has an empty host and path."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op9_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of every document's stored ids. A null text has the end id alone."""
    return tokens_orc.report(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document. A null text has fingerprint zero."""
    return simhash.report(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark. A null text has no features."""
    return resampling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_editprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited one. A null text is an empty one."""
    return editprints.neighbours(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector. Vectors with a null or non-finite component or of another length are left out."""
    return centroids.report(table(spark, sf_dir, "embeddings"))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: shipped(q) for q in (op1_decontam, op2_licenses, op3_bpe, op4_substring, op5_quality, op6_toxicity, op7_chat, op8_urls, op9_orc, op10_simhash, op11_resampling, op12_editprints, op13_centroids)}

ORACLE_SQL: dict[str, str] = {
    "op1_decontam": decontam.SQL,
    "op4_substring": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM words WHERE len(w) >= 50)
        ), firsts AS (
            SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM windows JOIN firsts USING (h) WHERE first < doc_id
        ), lists AS (
            SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id
        ), kept AS (
            SELECT doc_id, len(w) AS n_words, coalesce(len(ks), 0) AS n_removed,
                   CASE WHEN ks IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(ks, i)), lambda i: w[i]) END AS w
            FROM words LEFT JOIN lists USING (doc_id)
        )
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(w, ' '), '')) AS kept_sha256
        FROM kept
    """,
    "op7_chat": chat.SQL,
    "op8_urls": urls.SQL,
    "op11_resampling": resampling.SQL,
    "op13_centroids": centroids.SQL,
}
