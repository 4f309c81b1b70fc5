"""Registered queries of this package, one per operator, over the whole of their tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratewright.llm import (
    bpe,
    centroids,
    language,
    line_dedup,
    near_duplicates,
    nearest,
    packing,
    personal_data,
    secret_scan,
    sketches,
    spelling,
    token_store,
    toxicity,
)
from ratewright.llm.common import held_out, read
from ratewright.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.fetch(store, store.documents, digest_only=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(read(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(read(spark, sf_dir, "documents")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    classifier = toxicity.fit(documents, labels.where(~held_out(F.col("doc_id"))))
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score_of(classifier, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    network = language.fit(documents.where(~held_out(F.col("doc_id"))))
    found = language.with_language(documents.select("doc_id", "text"), network)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op9_byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_repeated_lines(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_secret_scan": op2_secret_scan,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_personal_data": op4_personal_data,
    "op5_toxicity": op5_toxicity,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_language_id": op7_language_id,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_byte_bpe_round_trip": op9_byte_bpe_round_trip,
    "op10_retrieval_packing": op10_retrieval_packing,
    "op11_line_dedup": op11_line_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroid_clusters": op13_centroid_clusters,
}
