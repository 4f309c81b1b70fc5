"""The training-data pipeline: ``documents`` through five stages to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratewright.llm import language, near_duplicates, packing, secret_scan, toxicity
from ratewright.llm.common import held_out, read
from ratewright.sources.tables import written

COPY_WORDS, COPY_PERCENT = 5, 80  # the rule for near copies of a corpus; op8_near_duplicates has its own


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; texts that are NULL or without letters go, and those the network is unsure of.

    Without any labelled text all with a letter stay. Repeated rows are judged each for itself; an empty table stays empty.
    """
    network = language.fit(docs.where(~held_out(F.col("doc_id"))))
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.with_language(docs, network, into="__language")
    sure = (F.col("__language.lang_pred") != language.UNKNOWN) & (F.col("__language.score") >= language.least_score(network))
    return found.where(sure).select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below one half; without any labels all stay.

    A NULL text counts as empty and gets the score of the empty text. Repeated rows are judged alike; an empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels")
    classifier = toxicity.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    if not isinstance(classifier, toxicity.Classifier):
        return docs
    return docs.withColumn("__toxic", toxicity.score_of(classifier, F.col("text"))).where(F.col("__toxic") < 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of rows with the same id one stays, rows without an id all do."""
    found = near_duplicates.near_duplicates(docs, size=COPY_WORDS, percent=COPY_PERCENT)
    kept = found.where(F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__kept")).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    named = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi").withColumn("__first", first).where(F.col("__first") == 1)
    return named.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the secrets in their texts replaced by a mark; ``n_chars`` follows."""
    cleaned = secret_scan.masked(docs, secret_scan.scan(docs))
    changed = F.col("text").contains(secret_scan.MASK)
    return cleaned.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    NULL and empty texts are one end token; repeated rows are packed each for itself; an empty table gives no pieces.
    """
    # A worker's memory is that of all stages, so the encoder remembers fewer words here.
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, remembered=(320_000, 80_000))


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", packed_sequences),
]

#: The stages fit models and verify sketches, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": (run, ORACLE_SQL)}
