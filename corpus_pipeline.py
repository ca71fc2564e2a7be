"""The corpus pipeline: documents in, token ids out, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every
stage's result as Parquet to the shared folder and reads it back for the next. All stages
but the last return the columns of ``documents``.

What each stage decides: the quality classifier drops the documents it rejects; line dedup takes
later occurrences of three-line windows out of the texts, and drops a text that loses all its
words; the n-gram join keeps one document of each group; mixing brings all documents into the
order of its schedule and drops none; encoding returns the ids and digests per document, with
the places that this order gives it, as rows of Parquet read again have no order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagefacts.llm import bpe, line_dedup, mixing, ngram_join, quality_classifier
from pagefacts.llm.queries import VOCABULARY
from pagefacts.llm.texts import NOT_SPACE, row_key, table
from pagefacts.plans.staging import ensure_shared_folder, new_folder, scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows gone; n_chars is that of the new text."""
    cleaned = line_dedup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.col("row.text").rlike(NOT_SPACE)
    changed = F.when(F.col("n_removed") > 0, F.length("row.text")).otherwise(F.col("row.n_chars"))
    row = F.col("row").withField("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return cleaned.where(~emptied).select(row.alias("row")).select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return ngram_join.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which the schedule interleaves their sources."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, decoded_sha256, and position, slot, place and in_mix.

    Position is that of the row in the order which the stage before wrote; slot, place and in_mix follow from
    this order too, so rows in another order get other places.
    Rows equal in doc_id and text take the first of their places, as they do there.
    """
    path = public_tokenizers.path(VOCABULARY)
    keyed = docs.withColumn("key", row_key(F.col("doc_id"), F.col("text"))).select("doc_id", "text", "key.*")
    found = bpe.digests(bpe.encode_documents(keyed, path, public_tokenizers.PATTERN, "a", "b"), "ids", "a", "b")
    placed = mixing.schedule_of_order(docs)
    places = placed.groupBy("key.a", "key.b").agg(F.min(F.struct("position", "slot", "place", "in_mix")).alias("at"))
    return found.join(places, ["a", "b"]).drop("a", "b").select("*", "at.*").drop("at")


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("mix_sources", mixed),
    ("bpe", encoded),
]

# The trained classifier has no form in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        # What a stage writes on its way is emptied when its result is written.
        with scratch(spark):
            kept = function(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return docs
