"""The operators of this subpackage as queries over the given tables, and their results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from pagefacts.llm import (
    bpe, fill_in_middle, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, reply_trees, secrets,
    sharding, spelling_variants, topk,
)
from pagefacts.llm.texts import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op2_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode_documents(docs, path, public_tokenizers.PATTERN))


def op4_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_removed", "row.text")


def op5_quality(spark, sf_dir):
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mix_sources(spark, sf_dir):
    placed = mixing.schedule(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "source", "slot", "place", "in_mix")


def op7_shards(spark, sf_dir):
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op8_ngram_join(spark, sf_dir):
    found = ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_copies", "copy_id")


def op9_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op10_language(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_chat_format(spark, sf_dir):
    return reply_trees.report(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark, sf_dir):
    return spelling_variants.variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark, sf_dir):
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_secret_scan": op2_secret_scan,
        "op3_bpe": op3_bpe,
        "op4_line_dedup": op4_line_dedup,
        "op5_quality": op5_quality,
        "op6_mix_sources": op6_mix_sources,
        "op7_shards": op7_shards,
        "op8_ngram_join": op8_ngram_join,
        "op9_quality_rules": op9_quality_rules,
        "op10_language": op10_language,
        "op11_chat_format": op11_chat_format,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": topk.top_k_sql(),
        "op2_secret_scan": secrets.report_sql(),
        "op4_line_dedup": line_dedup.dedup_sql(),
        "op6_mix_sources": mixing.mix_sql(),
        "op8_ngram_join": ngram_join.join_sql(),
        "op9_quality_rules": quality_rules.rules_sql(),
        "op11_chat_format": reply_trees.report_sql(),
        "op12_spelling_variants": spelling_variants.variants_sql(),
        "op13_fill_in_middle": fill_in_middle.report_sql(),
    }
