"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import edge
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from pagefacts.llm import (
    bpe, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, secrets, sharding, topk,
)

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def labels(docs):
    spark = docs.sparkSession
    return spark.createDataFrame([(1, 1), (3, 1), (4, 0), (9, 0), (None, 1), (5, None)], "doc_id bigint, quality int")


OPERATORS = {
    "secrets": secrets.report,
    "bpe": lambda docs: bpe.digests(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN)),
    "line_dedup": line_dedup.dedup_lines,
    "quality": lambda docs: quality_classifier.classify(docs, labels(docs)),
    "mixing": mixing.schedule,
    "sharding": sharding.shard_by_bytes,
    "ngram_join": ngram_join.near_duplicates,
    "quality_rules": quality_rules.apply_rules,
    "language": lambda docs: language_id.identify(docs),
}


@pytest.fixture(scope="module")
def docs(spark):
    return edge.documents(spark).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(docs, name):
    assert OPERATORS[name](docs).count() == len(edge.ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](edge.empty(spark)).collect() == []


@pytest.mark.parametrize(
    "keep",
    [
        lambda d: line_dedup.dedup_lines(d).select("row.*"),
        ngram_join.one_of_each,
        mixing.mix,
        lambda d: quality_classifier.keep_good(d, labels(d)),
    ],
    ids=["line_dedup", "one_of_each", "mix", "keep_good"],
)
def test_filters_keep_the_columns(docs, keep):
    kept = keep(docs)
    assert kept.columns == docs.columns
    assert 0 < kept.count() <= len(edge.ROWS)


def test_quality_rules_values(docs):
    rows = {r["doc_id"]: r for r in quality_rules.apply_rules(docs.where("doc_id is not null")).collect()}
    assert (rows[7]["n_words"], rows[7]["base_failed"], rows[7]["kept"]) == (0, True, False)
    assert (rows[8]["n_words"], rows[9]["n_words"], rows[10]["word_chars"]) == (0, 4, 2)
    assert (rows[11]["n_words"], rows[11]["n_repeat_words"], rows[11]["kept"]) == (60_000, 60_000, False)
    assert rows[1]["kept"]


def test_line_dedup_values(docs):
    rows = {r["row"]["doc_id"]: r for r in line_dedup.dedup_lines(docs.where("doc_id is not null")).collect()}
    assert rows[4]["n_removed"] == 0 and rows[4]["row"]["text"] == edge.LINES
    assert rows[5]["n_removed"] == 6 and rows[5]["row"]["text"] == "and a line more"
    assert (rows[7]["row"]["text"], rows[7]["n_lines"]) == (None, 0)
    assert (rows[6]["row"]["text"], rows[8]["row"]["text"]) == ("", "  \n\t ")


def test_language_of_texts_without_letters(docs):
    rows = language_id.identify(docs).where("doc_id in (6, 7, 8, 9)").collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


def test_near_duplicates_values(docs):
    rows = ngram_join.near_duplicates(docs).where("doc_id is not null").collect()
    found = {r["doc_id"]: r for r in rows}
    assert [found[i]["class_id"] for i in (1, 2, 3)] == [1, 1, 1]
    assert (found[1]["n_links"], found[1]["n_copies"], found[3]["n_links"]) == (1, 3, 1)
    assert found[6]["class_id"] == 6 and found[7]["class_id"] == 7 and found[8]["n_links"] == 0
    kept = [r["doc_id"] for r in ngram_join.one_of_each(docs).collect()]
    # 5 shares 32 of 36 shingles with 4, and 2 and 3 are copies of 1 but for three words.
    assert sorted(i for i in kept if i is not None) == [1, 4, *range(6, 14)]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 9.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, [1.0]), (9, []), (20, [-1.0, -0.001]), (None, [1.0, 1.0]), (40, [0.0, 0.0]),
    ]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<double>, rank string")
    found = topk.top_k(vectors, F.col("vec_id") % 20 == 0, 3).collect()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found}
    assert got[0, 1] == (1, 4096) and got[0, 2] == (2, 4096) and got[0, 3] == (3, 2048)
    assert got[20, 1] == (40, 0) and got[20, 2] == (3, -2624)
    assert {q for q, _ in got} == {0, 20, 40}
    assert topk.top_k(vectors.where("false"), F.col("vec_id") % 20 == 0).collect() == []
