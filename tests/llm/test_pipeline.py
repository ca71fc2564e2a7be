"""The pipeline against a version without Spark, and the contract of its stages."""

import hashlib
import math
from pathlib import Path

import corpus_pipeline
import edge
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import dedup_plain, join_plain

from pagefacts.llm import bpe, mixing, quality_classifier
from pagefacts.plans.staging import new_folder

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no tables")


@needs_tables
def test_run_like_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    model = quality_classifier.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(texts) == docs.count()
    good = {i: t for i, t in texts.items() if quality_classifier.scores(model, [t])[0] >= quality_classifier.THRESHOLD}
    assert 0 < len(good) < len(texts)
    cleaned = dedup_plain(list(good.items()))
    cleaned = {i: t for i, t in cleaned.items() if t == good[i] or t.split()}
    groups = {}
    for i, (group, _, _) in join_plain(cleaned).items():
        groups.setdefault(group, []).append(i)
    kept = [min(ids) for ids in groups.values()]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = bpe.Bpe(file.read(), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for i in kept:
        ids = np.array(library.encode_ordinary(cleaned[i]), dtype="<u4").tobytes()
        expected[i] = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(cleaned[i].encode()).hexdigest())
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
    assert len(rows) == len(expected)


@needs_tables
def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, SF_DIR).dtypes == docs.dtypes, name


def test_mixed_rows_are_in_the_order_of_the_schedule(spark):
    rows = [(i, f"text {i}", None, f"s{i % 7 % 3}", i) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int")
    placed = {r["doc_id"]: (r["slot"], r["place"]) for r in mixing.schedule(docs).collect()}
    order = [placed[r["doc_id"]] for r in mixing.mix(docs).collect()]
    assert order == sorted(placed.values())


def test_stages_over_edge_cases(spark):
    """Each stage on nulls, empty and long texts, repeated rows and columns of other meaning."""
    folder = new_folder(spark, "edge")
    labels = spark.createDataFrame([(1, 1), (3, 1), (9, 0), (13, 1)], "doc_id bigint, quality int")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = edge.documents(spark)
    docs.write.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, folder)
        assert 0 < out.count() <= docs.count(), name
        assert function(spark, edge.empty(spark), folder).count() == 0, name
    assert corpus_pipeline.run(spark, folder).count() > 0


def schedule_plain(sources, block_rows=4):
    """(slot, place, in_mix) by doc_id: Pfair windows, earliest deadline first, slot by slot. Takes {doc_id: source}."""
    ordered = {}
    for i in sorted(sources, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        ordered.setdefault(sources[i], []).append(i)
    names = sorted(ordered, key=lambda s: (s is not None, s))
    total = sum(len(ordered[s]) ** 0.7 for s in names)
    shares = {s: max(1, math.floor(len(ordered[s]) ** 0.7 / total * 1000 + 0.5)) for s in names}
    period = sum(shares.values())
    blocks = {s: [ordered[s][at : at + block_rows] for at in range(0, len(ordered[s]), block_rows)] for s in names}
    taken, out, end, slot = dict.fromkeys(names, 0), {}, None, 0
    while len(out) < len(sources):
        due = []
        for at, s in enumerate(names):
            if taken[s] * period // shares[s] <= slot:
                due.append((-(-(taken[s] + 1) * period // shares[s]), at, s))
        source = min(due)[2]
        if taken[source] < len(blocks[source]):
            out |= {i: (slot, place, end is None) for place, i in enumerate(blocks[source][taken[source]])}
        elif end is None:
            end = slot
        taken[source] += 1
        slot += 1
    return out


@needs_tables
def test_run_returns_the_schedule(spark):
    """From an input of many files; the rows that come out are placed as a plain schedule places them."""
    folder = new_folder(spark, "many-files")
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{name}.parquet") for name in ("documents", "labels"))
    # Uneven sources, so that the small ones run out.
    docs = docs.withColumn("source", F.expr("element_at(array('a', 'a', 'a', 'a', 'a', 'b', 'c'), int(doc_id % 7) + 1)"))
    docs.repartition(12).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    found = {r["doc_id"]: (r["slot"], r["place"], r["in_mix"]) for r in rows}
    assert len(found) == len(rows) > 100 and {kept for _, _, kept in found.values()} == {True, False}
    assert found == schedule_plain({i: source[i] for i in found})


def test_places_follow_the_order_of_the_stage_before(spark):
    """The last stage takes positions, slots and places from the order that was written, in files of any size."""
    source = {i: "abc"[i % 7 % 3] for i in range(300)}
    rows = [(i, f"text {i}", None, s, i) for i, s in source.items()]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_chars int")
    found = {}
    orders = {"rising": F.col("doc_id"), "falling": -F.col("doc_id"), "uneven": F.col("doc_id") * 7 % 300}
    for name, order in orders.items():
        folder = new_folder(spark, name)
        # Parts of growing size, which a scan would not read in their order.
        part = F.floor(F.sqrt((order + 300) % 300))
        docs.repartitionByRange(18, part).sortWithinPartitions(part, order).write.parquet(folder)
        out = corpus_pipeline.encoded(spark, spark.read.parquet(folder), folder)
        found[name] = {r["doc_id"]: (r["position"], r["slot"], r["place"], r["in_mix"]) for r in out.collect()}
    expected = {"rising": sorted(source), "falling": [0, *range(299, 0, -1)], "uneven": sorted(source, key=lambda i: i * 7 % 300)}
    plan = schedule_plain(source)
    by_source = {s: sorted(plan[i][:2] for i in source if source[i] == s) for s in "abc"}
    end = min(slot for slot, _, inside in plan.values() if not inside)
    for name, ids in expected.items():
        taken = dict.fromkeys("abc", 0)
        for position, i in enumerate(ids):
            slot, place = by_source[source[i]][taken[source[i]]]
            taken[source[i]] += 1
            assert found[name][i] == (position, slot, place, slot < end), (name, i)
