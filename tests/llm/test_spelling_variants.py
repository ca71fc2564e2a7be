"""Spelling variants against a version that compares every two words."""

import random
import re
import zlib
from collections import Counter

import edge
import pytest
from pyspark.sql import functions as F

from pagefacts.llm import spelling_variants as sv

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least_chars=7, least_count=2):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= least_chars and n >= least_count}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(words, ahead=10):
    partners = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for word, found in partners.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= ahead * words[word] else None
    rows = []
    for word, found in partners.items():
        root = word
        while form[root] is not None:
            root = form[root]
        rows.append((word, form[word], root, words[word], len(found), words.get(form[word])))
    return sorted(rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def texts():
    rng = random.Random(5)
    stems = ["abcdefg", "abcdefgh", "Überlaufen", "zzzzzzzz", "aaaaaaa", "naïveté", "éééééééé"]
    said = []
    for stem, times in zip(stems, (900, 40, 300, 60, 30, 200, 20)):
        said += [stem] * times
        for _ in range(60):
            at, letter = rng.randrange(len(stem)), rng.choice("abzé×÷ÿ")
            changed = rng.choice([stem[:at] + letter + stem[at:], stem[:at] + letter + stem[at + 1 :], stem[:at] + stem[at + 1 :]])
            said += [changed] * rng.choice([1, 2, 3, 30])
    rng.shuffle(said)
    seps = [" ", ", ", "\n", "-", "1", "_", "Ā", "'"]
    return [(i, "".join(w + rng.choice(seps) for w in said[i::200])) for i in range(200)]


@pytest.mark.parametrize("symbols", [2, 8, 36])
def test_as_the_plain_version(spark, symbols):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = plainly(counted(rows))
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] not in (None, r[2]) for r in expected)
    assert rows_of(sv.variants(docs, symbols=symbols)) == expected


def test_counts_with_short_words(spark):
    rows = [(1, "Aa aA bb ÄÄ ää aa"), (None, "aa"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["word"]: r["n"] for r in sv.counted_words(docs, least_chars=2, least_count=1).collect()}
    assert got == counted(rows, 2, 1)


def words_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


def test_one_hot_class_is_cut_into_blocks(spark, monkeypatch):
    """All words have the same reduced word; every two that are near must still meet once."""
    monkeypatch.setattr(sv, "BLOCK", 4)
    symbol = {c: int(sv._scrambled(sv.np.array([ord(c) + 1], dtype=sv.np.uint64))[0] % sv.np.uint64(8)) for c in "abcdefghijklmnopqrstuvwxyz"}
    alike = max(({c for c in symbol if symbol[c] == s} for s in set(symbol.values())), key=len)
    rng = random.Random(2)
    words = {"".join(rng.choices(sorted(alike), k=7)): rng.randint(1, 99) for _ in range(400)}
    got = sorted(tuple(sorted((r["word_1"], r["word_2"]))) for r in sv.near_words(words_of(spark, words)).collect())
    assert got == sorted((a, b) for a in words for b in words if a < b and near(a, b))


def test_words_of_any_length(spark):
    long = "ab" * 40_000
    words = {long: 50, long + "c": 3, long[:70] + "x" + long[71:]: 2, long[1:]: 4, "x" * 64: 9, "x" * 65: 8, "x" * 66: 7}
    got = sorted(tuple(sorted((r["word_1"], r["word_2"]))) for r in sv.near_words(words_of(spark, words)).collect())
    expected = [(long, w) for w in words if w not in (long, *("x" * i for i in (64, 65, 66)))] + [("x" * 64, "x" * 65), ("x" * 65, "x" * 66)]
    assert got == sorted(tuple(sorted(p)) for p in expected)


def test_chains_of_forms(spark):
    words = {"abcdefghij"[:7] + "x" * i: 10**i for i in range(12)}
    found = sv.forms(words_of(spark, words), sv.near_words(words_of(spark, words)))
    got = {r["word"]: r["root"] for r in sv._last_forms(found).collect()}
    assert got == {w: "abcdefg" + "x" * 11 for w in list(words)[:-1]}


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge.ROWS]
    docs = edge.documents(spark)
    assert rows_of(sv.variants(docs)) == plainly(counted(rows))
    more = docs.select("doc_id", "text").unionByName(
        spark.createDataFrame([(50, "a" * 150_000), (51, "a" * 149_999), (52, "a" * 149_999)], "doc_id bigint, text string")
    )
    got = {len(r["word"]): r["n_near"] for r in sv.variants(more).where(F.length("word") > 1000).collect()}
    assert got == {150_000: 1, 149_999: 1}
    assert rows_of(sv.variants(edge.empty(spark))) == []
    with pytest.raises(ValueError, match="symbols"):
        sv.near_words(words_of(spark, {"a": 1}), symbols=1)
