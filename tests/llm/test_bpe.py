"""Byte-level BPE against the tiktoken library and against the plain rule."""

import base64
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagefacts.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    with open(PATH, "rb") as file:
        return bpe.Bpe(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={}
    )


def ids(coder, text):
    return np.frombuffer(coder.encode([text])[0], "<u4").tolist()


SPACES = st.sampled_from(list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　"))
TEXT = st.lists(st.one_of(st.text(max_size=6), SPACES, st.sampled_from(["the", " of", "'s", "  ", " \n", "é", "12"])))


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_like_the_library(coder, library, parts):
    text = "".join(parts).encode("utf-8", "ignore").decode()
    assert ids(coder, text) == library.encode_ordinary(text)
    assert coder.decode(coder.encode([text])[0]) == text.encode()


def test_documents_like_the_library(spark, coder, library):
    path = "/root/testdata/sf0.001/documents.parquet"
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{path}'").fetchall())
    rows = bpe.encode_documents(spark.read.parquet(path), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert np.frombuffer(bytes(row["ids"]), "<u4").tolist() == library.encode_ordinary(texts[row["doc_id"]])
        assert bytes(row["decoded"]).decode() == texts[row["doc_id"]]


def plain(ranks, piece):
    """Merge the leftmost pair of the lowest rank until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_any_order_of_ranks(seed):
    """Also ranks no training gives: a longer token may come before its parts."""
    draw = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 256 + 60:
        tokens.add(bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 6))))
    order = draw.sample(sorted(tokens), len(tokens))
    lines = b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order))
    coder = bpe.Bpe(lines, r"(?s).+")
    pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 60))) for _ in range(20)]
    merged = [np.frombuffer(m, "<u4").tolist() for m in coder.merge(pieces)]
    assert merged == [plain(coder.ranks, piece) for piece in pieces]


def test_very_long_pre_token(coder):
    text = "ab" * 200_000
    assert coder.decode(coder.encode([text])[0]) == text.encode()


def test_a_full_table_of_recent_pieces(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "RECENT", 5)
    texts = ["one two three", "four five six one", "seven one two " * 3]
    assert [np.frombuffer(p, "<u4").tolist() for p in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("seed", range(30))
def test_whole_buckets_like_the_plain_rule(seed, monkeypatch):
    """Every bucket on arrays where its ranks allow it, also runs of one symbol, whose pairs overlap."""
    monkeypatch.setattr(bpe, "MANY", 1)
    draw = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 256 + 40:
        tokens.add(bytes(draw.choice(b"aab") for _ in range(draw.randint(2, 6))))
    order = draw.sample(sorted(tokens), len(tokens)) if seed % 2 else sorted(tokens, key=lambda t: (len(t), t))
    coder = bpe.Bpe(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)), r"(?s).+")
    pieces = [bytes(draw.choice(b"aaab") for _ in range(draw.randint(1, 60))) for _ in range(20)]
    merged = [np.frombuffer(m, "<u4").tolist() for m in coder.merge(pieces)]
    assert merged == [plain(coder.ranks, piece) for piece in pieces]


def test_a_recent_pre_token_is_not_merged_again(coder, library, monkeypatch):
    """Neither in another piece nor in a later call."""
    merged, merge = [], coder.merge
    monkeypatch.setattr(coder, "merge", lambda pieces: merged.extend(pieces) or merge(pieces))
    texts = ["a zqxv; zqxv! zqxv", "the zqxv? zqxv)", "zqxv  zqxv \n"]
    for text in texts:
        assert ids(coder, text) == library.encode_ordinary(text)
    assert merged.count(b" zqxv") == 1


def test_a_pattern_that_passes_over_something(coder):
    with open(PATH, "rb") as file:
        own = bpe.Bpe(file.read(), r" ?[a-z]+")
    assert own.decode(own.encode(["ab 12 cd, ef"])[0]) == b"ab cd ef"


def test_vocabulary_without_a_byte():
    with pytest.raises(ValueError):
        bpe.Bpe(base64.b64encode(b"a") + b" 0", ".")
