"""Fill-in-middle against a version that takes each document whole."""

import hashlib
import random
import re

import edge
import pytest
from conftest import physical_plan

from pagefacts.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    hashed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hashed[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, low), (low, high), (high, n)))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    found = []
    for doc_id, text in rows:
        *facts, output = plainly(doc_id, text)
        found.append((doc_id, facts[0], facts[1], *facts[2:], sha256(output), sha256(text or "")))
    return sorted(found, key=repr)


def reported(docs, **options):
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return sorted((tuple(r) for r in fim.report(docs, **options).select(columns).collect()), key=repr)


def texts():
    rng = random.Random(3)
    pieces = ["a", "wörd", "𝔸b", " ", "\t", "\x0b", "\n\n", "\x85", " ", "<", "<P", "P>", "<S>", "<M>", "é"]
    return [(i, "".join(rng.choices(pieces, k=rng.randint(0, 60)))) for i in range(600)]


def test_as_the_plain_version(spark):
    rows = texts() + [(1000 + i, f"{'long words here ' * 9000}{i}") for i in range(6)]
    rows += [(2000 + i, "x" * (3 << 20)) for i in range(4)] + [(3000 + i, " " * 70_000) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert reported(docs) == expected(rows)
    forms = {r[2] for r in expected(rows)}
    assert forms == {"plain", "spm", "psm"}


def test_small_pieces_and_marks_over_chunks(spark):
    rows = texts()[:200]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["output"] for r in fim.transform(docs, units=2).collect()}
    assert reported(docs, units=2) == expected(rows)
    assert got == {doc_id: plainly(doc_id, text)[-1] for doc_id, text in rows}
    for cut in range(1, 6):
        for text in ("<S>uv w<P>a b<M>c", "<S><P><M>", "<S> <<P>P><M><<"):
            sections, parts = fim._Sections("spm"), []
            for i in range(0, len(text), cut):
                parts += sections.split(text[i : i + cut].encode())
            parts += sections.split(b"", last=True)
            suffix, prefix, middle = re.fullmatch("<S>(.*)<P>(.*)<M>(.*)", text).groups()
            assert b"".join(p for _, p in sorted(parts)).decode() == prefix + middle + suffix


def test_edges(spark):
    docs = edge.documents(spark)
    rows = [(r[0], r[1]) for r in edge.ROWS]
    assert reported(docs) == expected(rows)
    assert len([r for r in reported(docs) if r[0] == 2]) == 2  # the repeated row
    got = sorted(((r["doc_id"], r["output"]) for r in fim.transform(docs).collect()), key=repr)
    assert got == sorted(((i, plainly(i, text)[-1]) for i, text in rows), key=repr)
    assert reported(edge.empty(spark)) == [] and fim.transform(edge.empty(spark)).collect() == []


@pytest.mark.parametrize("kind", ["int", "string"])
def test_other_types_of_ids(spark, kind):
    rows = [(None, "a b c"), (None, "a b c"), (7 if kind == "int" else "x7", "some words here")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    assert reported(docs) == expected(rows)


def test_one_shuffle(spark):
    plan = physical_plan(fim.report(edge.documents(spark)))
    assert plan.count("Exchange") == 1 and plan.count("Sort [a#") == 2
