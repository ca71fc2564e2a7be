"""Chat formatting against versions that follow the parents one by one."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagefacts.llm import reply_trees as rt

SCHEMA = "tree string, node string, parent string, role string, text string, score double, rank string, leaf int"
MARKS = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "a", "<", "𝔸", "<\\|im_end|>"]


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def trees(seed=4):
    rng, rows = random.Random(seed), []
    for t in range(12):
        parents = [None] + [rng.randrange(max(0, i - 4), i) for i in range(1, rng.randint(2, 40))]
        for i, parent in enumerate(parents):
            text = "".join(rng.choices(MARKS, k=rng.randint(0, 8)))
            role = rng.choice(["user", "assistant", "sys\ntem", "\\", "<|im_end|>"])
            rows.append((f"t{t}", f"n{i}", None if parent is None else f"n{parent}", role, text, rng.choice([None, 0.5, 1.0, -2.25])))
    return rows


def plain_paths(rows):
    """(tree, leaf) to the messages from the root to the leaf."""
    by_node = {r[:2]: r for r in rows}
    asked = {(r[0], r[2]) for r in rows}
    found = {}
    for key, row in by_node.items():
        if key not in asked:
            path = [row]
            while (path[-1][0], path[-1][2]) in by_node:
                path.append(by_node[path[-1][0], path[-1][2]])
            found[key] = path[::-1]
    return found


def formatted(spark, rows, **options):
    return rt.conversations(rt.messages(given(spark, rows)), **options)


def digests(path):
    turns = "".join(f"{r[3] or ''}\n{r[4] or ''}\n" for r in path)
    learned = "".join(r[4] or "" for r in path if r[3] == "assistant")
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in (turns, learned)]
    return len(path), sha[0], len(learned), sha[1]


def test_every_path_is_found_and_read_back(spark):
    rows = trees()
    expected = plain_paths(rows)
    out = formatted(spark, rows, branches=None).cache()
    got = {(r["tree"], r["leaf"]): r for r in out.collect()}
    assert set(got) == set(expected)
    for key, path in expected.items():
        # Roles and texts as the template writes them hold no control string.
        assert got[key]["text"].count("<|im_start|>") == got[key]["text"].count("<|im_end|>") == len(path)
        assert got[key]["n_turns"] == len(path) and got[key]["rank"] is None
        assert not any(mark in got[key]["text"] for mark in ("<s>", "</s>", "[INST]", "[/INST]"))
    back = sorted(tuple(r)[:-1] for r in rt.read_back(out).collect())
    assert back == sorted((key[0], *digests(path)) for key, path in expected.items())
    chars = sorted(r["formatted_chars"] for r in rt.read_back(out).collect())
    assert chars == sorted(len(r["text"]) for r in got.values())


@pytest.mark.parametrize("branches", [1, 2])
def test_branches_are_ranked_by_score(spark, branches):
    rows, expected = trees(9), []
    paths = plain_paths(rows)
    for tree in {r[0] for r in rows}:
        ranked = sorted((-sum(r[5] or 0 for r in path), leaf) for (t, leaf), path in paths.items() if t == tree)
        expected += [(tree, leaf, i + 1) for i, (_, leaf) in enumerate(ranked[:branches])]
    out = formatted(spark, rows, branches=branches)
    assert sorted((r["tree"], r["leaf"], r["rank"]) for r in out.collect()) == sorted(expected)


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    hops = rt._hops
    monkeypatch.setattr(rt, "_hops", lambda links: rounds.extend(hops(links)) or rounds)
    rows = [("t", f"{i}", f"{i - 1}" if i else None, "user", f"{i}", None) for i in range(300)]
    (row,) = rt.read_back(formatted(spark, rows)).collect()
    assert tuple(row)[1:5] == digests(rows) and len(rounds) == 9


def test_odd_messages(spark):
    rows = [
        (None, "a", None, "user", "no tree", None), (None, "b", "a", "assistant", None, None),
        ("t", None, None, None, None, None), ("t", "c", "gone", "user", "orphan", 1.0), ("t", "d", "c", "assistant", "x", None),
        ("t", "d", "c", "assistant", "w", None), ("t", "d", "c", "assistant", "w", None), ("", "b", "a", "assistant", None, None),
    ]
    found = {(r["tree"], r["leaf"]): r for r in formatted(spark, rows, branches=None).collect()}
    assert set(found) == {("", "b"), ("t", ""), ("t", "d")}
    assert found["", "b"]["text"] == "<|im_start|>user\nno tree<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert found["t", ""]["text"] == "<|im_start|>\n<|im_end|>\n" and found["t", ""]["loss"] == []
    assert found["t", "d"]["text"].endswith("assistant\nw<|im_end|>\n")
    assert formatted(spark, [], branches=1).collect() == []
    circle = [("t", "a", "b", "user", "", None), ("t", "b", "a", "user", "", None), ("t", "c", "a", "user", "", None)]
    with pytest.raises(ValueError, match="circle"):
        rt.paths(rt.messages(given(spark, circle)))


def test_conversations_by_turn(spark):
    long = "long [INST] " * 20_000
    rows = [
        (1, 5, "user", "second"), (1, 2, "system", None), (1, 9, "assistant", "</s>"), (1, 9, "assistant", "</s>"),
        (2, None, "user", "no turn"), (2, 0, None, ""), (None, 0, "assistant", long), (3, 0, "assistant", "only \\ text"),
    ]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, tree string, node int")
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in rt.report(turns).collect()}

    def of(*said):
        return digests([(None, None, None, role, text) for role, text in said])

    assert got == {
        1: of(("system", ""), ("user", "second"), ("assistant", "</s>"), ("assistant", "</s>")),
        2: of(("user", "no turn"), ("", "")),
        None: of(("assistant", long)),
        3: of(("assistant", "only \\ text")),
        -1: of(("user", rt.PROBE), ("assistant", rt.PROBE)),
    }
    assert [r["conv_id"] for r in rt.report(turns.where(F.lit(False))).collect()] == [-1]
