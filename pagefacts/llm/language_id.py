"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read as bytes, in windows of ``WINDOW`` that cover all of it. Two gated recurrent
layers run over each window, one forwards and one backwards; a softmax over both states labels
every byte, and the mean of the bytes' probabilities over the whole text is the document's.
States start anew in each window, so windows of many documents form one batch.

The network is trained in numpy by backpropagation through time, on windows drawn from a
bounded sample: ``PER_LANGUAGE`` documents of each language and ``DOCUMENTS`` in all, none of them held out,
``WINDOWS`` windows of each. Every language that occurs is learned. Adam steps, a fixed seed.

Only the text is an input of a prediction. Defined cases: a text that is null or has no letter
is ``und`` with score 0; repeated rows and equal texts get equal results, scores up to rounding; documents
whose lang is null are not trained on; without any language to learn from every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.folds import held_out, labelled_sample

WINDOW = 64
HIDDEN = 16
PER_LANGUAGE = 250
WINDOWS = 10
EPOCHS = 6
BATCH = 256
RATE = 0.01
SEED = 11
# Documents to train on in all; with very many languages each gets fewer than ``PER_LANGUAGE``.
DOCUMENTS = 100_000
UNKNOWN = "und"
# Windows that are labelled at once.
ROUND = 1024

Parameters = dict[str, np.ndarray]


def _bent(x: np.ndarray) -> np.ndarray:
    """Hyperbolic tangent; x is overwritten."""
    return np.tanh(x, out=x)


def _slope(y: np.ndarray) -> np.ndarray:
    """Derivative of ``_bent`` where its value is y."""
    return 1 - y * y


def _forward(p: Parameters, side: str, x: np.ndarray, mask: np.ndarray, keep: bool):
    """States of one direction: time x window x hidden. ``x`` and ``mask`` are time x window."""
    table, weights, candidate = p[f"in_{side}"], p[f"gates_{side}"], p[f"cand_{side}"]
    hidden = weights.shape[0]
    state = np.zeros((x.shape[1], hidden), dtype=np.float32)
    states = np.empty((len(x), x.shape[1], hidden), dtype=np.float32)
    kept = []
    for t in range(len(x)):
        given = np.take(table, x[t], axis=0)
        gates = state @ weights
        gates += given[:, : 2 * hidden]
        gates = 0.5 * _bent(gates) + 0.5
        update, reset = gates[:, :hidden], gates[:, hidden:]
        held = reset * state
        fresh = held @ candidate
        fresh += given[:, 2 * hidden :]
        fresh = _bent(fresh)
        following = (state + update * (fresh - state)) * mask[t][:, None]
        if keep:
            kept.append((state, update, reset, held, fresh))
        states[t] = state = following
    return states, kept


def _states(p: Parameters, side: str, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The states of ``_forward``, for scoring: time x hidden x window, so that every step works on whole rows in place.

    A gate is half of a tangent plus a half; that of the reset is taken into the candidate's weights.
    """
    table = np.ascontiguousarray(p[f"in_{side}"].T)
    gates_of = np.ascontiguousarray(p[f"gates_{side}"].T)
    candidate = np.ascontiguousarray(p[f"cand_{side}"].T) * p["bias"].dtype.type(0.5)
    hidden = candidate.shape[0]
    states = np.empty((len(x), hidden, x.shape[1]), dtype=table.dtype)
    state, gates = np.zeros(states.shape[1:], dtype=table.dtype), np.empty((2 * hidden, x.shape[1]), dtype=table.dtype)
    for t in range(len(x)):
        given = np.take(table, x[t], axis=1)
        np.matmul(gates_of, state, out=gates)
        gates += given[: 2 * hidden]
        _bent(gates)
        gates += 1
        update, reset = gates[:hidden], gates[hidden:]
        reset *= state
        following = np.matmul(candidate, reset, out=states[t])
        following += given[2 * hidden :]
        _bent(following)
        update *= 0.5
        following -= state
        following *= update
        following += state
        following *= mask[t]
        state = following
    return states


def _label_probabilities(p: Parameters, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """time x language x window, from states as ``_states`` gives them."""
    hidden = forward.shape[1]
    logits = np.matmul(np.ascontiguousarray(p["out"][:hidden].T), forward)
    logits += np.matmul(np.ascontiguousarray(p["out"][hidden:].T), backward)
    logits += p["bias"][:, None]
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _backward(p: Parameters, side: str, x: np.ndarray, mask: np.ndarray, kept: list, back: np.ndarray) -> Parameters:
    """Gradients of one direction by backpropagation through time; ``back`` is that of the states."""
    weights, candidate = p[f"gates_{side}"], p[f"cand_{side}"]
    hidden = weights.shape[0]
    d_table = np.zeros_like(p[f"in_{side}"])
    d_weights, d_candidate = np.zeros_like(weights), np.zeros_like(candidate)
    flow = np.zeros_like(back[0])
    for t in range(len(x) - 1, -1, -1):
        state, update, reset, held, fresh = kept[t]
        d = (flow + back[t]) * mask[t][:, None]
        d_fresh = d * update * _slope(fresh)
        d_update = d * (fresh - state) * 0.5 * _slope(2 * update - 1)
        d_held = d_fresh @ candidate.T
        d_reset = d_held * state * 0.5 * _slope(2 * reset - 1)
        d_gates = np.concatenate([d_update, d_reset], axis=1)
        flow = d * (1 - update) + d_held * reset + d_gates @ weights.T
        d_weights += state.T @ d_gates
        d_candidate += held.T @ d_fresh
        np.add.at(d_table, x[t], np.concatenate([d_gates, d_fresh], axis=1))
    return {f"in_{side}": d_table, f"gates_{side}": d_weights, f"cand_{side}": d_candidate}


def _initial(languages: int) -> Parameters:
    generator = np.random.default_rng(SEED)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return generator.normal(0, scale, shape).astype(np.float32)

    p: Parameters = {"out": normal(2 * HIDDEN, languages, scale=0.1), "bias": np.zeros(languages, dtype=np.float32)}
    for side in ("f", "b"):
        p[f"in_{side}"] = normal(256, 3 * HIDDEN, scale=0.3)
        p[f"gates_{side}"] = normal(HIDDEN, 2 * HIDDEN, scale=0.25)
        p[f"cand_{side}"] = normal(HIDDEN, HIDDEN, scale=0.25)
    return p


def _probabilities(p: Parameters, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """language x time x window."""
    times, windows, hidden = forward.shape
    logits = p["out"][:hidden].T @ forward.reshape(-1, hidden).T
    logits += p["out"][hidden:].T @ np.ascontiguousarray(backward).reshape(-1, hidden).T
    logits += p["bias"][:, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits.reshape(-1, times, windows)


def fit(windows: np.ndarray, masks: np.ndarray, labels: np.ndarray, languages: int) -> Parameters:
    """Train on windows (window x time) with one label each."""
    p = _initial(languages)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    generator = np.random.default_rng(SEED)
    step = 0
    steps = max(1, EPOCHS * -(-len(labels) // BATCH))
    for _ in range(EPOCHS):
        order = generator.permutation(len(labels))
        for start in range(0, len(order), BATCH):
            at = order[start : start + BATCH]
            x, mask, label = windows[at].T, masks[at].T.astype(np.float32), labels[at]
            forward, kept_f = _forward(p, "f", x, mask, True)
            reverse, kept_b = _forward(p, "b", x[::-1], mask[::-1], True)
            backward = reverse[::-1]
            error = _probabilities(p, forward, backward)
            error[label, :, np.arange(len(at))] -= 1
            error *= mask / max(1.0, float(mask.sum()))
            error = error.transpose(1, 2, 0)
            both = np.concatenate([forward, backward], axis=2).reshape(-1, 2 * HIDDEN)
            flat = error.reshape(-1, languages)
            back = (flat @ p["out"].T).reshape(*error.shape[:2], 2 * HIDDEN)
            gradient = {"out": both.T @ flat, "bias": flat.sum(axis=0)}
            gradient |= _backward(p, "f", x, mask, kept_f, back[:, :, :HIDDEN])
            gradient |= _backward(p, "b", x[::-1], mask[::-1], kept_b, back[::-1, :, HIDDEN:])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for name, g in gradient.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                mean = first[name] / (1 - 0.9**step)
                spread = second[name] / (1 - 0.99**step)
                p[name] -= (rate * mean / (np.sqrt(spread) + 1e-8)).astype(np.float32)
    return p


def _windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of the text in windows, and which places hold a byte."""
    count = -(-len(raw) // WINDOW)
    padded = np.frombuffer(raw.ljust(count * WINDOW, b"\0"), dtype=np.uint8).reshape(count, WINDOW)
    mask = np.zeros(count * WINDOW, dtype=bool)
    mask[: len(raw)] = True
    return padded, mask.reshape(count, WINDOW)


def train(
    docs: DataFrame, *, per_language: int = PER_LANGUAGE, documents: int = DOCUMENTS
) -> tuple[list[str], Parameters]:
    """All languages, and a network trained on at most ``per_language`` documents of each and about ``documents`` in all.

    What comes to the driver is the languages' names, and ``WINDOWS`` windows of each drawn document.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang")
    named = known.where(~held_out(F.col("doc_id"))).select("lang").distinct()
    languages = sorted(row["lang"] for row in named.collect())
    if not languages:
        return [], {}
    each = min(per_language, max(1, documents // len(languages)))
    sample = labelled_sample(docs, known, "lang", languages, each)
    number = {name: i for i, name in enumerate(languages)}

    @F.pandas_udf("array<binary>")
    def drawn(texts: pd.Series) -> pd.Series:
        def some(text: str) -> list[bytes]:
            raw = text.encode()
            generator = np.random.default_rng(len(raw))
            last = max(1, len(raw) - WINDOW)
            return [raw[i : i + WINDOW] for i in generator.integers(0, last, WINDOWS)]

        return texts.map(some)

    rows = (
        sample.orderBy(F.xxhash64("doc_id", "text")).select(F.explode(drawn("text")).alias("window"), "lang").collect()
    )
    parts = [_windows(bytes(row["window"])) for row in rows]
    held = [i for i, (windows, _) in enumerate(parts) if len(windows)]
    if not held:
        return [], {}
    labels = np.array([number[rows[i]["lang"]] for i in held])
    windows = np.concatenate([parts[i][0] for i in held])
    masks = np.concatenate([parts[i][1] for i in held])
    return languages, fit(windows, masks, labels, len(languages))


def pooled(p: Parameters, texts: list[str | None]) -> np.ndarray:
    """Mean probability of every language over all bytes of each text; zeros for an empty one."""
    languages = len(p["bias"])
    # Probabilities of so many windows are held at a time, fewer of more languages.
    at_once = min(ROUND, max(32, 16 * ROUND // languages))
    out = np.zeros((len(texts), languages))
    lengths = np.zeros(len(texts))
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def label_waiting() -> None:
        windows = np.concatenate([w for _, w, _ in waiting])
        masks = np.concatenate([m for _, _, m in waiting])
        owner = np.repeat([i for i, _, _ in waiting], [len(w) for _, w, _ in waiting])
        for start in range(0, len(windows), at_once):
            part = slice(start, start + at_once)
            x = np.ascontiguousarray(windows[part].T)
            mask = np.ascontiguousarray(masks[part].T, dtype=np.float32)
            forward, reverse = _states(p, "f", x, mask), _states(p, "b", x[::-1], mask[::-1])
            found = np.einsum("tln,tn->ln", _label_probabilities(p, forward, reverse[::-1]), mask)
            np.add.at(out, owner[part], found.T)

    for i, text in enumerate(texts):
        raw = (text or "").encode()
        lengths[i] = len(raw)
        # A very long text is handled in portions of whole windows.
        for start in range(0, len(raw), WINDOW * at_once):
            windows, masks = _windows(raw[start : start + WINDOW * at_once])
            waiting.append((i, windows, masks))
            held += len(windows)
            if held >= at_once:
                label_waiting()
                waiting, held = [], 0
    if waiting:
        label_waiting()
    return out / np.maximum(lengths, 1)[:, None]


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    languages, network = train(docs, **options)
    out_id = held_out(F.col("doc_id")).alias("held_out")
    if not languages:
        return docs.select("doc_id", out_id, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shipped = docs.sparkSession.sparkContext.broadcast((languages, network))

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, p = shipped.value
        for texts in batches:
            means = pooled(p, texts.tolist())
            best = means.argmax(axis=1)
            score = np.minimum(means[np.arange(len(best)), best], 1.0)
            yield pd.DataFrame({"lang": [names[i] for i in best], "score": score})

    worded = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", worded.alias("worded"), predicted("text").alias("found"))
    return found.select(
        "doc_id",
        out_id,
        F.when(F.col("worded"), F.col("found.lang")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("worded"), F.col("found.score")).otherwise(0.0).alias("score"),
    )
