"""Quality classifier of supervised subword embeddings.

Words, pairs of words and the runs of three to five bytes in and around words are hashed to buckets; a bucket
has a learned vector, a document is the mean of the vectors of all its features, and a softmax
layer over it gives the probability of each label. Vectors and layer are trained together
by stochastic gradient descent in numpy.

Training takes a bounded sample, ``PER_CLASS`` documents of each label, none of them held out;
their features are counted in Spark tasks. Scoring runs over every whole text. As the layer is
linear in the mean, a bucket's vector and the layer fold into one number for scoring.

Only the text is an input of a score. Defined cases: a text that is null, empty or without
features gets the score of the bias alone; repeated rows and equal texts get equal scores;
without labelled documents every score is 0.5; a label that is null is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.folds import held_out, labelled_sample

PER_CLASS = 1500
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
SEED = 7
THRESHOLD = 0.3
RUNS = (3, 4, 5)
# Texts are joined up to about this many bytes for one pass of numpy.
PASS_BYTES = 1 << 20
_PRIME = np.uint32(16777619)


class Model(NamedTuple):
    """Weight of each bucket towards label 1, and the bias."""

    weights: np.ndarray
    bias: float


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (hashes + np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
    return (mixed >> np.uint32(17)).astype(np.int32)


def features(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Buckets by position for each kind of feature, -1 where none starts.

    ``raw`` is bytes in which white space is the blank, and starts and ends with one;
    ``bounds`` says where each of its texts begins.
    """
    n, blank = len(raw), raw == 32
    wide = raw.astype(np.uint32) + np.uint32(1)
    found = []
    hashes = wide.copy()
    for length in range(2, RUNS[-1] + 1):
        if n < length:
            break
        hashes = hashes[: n - length + 1] * _PRIME + wide[length - 1 :]
        if length in RUNS:
            inside = blank[1 : n - length + 2].copy()
            for i in range(2, length - 1):
                inside |= blank[i : n - length + 1 + i]
            buckets = np.full(n, -1, dtype=np.int32)
            buckets[: len(hashes)] = np.where(inside, -1, _bucket(hashes, length))
            found.append(buckets)
    # Words: a sum over their bytes, weighed by the place in the word.
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    words, neighbours = np.full((2, n), -1, dtype=np.int32)
    if len(starts):
        first = np.zeros(n, dtype=np.int64)
        first[starts] = starts
        place = np.arange(n) - np.maximum.accumulate(first)
        powers = np.cumprod(np.full(64, _PRIME, dtype=np.uint32), dtype=np.uint32)
        terms = np.where(blank, np.uint32(0), wide * powers[place & 63] + (place >> 6).astype(np.uint32))
        hashes = np.add.reduceat(terms, starts, dtype=np.uint32)
        words[starts] = _bucket(hashes, 1)
        # Two words by the difference of their hashes: a repeated word is always the same feature.
        neighbours[starts[1:]] = _bucket(np.diff(hashes), 2)
        first_words = np.searchsorted(starts, bounds[:-1])
        neighbours[starts[first_words[first_words < len(starts)]]] = -1
    return [*found, words, neighbours]


_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def _passes(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joined texts as bytes, and where each begins, its leading blank included."""
    parts: list[bytes] = []
    held = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) + 1 for p in parts])
        raw = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        return raw, np.concatenate([[0], np.cumsum(lengths)])

    for text in texts:
        parts.append((text or "").encode().translate(_SPACES))
        held += len(parts[-1]) + 1
        if held >= PASS_BYTES:
            yield joined()
            parts, held = [], 0
    if parts:
        yield joined()


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = []
    for raw, bounds in _passes(texts):
        total, count = np.zeros(len(raw)), np.zeros(len(raw), dtype=np.int64)
        for buckets in features(raw, bounds):
            held = buckets >= 0
            total += np.where(held, model.weights[buckets], 0.0)
            count += held
        sums, counts = np.add.reduceat(total, bounds[:-1]), np.add.reduceat(count, bounds[:-1])
        out.append(1 / (1 + np.exp(-(sums / np.maximum(counts, 1) + model.bias))))
    return np.concatenate(out) if out else np.empty(0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and their counts instead of the text."""
    for batch in batches:
        for at in range(batch.num_rows):
            raw, bounds = next(_passes([batch.column(0)[at].as_py()]))
            buckets, counts = np.unique(np.concatenate(features(raw, bounds)), return_counts=True)
            held = buckets >= 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([buckets[held].astype("<i4").tobytes()], pa.binary()),
                    pa.array([counts[held].astype("<f4").tobytes()], pa.binary()),
                    batch.column(1)[at : at + 1],
                ],
                names=["buckets", "counts", "label"],
            )


def train(docs: DataFrame, labels: DataFrame, *, per_class: int = PER_CLASS) -> Model:
    """Train on at most ``per_class`` documents of each label of ``labels`` (doc_id, quality).

    What comes to the driver is bounded: for each of them, at most ``BUCKETS`` pairs of 8 bytes.
    """
    quality = labels.select("doc_id", F.col("quality").cast("int").alias("label"))
    sample = labelled_sample(docs, quality, "label", [0, 1], per_class).orderBy(F.xxhash64("doc_id", "text"))
    rows = sample.select("text", "label").mapInArrow(_counted, "buckets binary, counts binary, label int").collect()
    generator = np.random.default_rng(SEED)
    vectors = generator.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = np.zeros((2, DIMENSIONS), dtype=np.float32), np.zeros(2, dtype=np.float32)
    examples = []
    for row in rows:
        counts = np.frombuffer(row["counts"], dtype="<f4")
        if len(counts):
            examples.append((np.frombuffer(row["buckets"], dtype="<i4"), counts / counts.sum(), row["label"]))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for at in generator.permutation(len(examples)):
            buckets, shares, label = examples[at]
            mean = shares @ vectors[buckets]
            logits = layer @ mean + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = layer.T @ error
            layer -= rate * np.outer(error, mean)
            bias -= rate * 0.1 * error
            vectors[buckets] -= rate * len(buckets) * 0.02 * np.outer(shares, back)
    towards = layer[1] - layer[0]
    return Model((vectors @ towards).astype(np.float64), float(bias[1] - bias[0]))


def score_column(docs: DataFrame, model: Model, text: Column) -> Column:
    """Probability of label 1 as a column; the model, of fixed size, goes to the workers."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(shipped.value, texts.tolist()))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, **options)
    scored = docs.select("doc_id", score_column(docs, model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the classifier rejects, all columns."""
    model = train(docs, labels, **options)
    rows = docs.select(F.struct("*").alias("row"))
    return rows.where(score_column(docs, model, F.col("row.text")) >= THRESHOLD).select("row.*")
