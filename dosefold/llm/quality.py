"""Quality: Bradley-Terry ranking of documents from preference pairs.

A document's worth is a weighted sum of plain measures of its text. The weights
are learnt from pairs of a document marked good and one marked bad: logistic
loss on the difference of their measures. The cut is the quantile of the worths
that leaves as many documents below as are marked bad.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import plain, slices, word_codes
from dosefold.llm.labelled import held_out, training_rows

#: Labelled rows whose measures (a few numbers each) the driver holds at most.
SAMPLE_ROWS = 20_000
PAIRS_PER_DOCUMENT = 8

# byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 comma and full stop, 7 !, 8 |, 9 symbols, 10 brackets and quotes, 11 - 15 spare
_CLASS = np.zeros(256, np.uint8)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b" \t\r\v\f", 4), (b"\n", 5),
                      (b",.;:", 6), (b"!?", 7), (b"|", 8), (b"#$%&*+=<>@^_~\\/", 9), (b"()[]{}\"'`-", 10)):
    _CLASS[np.frombuffer(_chars, np.uint8)] = _kind
_CLASS[0xC0:] = 11  # first byte of a letter outside ASCII
_CLASS[0x80:0xC0] = 12


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of each row, and how often its commonest code comes."""
    if not len(codes):
        return np.zeros(n), np.zeros(n)
    pairs, counts = np.unique(rows * (int(codes.max()) + 1) + codes, return_counts=True)
    owner = pairs // (int(codes.max()) + 1)
    most = np.zeros(n)
    np.maximum.at(most, owner, counts)
    return np.bincount(owner, minlength=n).astype(float), most


def measures(texts: pa.Array) -> np.ndarray:
    """A row of measures for each text; an empty text has zeros."""
    texts = plain(texts)
    n = len(texts)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    owner = np.repeat(np.arange(n), np.diff(starts))
    kinds = np.bincount(owner * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16).astype(float)
    size = np.maximum(np.diff(starts), 1).astype(float)
    offsets, codes, words = word_codes(texts)
    row = np.repeat(np.arange(n), np.diff(offsets))
    count = np.diff(offsets).astype(float)
    some = np.maximum(count, 1)
    length = np.fromiter((len(w) for w in words), float, len(words))[codes] if len(words) else np.empty(0)
    marked = np.fromiter((w[-1:] < b"\x80" and not w[-1:].isalnum() for w in words), float, len(words))[codes] if len(words) else np.empty(0)
    total = np.bincount(row, length, n) / some
    again = np.bincount(row[1:], (codes[1:] == codes[:-1]) & (row[1:] == row[:-1]), n) / some
    different, most = _distinct(row, codes, n)
    lines = pc.split_pattern(texts, "\n")
    line_row = np.repeat(np.arange(n), np.diff(lines.offsets.to_numpy()))
    line_codes = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    line_count = np.maximum(np.bincount(line_row, minlength=n), 1).astype(float)
    line_different, _ = _distinct(line_row, line_codes, n)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2] + kinds[:, 11], 1)
    share = kinds / size[:, None]
    out = [
        kinds[:, 2] / letters, share[:, 3], share[:, 6], share[:, 7], share[:, 8], share[:, 9], share[:, 10], share[:, 11],
        np.sqrt(share[:, 7]), np.sqrt(share[:, 8]), np.sqrt(share[:, 9]), np.sqrt(again), again,
        total / 10, np.bincount(row, marked, n) / some, different / some, most / some, (most / some) ** 2,
        np.log1p(count) / 10, line_count / some, 1 - line_different / line_count, np.log1p(count) / 10 * different / some,
        (count < 5).astype(float), (count < 20).astype(float),
    ]
    found = np.stack(out, 1)
    found[np.diff(starts) == 0] = 0
    return found


def worths(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of each row's measures, column by column: a row's last bits don't depend on the rows beside it."""
    total = np.zeros(len(x))
    for k, weight in enumerate(weights):
        total += x[:, k] * weight
    return total


def bradley_terry(x: np.ndarray, label: np.ndarray, ridge: float = 1e-3, per_document: int = PAIRS_PER_DOCUMENT, steps: int = 60):
    """(weights, cut) from measures and labels; `cut` is the quantile of the worths by the share of bad labels.

    Every document of the commoner label meets `per_document` drawn ones of the other label, however many there are.
    """
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return w, -1.0 if len(good) else 1.0
    scale = x.std(0) + 1e-9
    draws = np.random.default_rng(7)
    n = per_document * max(len(good), len(bad))
    first, second = (np.repeat(rows, per_document) if len(rows) * per_document == n else draws.choice(rows, n) for rows in (good, bad))
    diff = (x[first] - x[second]) / scale
    for _ in range(steps):  # Newton's method on the ridge-penalised loss
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -35, 35)))
        gradient = diff.T @ (p - 1) / n + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / n + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-6:
            break
    w = w / scale
    return w, float(np.quantile(worths(x, w), len(bad) / len(x)))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = pa.array(measures(batch.column("text")).tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), rows], ["order", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float]:
    rows = training_rows(docs, labels, "quality", sample_rows).mapInArrow(_measure, "order long, label int, x array<double>")
    sample = rows.orderBy("order", "x").limit(2 * sample_rows).toArrow()
    if sample.num_rows == 0:
        return np.zeros(measures(pa.array([""])).shape[1]), -1.0
    return bradley_terry(np.array(sample.column("x").to_pylist()), sample.column("label").to_numpy())


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the chance that the document beats one at the cut, moved so
    that the cut scores `threshold`. A null text counts as empty and scores as
    its measures (zeros) do; repeated rows score alike; without labels of both
    kinds every document gets the same score.
    """
    weights, cut = train(docs, labels, sample_rows)
    at_cut = float(np.log(threshold / (1 - threshold)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                worth = worths(measures(batch.column("text")), weights) - cut + at_cut
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(worth, -35, 35))))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
