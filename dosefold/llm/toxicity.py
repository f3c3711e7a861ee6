"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is there or not: single words, neighbours, and words with one between
them, lower-cased and without the marks around them, hashed to 2**`bits` places.
Each place has its own learning rate; L1 keeps most weights at zero, so that
the weights that remain are few and can be broadcast at any corpus size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import mix, slices, word_codes, word_hashes
from dosefold.llm.labelled import held_out, training_rows

BITS = 24
#: Labelled rows that one training task reads at most.
SAMPLE_ROWS = 20_000
EMPTY = (np.empty(0, np.int32), np.empty(0, np.float64))


def bare(words: list[bytes]) -> list[bytes]:
    """Lower case, without marks before and after."""
    out = []
    for word in words:
        text = word.decode(errors="replace").lower()
        if not text.isalnum():
            first, last = 0, len(text)
            while first < last and not text[first].isalnum():
                first += 1
            while last > first and not text[last - 1].isalnum():
                last -= 1
            text = text[first:last]
        out.append(text.encode())
    return out


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature of every text; repeats are not removed."""
    offsets, codes, words = word_codes(texts)
    hashes = word_hashes(bare(words))[codes] if len(words) else np.empty(0, np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, places = [row], [mix(hashes + np.uint64(1))]
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        joined = hashes[:-gap] * np.uint64(0x9E3779B97F4A7C15) + hashes[gap:] + np.uint64(gap + 1)
        rows.append(row[gap:][same])
        places.append(mix(joined[same]))
    return np.concatenate(rows), (np.concatenate(places) >> np.uint64(64 - bits)).astype(np.int32)


def ftrl(rows: list[tuple[int, np.ndarray]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0, rounds: int = 2):
    """(places, weights, bias) learnt from (label, distinct places) in the given order."""
    z, n = np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)
    bias, bias_n = 0.0, 0.0
    for _ in range(rounds):
        for label, places in rows:
            zi, ni = z[places], n[places]
            w = -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - label
            after = ni + g * g
            z[places] = zi + g - (np.sqrt(after) - np.sqrt(ni)) / alpha * w
            n[places] = after
            bias_n += g * g
            bias -= alpha / (beta + np.sqrt(bias_n)) * g
    kept = np.flatnonzero(np.abs(z) > l1)
    weights = -np.sign(z[kept]) * (np.abs(z[kept]) - l1) / ((beta + np.sqrt(n[kept])) / alpha + l2)
    return kept.astype(np.int32), weights.astype(np.float64), float(bias)


def _featurise(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, places = features(batch.column("text"), bits)
                pairs = np.unique((rows.astype(np.int64) << bits) | places)
                ends = np.searchsorted(pairs >> bits, np.arange(batch.num_rows + 1))
                places = (pairs & ((1 << bits) - 1)).astype(np.int32)
                blobs = [places[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(blobs, pa.binary())], ["order", "label", "places"])

    return run


def _train(bits: int, sample_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            for label, blob in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist()):
                if len(rows) < sample_rows:
                    rows.append((label, np.frombuffer(blob, np.int32)))
        places, weights, bias = ftrl(rows, bits) if rows else (*EMPTY, 0.0)
        places, weights = np.append(places, -1).astype(np.int32), np.append(weights, bias)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(weights)], ["place", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, bits: int = BITS) -> dict[int, float]:
    """Weight by place, the bias at -1. Features are made by all tasks; one task learns from `sample_rows` rows at most."""
    made = training_rows(docs, labels, label, sample_rows).mapInArrow(_featurise(bits), "order long, label int, places binary")
    learnt = made.repartition(1).sortWithinPartitions("order", "places").mapInArrow(_train(bits, sample_rows), "place int, weight double")
    return {r.place: r.weight for r in learnt.collect()} or {-1: 0.0}


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = weights.value
        table = np.zeros(1 << bits, np.float32)
        for place, weight in given.items():
            if place >= 0:
                table[place] = weight
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, places = features(batch.column("text"), bits)
                hit = table[places] != 0
                pairs = np.unique((rows[hit].astype(np.int64) << bits) | places[hit])
                total = np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], batch.num_rows) + given[-1]
                score = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))), pa.float64())
                keep = [i for i, n in enumerate(batch.schema.names) if n not in ("text", "toxic_score")]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), score], [*(batch.schema.names[i] for i in keep), "toxic_score"])

    return run


def toxicity_scores(docs: DataFrame, weights: dict[int, float], bits: int = BITS) -> DataFrame:
    """(doc_id, toxic_score) of every row of `docs`; the weights, as many as L1 leaves, are broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select("doc_id", "text").mapInArrow(_score(sent, bits), "doc_id long, toxic_score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null text counts as empty and gets the score of the bias. Repeated rows
    are scored alike. Without any label the score is 0.5 everywhere.
    """
    scored = toxicity_scores(docs, train(docs, labels, sample_rows=sample_rows))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxic_score").alias("score"),
                         (F.col("toxic_score") >= threshold).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of `docs` that score below `threshold`, with all their columns."""
    from pyspark.sql.types import StructField, StructType

    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows=sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(sent, BITS)
        for whole in batches:
            for batch in slices(whole, "text"):
                for scored in score(iter([batch.select(["text"])])):
                    yield batch.filter(pa.array(scored.column("toxic_score").to_numpy() < threshold))

    schema = StructType([StructField(f.name, f.dataType, True) for f in docs.schema.fields])
    return docs.mapInArrow(run, schema)
