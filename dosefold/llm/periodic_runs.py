"""Periodic runs of words, by a dictionary of basic factors.

A basic factor is a stretch of 2^k words; the dictionary of a level gives equal
factors of one text one name (pairs of names of the level before, sorted and
numbered). Factors that come once in their text get no name, so most levels of
ordinary text are nearly empty.

A run of period q, 2^k <= q < 2^(k+1), repeats the factor of level k at its
start q words on. Successor occurrences of a factor within twice its length form
arithmetic progressions (occurrences at most half a factor apart are exactly its
smallest period apart), and of a pair that can begin a run, one member heads its
progression: all later members have the same word before them. So a level
proposes a number of periods linear in its occurrences, never all pairs. A
proposal is extended to the right by the dictionary, largest factors first;
multiples of a period span the same words as the run itself and are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import slices, word_codes

#: Bytes of texts whose dictionary a task holds at once (a longer text counts alone).
SLICE_BYTES = 1 << 20


def _numbered(keys: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each place (0: its key comes once), and the named places by name, then place. `places` ascend."""
    table = np.zeros(size + 1, np.int32)
    if not len(keys):
        return table, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(np.append(starts, len(keys)))
    names = np.repeat(np.where(counts > 1, np.cumsum(counts > 1), 0), counts)
    named = names > 0
    names, at = names[named].astype(np.int64), places[order[named]]
    table[at] = names
    return table, names, at


def _expanded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for each place in first[row] .. last[row] - 1."""
    n = np.maximum(last - first, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(row))


def _proposed(names: np.ndarray, at: np.ndarray, length: int, size: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of occurrences `length` to 2 * `length` - 1 apart, with different words before them, one a head of its progression."""
    close = (names[1:] == names[:-1]) & (at[1:] - at[:-1] <= length // 2)
    head = np.concatenate([[True], ~close])
    key = names * (4 * size + 4) + at
    heads = np.flatnonzero(head)
    row, later = _expanded(np.searchsorted(key, key[heads] + length), np.searchsorted(key, key[heads] + 2 * length))
    left, right = at[heads[row]], at[later]
    row, earlier = _expanded(np.searchsorted(key, key[heads] - 2 * length + 1), np.searchsorted(key, key[heads] - length + 1))
    plain = ~head[earlier]
    left, right = np.concatenate([left, at[earlier[plain]]]), np.concatenate([right, at[heads[row[plain]]]])
    differ = before[left] != before[right]
    return left[differ], right[differ]


def _common(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many words from `left` equal those from `right`, in the same text."""
    a, b = left.copy(), right.copy()
    for k in range(len(levels) - 1, -1, -1):
        going = np.arange(len(a))
        while len(going):
            name = levels[k][a[going]]
            going = going[(name > 0) & (name == levels[k][b[going]])]
            a[going] += 1 << k
            b[going] += 1 << k
            if k < len(levels) - 1:  # below the top level a second step would have been one of the level above
                break
    return a - left


def runs_of(offsets: np.ndarray, codes: np.ndarray, min_length: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of every run, by start, then period; starts count over all texts together."""
    size = len(codes)
    empty = np.empty(0, np.int64)
    if not size:
        return empty, empty, empty
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    before = np.concatenate([[-1], codes[:-1]])
    begins = offsets[:-1][np.diff(offsets) > 0]
    before[begins] = -1 - begins
    levels, lefts, rights = [], [], []
    keys, places = text * (int(codes.max()) + 1) + codes, np.arange(size)
    while True:
        table, names, at = _numbered(keys, places, size)
        if not len(at):
            break
        length = 1 << len(levels)
        levels.append(table)
        left, right = _proposed(names, at, length, size, before)
        lefts.append(left)
        rights.append(right)
        places = np.flatnonzero(table[: size - length]) if length < size else empty
        places = places[table[places + length] > 0]
        keys = table[places].astype(np.int64) * (int(names[-1]) + 1) + table[places + length]
    if not levels:
        return empty, empty, empty
    left, right = np.concatenate(lefts), np.concatenate(rights)
    period = right - left
    length = period + _common(levels, left, right)
    long = length >= np.maximum(min_length, 2 * period)
    left, length, period = left[long], length[long], period[long]
    order = np.lexsort((period, length, left))
    left, length, period = left[order], length[order], period[order]
    own = np.ones(len(left), bool)
    own[1:] = (left[1:] != left[:-1]) | (length[1:] != length[:-1])
    left, length, period = left[own], length[own], period[own]
    order = np.lexsort((period, left))
    return left[order], length[order], period[order]


def _find(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                offsets, codes, words = word_codes(batch.column("text"))
                start, length, period = runs_of(offsets, codes, min_length)
                bounds = np.searchsorted(start, offsets)
                owner = np.searchsorted(offsets, start, side="right") - 1
                parts = [pa.array(x, pa.int64()) for x in (start - offsets[owner], length, period)]
                runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                left = pa.array(np.concatenate([[0], np.cumsum(keep)])[offsets], pa.int64())
                kept = pa.array(words, pa.large_binary()).cast(pa.large_string()).take(pa.array(codes[keep]))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(left, kept), pa.scalar(" ", pa.large_string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), runs, joined.cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, min_length: int = 12) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, runs (start, length, period; by start, then period), collapsed.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a maximal
    stretch of at least `min_length` words, twice its smallest period at
    least. `collapsed` is the text without what each run repeats after its
    first period, words joined by one space. A null text counts as empty: no
    words, no runs, an empty `collapsed`. Repeated rows and rows without
    doc_id each get their row; other columns are ignored. No shuffle; a task
    holds the dictionary of SLICE_BYTES of texts or of one longer text, whose
    levels take four bytes a word each.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(min_length), schema)


def with_planted_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text of `docs`; a tenth of the texts, told by crc32(doc_id), end in a loop of their own words.

    With h = crc32(doc_id), g = h div 10 and n words: where h % 10 = 0, each word
    i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    Texts without words, and rows without doc_id, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        # bound by one-element arrays, so that neither the words nor the numbers are worked out again for each word
        numbers = F.array(F.struct(a.alias("a"), p.alias("p")))
        turned = F.transform(numbers, lambda x: F.array_join(F.transform(words, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(words, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))
        return F.when(n > 0, F.get(turned, F.lit(0))).otherwise("")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda word: word != "")
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), looped), F.lit(0))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The row of each document's longest run (ties: smallest start, then period) and digests of its runs and collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
