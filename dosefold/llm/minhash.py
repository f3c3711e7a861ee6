"""Near-dedup by b-bit MinHash.

1. Each document's distinct word shingles give 512 minima, of which the low 8
   bits are kept, packed eight to a word. Documents of equal sets become a class.
2. A packed word is a band: classes that share one are candidates. Each shared
   word links its classes to the smallest of them, the hub. Of pairs with
   similarity 0.8, 8 in a million share none of the 64 bands, of pairs with 0.85
   2 in a billion; half-alike texts share few.
3. The classes around a hub, in tiles of bounded size, are compared in tasks:
   bit counts of the packed words estimate the similarity, corrected for chance
   matches of low bits; what may reach the threshold is counted on full sets.
   A task gives no pairs but a spanning forest of the links it confirmed.
4. Components of the forests.

Equality of shingles is equality of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import grams, mix, slices, stored, word_codes, word_hashes
from dosefold.llm.components import components

MINIMA, BITS, TILE = 512, 8, 256
#: An estimate so far below the threshold rules a pair out: over six standard deviations of 512 minima at 0.8 and more.
MARGIN = 0.12

_draws = np.random.default_rng(20)
FLIPS = _draws.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2)
FACTORS = _draws.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; A-Z count as a-z. Fewer words than a shingle make one shingle, none make none."""
    offsets, codes, distinct = word_codes(texts)
    hashes = word_hashes([w.lower() for w in distinct])[codes] if len(distinct) else np.empty(0, np.uint64)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        out.append(np.unique(grams(hashes[a:b], min(words, b - a))) if b > a else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MINIMA low parts of each set packed into 64-bit words; zeros for an empty set."""
    sizes = np.array([len(s) for s in sets], np.int64)
    packed = np.zeros((len(sets), MINIMA * BITS // 64), np.uint64)
    full = np.flatnonzero(sizes)
    if len(full):
        every = np.concatenate([sets[k] for k in full])
        starts = np.cumsum(sizes[full]) - sizes[full]
        for k in range(MINIMA):
            low = np.minimum.reduceat((every ^ FLIPS[k]) * FACTORS[k], starts) & np.uint64((1 << BITS) - 1)
            packed[full, k * BITS // 64] |= low << np.uint64(k * BITS % 64)
    return packed


def set_marks(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit marks of each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        first = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        second = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(17))) if len(s) else 0 for s in sets], np.uint64)
    return first.view(np.int64), second.view(np.int64)


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                first, second = set_marks(sets)
                words_of = signatures(sets)
                ends = pa.array(np.arange(len(words_of) + 1) * words_of.shape[1], pa.int32())
                packed = pa.ListArray.from_arrays(ends, pa.array(words_of.view(np.int64).ravel()))
                columns = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first), pa.array(second), packed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "mark1", "mark2", "packed"])

    return run


def _sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch.column("text"), words)
                first, second = set_marks(sets)
                same = (first == batch.column("mark1").to_numpy()) & (second == batch.column("mark2").to_numpy())
                blobs = pa.array([s.tobytes() for s in sets], pa.binary())
                out = pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("packed"), blobs], ["class_id", "packed", "shingles"])
                yield out.filter(pa.array(same))

    return run


def estimated(packed: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of `packed` with each of `other`: share of equal low parts, less what chance makes equal."""
    equal = np.zeros((len(packed), len(other)), np.int32)
    ones = np.uint64(0x0101010101010101)
    for k in range(packed.shape[1]):
        x = packed[:, k][:, None] ^ other[:, k][None, :]
        for shift in (4, 2, 1):  # the lowest bit of a part is set if any of its bits differs
            x |= x >> np.uint64(shift)
        equal += 8 - np.bitwise_count(x & ones).astype(np.int32)
    chance = 2.0**-BITS
    return (equal / MINIMA - chance) / (1 - chance)


def common_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Size of the intersection of every two sets (of different rows)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    keep = count[place] > 1
    owner, column = owner[keep], shared[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for start in range(0, int((count > 1).sum()), width):
        a, b = np.searchsorted(column, [start, start + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[a:b], column[a:b] - start] = 1
        total += block @ block.T
    return total.astype(np.int64)


def forest(ids: np.ndarray, tile: np.ndarray, packed: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links between documents with den * common >= num * united, as a spanning forest; in two tiles, across them only."""
    likely = estimated(packed, packed) >= num / den - MARGIN
    np.fill_diagonal(likely, False)
    if tile.min() != tile.max():
        likely &= tile[:, None] != tile[None, :]
    near = np.flatnonzero(likely.any(1))
    if not len(near):
        return []
    sizes = np.array([len(sets[k]) for k in near])
    common = common_counts([sets[k] for k in near])
    linked = likely[np.ix_(near, near)] & (den * common >= num * (sizes[:, None] + sizes[None, :] - common))
    parent = list(range(len(near)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(linked)))):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            out.append((int(ids[near[a]]), int(ids[near[b]])))
    return out


def _confirm(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        packed = np.array(table.column("packed").to_pylist(), np.int64).view(np.uint64)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        found = forest(table.column("class_id").to_numpy(), table.column("tile").to_numpy(), packed, sets, num, den)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: links where 100 * common >= `num` * united with `den` = 100.

    Texts without words have no shingles and are linked with nothing. Rows
    that share a doc_id are one node: their links unite. A row without doc_id
    counts shingles, but can't be named: component_id is null.
    """
    texts = docs.select("doc_id", "text")
    found = stored(texts.mapInArrow(_features(words), "doc_id long, n_shingles long, mark1 long, mark2 long, packed array<long>"), "signatures")
    key = ["n_shingles", "mark1", "mark2"]
    classes = stored(
        found.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("class_id"), F.first("packed").alias("packed")), "classes"
    )
    bands = classes.select("class_id", F.posexplode("packed").alias("band", "word"))
    hubs = bands.groupBy("band", "word").agg(F.min("class_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    around = stored(bands.join(hubs, ["band", "word"]).select("hub", "class_id").distinct(), "around")
    candidates = around.select("class_id").distinct()
    wanted = classes.join(candidates, "class_id").select("class_id", "mark1", "mark2", "packed")
    sets = texts.withColumnRenamed("doc_id", "class_id").join(wanted, "class_id")
    sets = sets.mapInArrow(_sets_of(words), "class_id long, packed array<long>, shingles binary").dropDuplicates(["class_id", "packed"])
    sets = stored(sets, "sets")
    # a group of n classes is cut into tiles; each class meets every tile of its group, and only there
    tiles = around.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("class_id"), F.col("tiles")).cast("int")
    placed = around.join(tiles, "hub").select("hub", "class_id", tile.alias("tile"), F.explode(F.expr("sequence(0, tiles - 1)")).alias("other"))
    met = placed.select("hub", F.least("tile", "other").alias("t1"), F.greatest("tile", "other").alias("t2"), "tile", "class_id").join(sets, "class_id")
    links = met.groupBy("hub", "t1", "t2").applyInArrow(_confirm(num, den), "a long, b long")
    named = components(links)
    grouped = classes.join(named, F.col("class_id") == F.col("node"), "left").select(*key, F.coalesce("component", "class_id").alias("component"))
    # documents of equal sets, and rows of equal id, share the smallest component
    joined = found.select("doc_id", *key).join(grouped, key, "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def near_dedup(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (doc_id is the component's smallest)."""
    return near_components(docs, words, num, den).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_kept(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs` that stay: of each component the smallest doc_id; rows without doc_id stay."""
    gone = near_dedup(docs, words, num, den).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
