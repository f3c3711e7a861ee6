"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become runs of words (lower case, without marks
around them). Karp-Rabin hashes of five words give the seeds that a document
and an item share; seeds on one diagonal make maximal matches. The longest
match is marked first, what it leaves of the others is matched again, down to
five words; no word is marked twice. So a passage is found whole even when its
sentences come in another order. An item whose words are covered to 80 % or
more makes its document contaminated.

Items meet documents in blocks: a block's words have a fixed bound and are
broadcast; a larger benchmark takes more passes over the documents, and no
size of it changes a result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from dosefold.llm.common import grams, slices, stored, word_codes, word_hashes
from dosefold.llm.toxicity import bare

SEED_WORDS = 5
COVERAGE = 0.8
#: Words of benchmark items broadcast at once: 16 MB, and as much for their seeds.
BLOCK_WORDS = 2_000_000


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets by text and a hash for each word; words of marks only don't count."""
    offsets, codes, words = word_codes(texts)
    if not len(words):
        return offsets, np.empty(0, np.uint64)
    stripped = bare(words)
    full = np.fromiter((bool(w) for w in stripped), bool, len(words))[codes]
    hashes = word_hashes(stripped)[codes[full]]
    return np.concatenate([[0], np.cumsum(full)])[offsets], hashes


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, place in item, place in doc): longest first, then earliest in the item, then in the document."""
    own, other = grams(item, least), grams(doc, least)
    if not len(own) or not len(other):
        return []
    order = np.argsort(own, kind="stable")
    first, last = np.searchsorted(own[order], other, "left"), np.searchsorted(own[order], other, "right")
    hits = last - first
    at_doc = np.repeat(np.arange(len(other)), hits)
    at_item = order[np.repeat(first, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
    for k in range(least):  # a hash alone is no match
        same = doc[at_doc + k] == item[at_item + k]
        at_doc, at_item = at_doc[same], at_item[same]
    if not len(at_doc):
        return []
    by = np.lexsort((at_doc, at_doc - at_item))
    at_doc, at_item = at_doc[by], at_item[by]
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(at_doc) != 1) | (np.diff(at_item) != 1)]))
    lengths = np.diff(np.append(starts, len(at_doc))) + least - 1
    heap = [(-int(n), int(i), int(d)) for n, i, d in zip(lengths, at_item[starts], at_doc[starts])]
    heapq.heapify(heap)
    free_item, free_doc, out = np.ones(len(item), bool), np.ones(len(doc), bool), []
    while heap:
        n, i, d = heapq.heappop(heap)
        free = free_item[i : i - n] & free_doc[d : d - n]
        if free.all():
            free_item[i : i - n] = free_doc[d : d - n] = False
            out.append((-n, i, d))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heapq.heappush(heap, (a - b, i + a, d + a))
    return out


class Block:
    """Some items: their words, and which items each seed occurs in."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        offsets, self.words = words_of(pa.array(texts, pa.string()))
        self.ids, self.offsets = ids, offsets
        parts = [np.unique(grams(self.words[a:b], SEED_WORDS)) for a, b in zip(offsets[:-1], offsets[1:])]
        seeds = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def covered(self, doc: np.ndarray) -> list[tuple[int, float]]:
        """(item id, share of its words that tiles of `doc` cover) of each item that shares a seed."""
        own = grams(doc, SEED_WORDS)
        own = own[self.maybe[(own >> np.uint64(42)).astype(np.int64)]]
        if not len(own):
            return []
        own = np.unique(own)
        first, last = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
        items = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(first, last) if b > a] or [np.empty(0, np.int64)]))
        out = []
        for k in items.tolist():
            item = self.words[self.offsets[k] : self.offsets[k + 1]]
            out.append((self.ids[k], sum(t[0] for t in tiles(doc, item)) / len(item)))
        return out


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[int, Iterator[Block]]:
    """How many blocks of about `block_words` words there are, and the blocks, read one by one; an item counts one word more than its white space."""
    size = F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text")
    parts = max(1, -(-(items.agg(size).first()[0] or 0) // block_words))

    def read(part: int) -> Block:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").collect()
        return Block([r.item_id for r in rows], [r.text for r in rows])

    return parts, (read(part) for part in range(parts))


def _tile(sent, keep: list[str], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for whole in batches:
            for batch in slices(whole, "text", 8 << 20):
                offsets, words = words_of(batch.column("text"))
                most, found = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    shares = block.covered(words[a:b])
                    most.append(max((s for _, s in shares), default=0.0))
                    found.append(sorted({i for i, s in shares if s >= threshold}))
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(most, pa.float64()), pa.array(found, pa.list_(pa.int64()))], [*keep, "_most", "_items"])

    return run


def coverage(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = COVERAGE, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """For each block of items: `keep` of every row with `_most` (largest share) and `_items` (ids at `threshold`).

    Of several blocks each is met, written and given up before the next is read.
    """
    schema = StructType([docs.schema[c] for c in keep] + [StructField("_most", _type("double")), StructField("_items", _type("array<bigint>"))])
    send = docs.sparkSession.sparkContext.broadcast
    read = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    n, blocks = _blocks(benchmark, block_words)
    out = []
    for block in blocks:
        sent = send(block)
        part = read.mapInArrow(_tile(sent, keep, threshold), schema)
        if n > 1:
            part = stored(part, "covered")
            sent.destroy()
        out.append(part)
    return out


def _type(name: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, contaminated, coverage (of its best covered item), item_ids (those at `threshold`).

    Null or short texts (under five words) share no seed: coverage 0. Items
    without id, or of under five words, match nothing. Rows that repeat a
    doc_id give one row each, if the benchmark fits a block; else rows that
    share doc_id and text give equal rows. Empty tables give no rows, or no item.
    """
    parts = coverage(docs, benchmark, ["doc_id"], threshold, block_words)
    if len(parts) == 1:
        found = parts[0]
    else:
        docs = docs.select("doc_id", "text").withColumn("tag", F.xxhash64("text"))
        parts = coverage(docs.select("doc_id", "tag", "text"), benchmark, ["doc_id", "tag"], threshold, block_words)
        each = parts[0].withColumn("_first", F.lit(1))
        for part in parts[1:]:
            each = each.unionByName(part.withColumn("_first", F.lit(0)))
        best = each.groupBy("doc_id", "tag").agg(F.max("_most").alias("_most"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("_items"), F.sum("_first").alias("_rows"))
        found = best.withColumn("_row", F.explode(F.expr("sequence(1L, _rows)")))
    return found.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.col("_most").alias("coverage"), F.col("_items").alias("item_ids"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` that cover no item to `threshold`, with all their columns."""
    n, blocks = _blocks(benchmark, block_words)
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", 8 << 20):
                    for marked in _tile(sent, [], threshold)(iter([batch.select(["text"])])):
                        yield batch.filter(pa.array([not x for x in marked.column("_items").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:  # the next pass reads what this one left; its block is given up
            docs = stored(docs, "clean")
            sent.destroy()
    return docs
