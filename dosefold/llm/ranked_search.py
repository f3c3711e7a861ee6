"""Ranked lexical search by the Best Position Algorithm over impact lists.

1. One pass over the documents keeps of each its number of terms and the counts
   of those terms that some item asks for (written to the shared folder), from
   which the corpus statistics come: N, L and the document frequencies.
2. Tasks hold blocks of these vectors. A block has a list of (document, impact)
   for each term, highest impact first, and each document the places of its
   terms in the lists, for direct access. For an item, the lists of its terms are
   read side by side; a document met in one is scored through direct accesses,
   which also mark its places in the other lists as seen. A list's best position
   is the last place before the first one unseen; the sum of the impacts there
   bounds what any unseen document can score. Reading stops once that sum is
   strictly below the kth score found (an equal score could still win by its id).
3. Each task's best rows of an item meet in one ranking.

A document counts in one block only, so the best of the blocks' best are the
best of all. All scores are 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosefold.llm.common import plain, slices, stored, word_codes

#: Entries of impact lists that a task holds at once, and places of each list read a round.
BLOCK_ENTRIES, ROUND = 1_000_000, 64
#: Words of items whose terms are broadcast at once; a larger table of items takes more passes.
ITEM_WORDS = 1_000_000

# what a term is made of: letters, digits, bytes outside ASCII; A-Z become a-z, all else parts terms
_BYTES = np.full(256, ord(" "), np.uint8)
_BYTES[0x80:] = np.arange(0x80, 0x100)
for _chars in (b"0123456789", b"abcdefghijklmnopqrstuvwxyz"):
    _BYTES[np.frombuffer(_chars, np.uint8)] = np.frombuffer(_chars, np.uint8)
_BYTES[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)


def terms_of(texts) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Terms of each text: offsets by text, a code for each term, the distinct terms."""
    texts = plain(texts)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), []
    mapped = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8)]
    return word_codes(pa.LargeStringArray.from_buffers(len(texts), texts.buffers()[1], pa.py_buffer(mapped)))


def _vectors(terms: dict[bytes, int]):
    """Per document: doc_id, n (all its terms), and places and counts of the terms in `terms`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, codes, words = terms_of(batch.column("text"))
                wanted = np.fromiter((terms.get(w, -1) for w in words), np.int64, len(words))[codes] if len(words) else codes
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[wanted >= 0]
                key, count = np.unique(row * max(len(terms), 1) + wanted[wanted >= 0], return_counts=True)
                row, term = key // max(len(terms), 1), key % max(len(terms), 1)
                ends = pa.array(np.searchsorted(row, np.arange(len(offsets))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(t))) for x, t in ((term, np.int32), (count, np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return run


class Block:
    """Impact lists of some documents, with direct access: for each entry of a document its term and its place in the term's list."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.bounds, self.terms, self.impacts = ids, bounds, terms, impacts
        owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
        order = np.lexsort((owner, -impacts, terms))
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.documents, self.heights = owner[order], impacts[order]
        self.place = np.empty(len(order), np.int64)  # of each entry, in all lists laid end to end
        self.place[order] = np.arange(len(order))

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold every one of the `k` highest scores above 0 and not below `floor`, equal ones included."""
        there = self.lists[terms + 1] > self.lists[terms]
        terms, repeats = terms[there], repeats[there]
        first, last = self.lists[terms], self.lists[terms + 1]
        times = np.zeros(len(self.lists), np.int64)
        times[terms] = repeats
        seen = np.zeros(len(self.place), bool)
        scored = np.zeros(len(self.ids), bool)
        position = first.copy()  # the first unseen place of each list
        documents, scores = [], []
        at, depth, kth = 0, ROUND, floor
        while len(terms):
            going = position < last
            if not going.any():
                break
            # an exhausted list has nothing unseen left, and a document in none of the others can't be new
            if int((self.heights[position[going]] * repeats[going]).sum()) < kth:
                break
            reading = np.flatnonzero(first + at < last)
            if not len(reading):
                break
            spans = [self.documents[first[x] + at : min(first[x] + at + depth, last[x])] for x in reading]
            met = np.unique(np.concatenate(spans))
            met = met[~scored[met]]
            at, depth = at + depth, min(2 * depth, 4096)
            if len(met):
                scored[met] = True
                sizes = self.bounds[met + 1] - self.bounds[met]
                entry = np.repeat(self.bounds[met] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                worth = self.impacts[entry] * times[self.terms[entry]]
                total = np.add.reduceat(worth, np.cumsum(sizes) - sizes)
                seen[self.place[entry[worth > 0]]] = True
                documents.append(met)
                scores.append(total)
                if len(documents) > 1 or len(total) >= k:
                    every, whose = np.concatenate(scores), np.concatenate(documents)
                    if len(every) > k:
                        kth = max(kth, int(np.partition(every, len(every) - k)[len(every) - k]))
                        stay = every >= kth
                        every, whose = every[stay], whose[stay]
                    elif len(every) == k:
                        kth = max(kth, int(every.min()))
                    documents, scores = [whose], [every]
            for x in np.flatnonzero(position < last):  # move best positions over what has been seen
                while position[x] < last[x]:
                    part = seen[position[x] : min(position[x] + 4096, last[x])]
                    gap = int(part.argmin())
                    if not part[gap]:
                        position[x] += gap
                        break
                    position[x] += len(part)
        if not documents:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        whose, every = np.concatenate(documents), np.concatenate(scores)
        good = (every > 0) & (every >= floor)
        return whose[good], every[good]


def _ranked(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_all: int, k: int):
    """A task's `k` best documents of each item, block by block; what a block finds raises the bar for the next ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def search() -> None:
            ids, n, sizes, terms, counts = (np.concatenate(x) for x in zip(*held))
            m = 75 + (25 * n * n_docs) // n_all
            m = np.repeat(m, sizes)
            impacts = weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 12 * m))
            block = Block(ids, np.concatenate([[0], np.cumsum(sizes)]), terms, impacts, len(weights))
            for x, (_, wanted, repeats) in enumerate(items):
                old_ids, old_scores = best[x]
                rows, scores = block.best(wanted, repeats, k, int(old_scores.min()) if len(old_scores) >= k else 0)
                new_ids, new_scores = np.concatenate([old_ids, ids[rows]]), np.concatenate([old_scores, scores])
                order = np.lexsort((new_ids, -new_scores))[:k]
                best[x] = (new_ids[order], new_scores[order])

        for whole in batches:
            for start in range(0, whole.num_rows, 10_000):
                batch = whole.slice(start, 10_000)
                terms, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("terms", "counts"))
                sizes = np.diff(batch.column("terms").offsets.to_numpy()).astype(np.int64)
                held.append((batch.column("doc_id").to_numpy(), batch.column("n").to_numpy(), sizes, terms, counts))
                size += len(terms)
                if size >= BLOCK_ENTRIES:
                    search()
                    held, size = [], 0
        if held:
            search()
        rows = [(x, i, s) for (x, _, _), (ids, scores) in zip(items, best) for i, s in zip(ids.tolist(), scores.tolist())]
        columns = [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    return run


def _blocks_of_items(items: DataFrame) -> tuple[DataFrame, int]:
    """`items` (distinct rows) with the number of the block that each item belongs to, and how many blocks there are."""
    words = items.agg(F.coalesce(F.sum(F.floor(F.length(F.coalesce("text", F.lit(""))) / 2) + 1), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(words / ITEM_WORDS))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), blocks


def _search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for the items in `rows` (item_id, text)."""
    spark = docs.sparkSession
    offsets, codes, words = terms_of(pa.array([r.text for r in rows], pa.string()))
    numbers = {word: x for x, word in enumerate(words)}
    asked: dict[object, list[np.ndarray]] = {}
    for x, row in enumerate(rows):
        asked.setdefault(row.item_id, []).append(codes[offsets[x] : offsets[x + 1]])
    wanted = [(item, *np.unique(np.concatenate(parts), return_counts=True)) for item, parts in asked.items()]
    vectors = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vectors(numbers), "doc_id long, n long, terms array<int>, counts array<long>"), "vectors")
    n_docs, n_all = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator())
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(x, 0) + 1))) for x in range(len(words))], np.int64)
    numbered = [(x, terms, repeats) for x, (_, terms, repeats) in enumerate(wanted)]
    named = spark.createDataFrame([(x, item) for x, (item, _, _) in enumerate(wanted)], "item int, item_id long")
    found = vectors.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(_ranked(numbered, weights, n_docs, n_all, k), "item int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
    ranked = found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The `k` highest-scoring rows of `docs` for each item of `items`: item_id, rank, doc_id, score (above 0, ties by smaller doc_id).

    Terms are letters, digits and characters outside ASCII, A-Z as a-z. Rows
    of equal item_id are one item with the terms of its different texts; an item
    without terms, or with none that a document holds, has no rows. Null texts
    have no terms; rows without doc_id count in N, L and the document
    frequencies but are not ranked, rows without item_id are no items; repeated
    rows of `docs` are ranked each. Items are read in blocks of about
    ITEM_WORDS words, all rows of an item in one; each block takes a pass over
    `docs` and is written before the next is read.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), "text").where("item_id IS NOT NULL").distinct()
    placed, blocks = _blocks_of_items(asked)
    out = None
    for block in range(blocks):
        rows = placed.where(F.col("block") == block).orderBy("item_id", "text").collect()
        if not any(r.text for r in rows):
            continue
        found = _search(docs, rows, k)
        found = found if blocks == 1 else stored(found, "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = """
WITH given AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
sizes AS (SELECT k, doc_id, len(terms)::BIGINT AS n FROM given),
corpus AS (SELECT count(*) FILTER (n > 0) AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
counts AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM given) GROUP BY k, term),
weights AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, corpus GROUP BY term, big_n),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, term),
scored AS (SELECT item_id, k, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (k), corpus GROUP BY item_id, k, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
WHERE rank <= 20
"""
