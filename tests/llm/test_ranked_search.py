import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from dosefold.llm import ranked_search as rs
from dosefold.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, score long, rank int, item_id long"
ITEMS = "item_id long, text string, doc_id long, term string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, k=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_all = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    frequency = Counter(term for _, c in counts for term in c)
    asked = {}
    for item, text in sorted({(i, t) for i, t in items if i is not None}, key=str):
        asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for doc_id, c in counts:
            if doc_id is None or not c:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_all
            score = 0
            for term, times in wanted.items():
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[term] + 1)))
                    score += times * w * ((1000000000 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                found.append((-score, doc_id))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


def tables(n=300):
    draw = random.Random(4)
    words = [f"w{int(300 * draw.random() ** 3)}" for _ in range(400)] + ["café", "ÜBER", "x-y", "9"]
    docs = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([3, 20, 60, 200]))), 1, 1, 1) for i in range(n)]
    docs += [(n, "", 1, 1, 1), (n + 1, None, 1, 1, 1), (n + 2, "--- !!", 1, 1, 1), (None, "w1 w2 w3 w4", 1, 1, 1), (5, docs[5][1], 2, 2, 2)]
    docs += [(n + 10 + i, docs[9][1], 1, 1, 1) for i in range(40)]  # ties beyond the last rank
    docs += [(n + 60, "W1 " * 50_000, 1, 1, 1)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([1, 5, 40]))), 7, "t") for i in range(30)]
    items += [(30, docs[9][1], 7, ""), (31, None, 7, ""), (32, "", 7, ""), (33, "nowhere at all", 7, ""), (None, "w1", 7, ""), (1, items[1][1], 7, ""), (2, "w7 w7 w7", 7, "")]
    return docs, items


def test_against_full_scores(spark):
    docs, items = tables()
    got = rs.ranked_search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_search([d[:2] for d in docs], [i[:2] for i in items])


def test_several_blocks_of_items_and_few_ranks(spark, monkeypatch):
    monkeypatch.setattr(rs, "ITEM_WORDS", 100)
    docs, items = tables(60)
    got = rs.ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 3).collect()
    assert sorted(map(tuple, got)) == plain_search([d[:2] for d in docs], [i[:2] for i in items], 3)


def test_empty_tables(spark):
    docs, items = tables(12)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert rs.ranked_search(d.limit(0), i).count() == 0
    assert rs.ranked_search(d, i.limit(0)).count() == 0
    assert rs.ranked_search(d, i.where("text IS NULL")).count() == 0


def made_block(draws, n, n_terms, top):
    sizes = draws.integers(1, 12, n)
    lists = [np.sort(draws.choice(n_terms, s, replace=False)) for s in sizes]
    found = np.concatenate(lists)
    impacts = draws.integers(0, top, len(found)).astype(np.int64)
    return rs.Block(np.arange(n) * 3, np.concatenate([[0], np.cumsum(sizes)]), found, impacts, n_terms), lists, impacts


def test_best_positions_against_all_scores():
    draws = np.random.default_rng(6)
    for trial in range(60):
        n, n_terms, top = int(draws.choice([5, 200, 3000])), 40, int(draws.choice([3, 1000]))
        block, lists, impacts = made_block(draws, n, n_terms, top)
        terms_asked = np.sort(draws.choice(n_terms, int(draws.integers(1, 20)), replace=False))
        repeats = draws.integers(1, 4, len(terms_asked))
        times = dict(zip(terms_asked.tolist(), repeats.tolist()))
        scores, at = [], 0
        for found in lists:
            scores.append(sum(times.get(int(t), 0) * int(impacts[at + x]) for x, t in enumerate(found)))
            at += len(found)
        want = sorted(((-s, i) for i, s in enumerate(scores) if s > 0))[:20]
        for floor in (0, -want[-1][0] if len(want) == 20 else 0):
            rows, got = block.best(terms_asked, repeats, 20, floor)
            assert sorted(zip((-got).tolist(), rows.tolist()))[:20] == want


def test_reading_stops_early():
    """Lists whose tops agree: few places are read."""
    n = 200_000
    impacts = np.repeat(np.arange(n, 0, -1), 2).astype(np.int64)
    block = rs.Block(np.arange(n), np.arange(n + 1) * 2, np.tile([0, 1], n), impacts, 2)
    reads = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                reads.append(key.stop - key.start)
            return super().__getitem__(key)

    block.documents = block.documents.view(Watched)
    rows, scores = block.best(np.array([0, 1]), np.array([1, 1]), 20)
    assert sorted(rows.tolist())[:20] == list(range(20)) and sum(reads) < 1000


def test_terms_of_slices():
    given = ["A-b É9", "", None, "x", "tail Z"] * 50
    whole = pa.array(given, pa.string())
    for start, size in ((0, 250), (3, 100), (17, 1)):
        offsets, codes, words = rs.terms_of(whole.slice(start, size))
        got = [[words[c].decode() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
        assert got == [terms(t) for t in given[start : start + size]]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    got = sorted(map(tuple, QUERIES["op13_ranked_search"](spark, FOLDER).collect()))
    assert got == plain_search(docs, items)
