import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from dosefold.llm import common, minhash
from dosefold.llm.components import components
from dosefold.llm.queries import QUERIES, table

SCHEMA = "doc_id long, text string, hub string, kept int"
FOLDER = "/root/testdata/sf0.001"


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    sets = [shingles(r[1], k) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i]:
            continue
        common = len(sets[i] & sets[j])
        if common and den * common >= num * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(rows[i][0]), root(rows[j][0])))
            parent[b] = a
    return sorted(((r[0], len(s), root(r[0]) if r[0] is not None else None) for r, s in zip(rows, sets)), key=str)


def family(draw, base, n, words):
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(draw.randrange(0, 9)):
            copy[draw.randrange(len(copy))] = draw.choice(words)
        out.append(" ".join(copy))
    return out


def rows():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for n in (60, 20, 8):
        texts += family(draw, [draw.choice(words) for _ in range(draw.choice([80, 120]))], n, words)
    texts += [" ".join(draw.choice(words) for _ in range(60)) for _ in range(40)]
    texts += ["", None, " \n\t", "one", "One", "one two", "a b c", "a b c d", texts[0].upper(), texts[0].replace(" ", "\n")]
    draw.shuffle(texts)
    return [(i, t, "", i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_against_all_pairs(spark, k, num):
    given = rows()
    got = minhash.near_dedup(spark.createDataFrame(given, SCHEMA), k, num).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(given, k, num, 100)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_tiles_nulls_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 7)  # several tiles around a hub
    given = rows()[:90] + [(None, "one two three four", "", 1), (None, None, "", 1), (3, rows()[3][1], "", 2)]
    df = spark.createDataFrame(given, SCHEMA)
    got = minhash.near_dedup(df, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(given, 3, 85, 100)
    kept = minhash.near_kept(df, 3, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r.doc_id for r in got if r.kept or r.doc_id is None), key=str)


def test_empty_table(spark):
    assert minhash.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_are_close():
    draws = np.random.default_rng(2)
    sets = [np.unique(draws.integers(0, 2**63, 1000, dtype=np.uint64))]
    for share in (0.9, 0.6, 0.2, 0.0):
        n = int(1000 * 2 * share / (1 + share))
        sets.append(np.unique(np.concatenate([sets[0][:n], draws.integers(0, 2**63, 1000 - n, dtype=np.uint64)])))
    packed = minhash.signatures(sets)
    found = minhash.estimated(packed, packed)[0]
    assert np.abs(found - [1.0, 0.9, 0.6, 0.2, 0.0]).max() < 0.15
    common = minhash.common_counts(sets, 64)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(i))


def test_components_of_chains(spark):
    draw = random.Random(1)
    ids = list(range(300))
    draw.shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(299) if i % 60 != 59] + [(ids[5], ids[5]), (ids[3], ids[2])]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(ids[i - i % 60 : i - i % 60 + 60]) for i, x in enumerate(ids)}
    assert got == want


def test_whole_table(spark):
    given = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    got = QUERIES["op2_minhash"](spark, FOLDER).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(given, 3, 85, 100)


def test_slices_of_a_batch_do_not_change_sets(monkeypatch):
    given = rows()
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in given], pa.int64()), "text": pa.array([r[1] for r in given], pa.string())})
    monkeypatch.setattr(minhash, "slices", lambda whole, column: common.slices(whole, column, 1000))
    parts = list(minhash._features(3)(iter([batch.slice(3)])))
    assert len(parts) > 20
    got = {r["doc_id"]: r["n_shingles"] for part in parts for r in part.to_pylist()}
    assert got == {r[0]: len(shingles(r[1], 3)) for r in given[3:]}


def test_batch_of_several_slices(spark):
    draw = random.Random(8)
    words = [f"Word{i}" for i in range(4000)]
    base = [draw.choice(words) for _ in range(3000)]
    texts = family(draw, base, 40, words) + [" ".join(draw.choice(words) for _ in range(3000)) for _ in range(260)]
    far = list(base)
    for k in range(0, 3000, 24):  # near the threshold: each change undoes three shingles
        far[k] = "x"
    texts += [" ".join(far), texts[0].lower(), texts[0].upper()]
    draw.shuffle(texts)
    given = [(i, t, "", 0) for i, t in enumerate(texts)]
    assert sum(len(t) for t in texts) > 6 << 20
    df = spark.createDataFrame(given, SCHEMA).coalesce(1)
    got = minhash.near_components(df, 3, 85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(given, 3, 85, 100)


def exact_components(rows, k, num, den):
    """All links by an exact join: rarest shingles first, sizes compared, counts on whole sets."""
    sets = [shingles(t, k) for _, t in rows]
    seen = Counter(x for s in sets for x in s)
    parent, index = list(range(len(rows))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(range(len(rows)), key=lambda i: len(sets[i])):
        own = sets[i]
        prefix = sorted(own, key=lambda x: (seen[x], x))[: len(own) + (-len(own) * num // den) + 1]
        for j in {j for x in prefix for j in index[x]}:
            if len(sets[j]) * den >= num * len(own) and root(i) != root(j):
                common = len(own & sets[j])
                if den * common >= num * (len(own) + len(sets[j]) - common):
                    parent[root(i)] = root(j)
        for x in prefix:
            index[x].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_larger_table_against_an_exact_join(spark, k, num):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    got = minhash.near_components(docs, k, num).collect()
    assert sorted(map(tuple, got)) == exact_components([(r.doc_id, r.text) for r in docs.collect()], k, num, 100)
