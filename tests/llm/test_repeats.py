import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosefold.llm import repeats
from dosefold.llm.queries import QUERIES, table

SCHEMA = "doc_id long, text string, tag string, begin int"
FOLDER = "/root/testdata/sf0.001"


def brute(rows, length=400):
    texts = [(r[1] or "").encode() for r in rows]
    seen = Counter(hash(t[i : i + length]) for t in texts for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, texts):
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[hash(t[i : i + length])] > 1:
                gone[i + 1 : i + length + 1] = 1
        rest = np.frombuffer(t, np.uint8)[gone[1 : len(t) + 1] == 0].tobytes()
        out.append((r[0], len(t), len(t) - len(rest), int((np.diff(gone) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def rows():
    draw = random.Random(9)
    make = lambda n: "".join(draw.choice("abcdefgh é\n") for _ in range(n))
    shared, other = make(900), make(500)
    texts = [make(700) + shared + make(50), shared[:399], shared[:400], make(10) + shared[200:700] + make(10), other + make(300) + other, shared, shared]
    texts += [make(600), "", None, "ab" * 700, "ba" * 300, "x" * 450, "y" * 400, shared[:450] + make(3) + shared[460:900]]
    base = make(1500)
    for i in range(40):
        copy = list(base)
        for _ in range(draw.randrange(0, 6)):
            copy[draw.randrange(len(copy))] = draw.choice("XYZ")
        texts.append("".join(copy))
    out = [(i, t, "t", 0) for i, t in enumerate(texts)]
    return out + [(None, shared[:600], "", 1), (None, make(800), "", 1), (5000, "same row " * 60, "", 1), (5000, "same row " * 60, "", 1), (5001, make(500), "", 1), (5001, make(420), "", 1)]


@pytest.mark.parametrize("hot,piece", [(512, 4 << 20), (3, 1000)])
def test_against_brute_force(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(repeats, "HOT", hot)
    got = None
    if piece != repeats.PIECE:  # pieces are cut inside the tasks: checked without Spark below
        import pyarrow as pa

        monkeypatch.setattr(repeats, "PIECE", piece)
        data, found = repeats._pieces(pa.array([r[1] for r in rows()]))
        windows = [(row, inside + k) for row, inside, a, b in found for k in range(b - a - 399)]
        assert len(windows) == len(set(windows)) == sum(max(0, len((r[1] or "").encode()) - 399) for r in rows())
    got = repeats.repeats(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_empty_table(spark):
    assert repeats.repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("ab", min_size=0, max_size=12)), min_size=1, max_size=14))
def test_mergesort(given_):
    given_ = sorted(given_, key=lambda x: x[0])
    data = "".join(t for _, t in given_).encode() + b"z"
    sizes = np.array([len(t) for _, t in given_])
    made = repeats.Suffixes(np.frombuffer(data, np.uint8), np.cumsum(sizes) - sizes, sizes)
    order = made.mergesorted(np.array([g for g, _ in given_]))
    assert [given_[k] for k in order.tolist()] == sorted(given_)
    n = len(given_)
    a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    import os

    assert made.extension(a, b).tolist() == [len(os.path.commonprefix([given_[i][1], given_[j][1]])) for i, j in zip(a, b)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=1, max_size=6), st.booleans())
def test_runs_and_groups(texts, collide):
    """All windows of a small length, through runs and groups; also with hashes that always collide."""
    data = np.frombuffer("".join(texts).encode() or b"-", np.uint8)
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    text, begin, count, place, key, content = repeats.runs(data, starts, starts + sizes, 6)
    assert count.sum() == np.maximum(sizes - 5, 0).sum()
    if not len(text):
        return
    order = np.argsort(key, kind="stable")
    begin, count, place, key = (x[order] for x in (begin, count, place, key))
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    kept = repeats._values.copy()
    if collide:
        repeats._values[:] = 0
    try:
        found = repeats.repeated(data, begin, count, place, group, 6)
    finally:
        repeats._values[:] = kept
    got = sorted({int(begin[k]) + w for k, a, b in found for w in range(a, b + 1)})
    whole = data.tobytes()
    windows = [int(s) + i for s, n in zip(starts, sizes) for i in range(n - 5)]
    seen = Counter(whole[w : w + 6] for w in windows)
    # windows that repeat inside one run have the same anchor place and can't: each run holds different places
    assert got == sorted(w for w in windows if seen[whole[w : w + 6]] > 1)


def test_whole_table(spark):
    given_ = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    assert sorted(map(tuple, QUERIES["op7_repeats"](spark, FOLDER).collect()), key=str) == brute(given_)


def test_a_common_passage_makes_no_group(spark, monkeypatch):
    """A passage in many documents, each with its own surroundings: no run of its anchors goes to the comparison in a task."""
    draw = random.Random(4)
    make = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    passage = make(640)
    given_ = [(i, make(250) + passage + make(250), "", 0) for i in range(40)]
    monkeypatch.setattr(repeats, "HOT", 8)
    compare = repeats._compare

    def noted(batches):
        for batch in batches:
            most = max(Counter(batch.column("key").to_pylist()).values(), default=0)
            assert most <= 8, f"{most} runs of one key in one task"
            yield from compare(iter([batch]))

    monkeypatch.setattr(repeats, "_compare", noted)
    got = repeats.repeats(spark.createDataFrame(given_, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(given_) and min(r.n_removed for r in got) >= 640


@pytest.mark.parametrize("bits", [2, 9])
def test_colliding_contents_are_told_apart(spark, bits):
    """With a few bits of the content hash many different runs of an anchor look equal; their bytes tell."""
    draw = random.Random(3)
    make = lambda n: "".join(draw.choice("abcdefgh") for _ in range(n))
    common = make(260)
    given_ = rows() + [(6000 + i, make(150) + common + make(150), "", 0) for i in range(60)]
    df = spark.createDataFrame(given_, SCHEMA)
    cut = {(r.doc_id, r.kept_sha256): r for r in repeats.repeats_cut(df, bits).collect()}
    for doc_id, size, removed, spans, sha in brute(given_):
        if removed:
            assert (cut[doc_id, sha].n_removed, cut[doc_id, sha].n_spans) == (removed, spans)
    assert not {k for k, r in cut.items() if r.n_removed} - {(b[0], b[4]) for b in brute(given_)}


def test_hot_keys_in_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST", 20)
    monkeypatch.setattr(repeats, "SHARE", 50)
    shared = rows()[5][1]
    given_ = rows() + [(7000 + i, shared, "", 0) for i in range(80)] + [(None, shared, "", 0)] * 10 + [(8000 + i, f"{i:05d}" * 90 + shared, "", 0) for i in range(40)]
    got = repeats.repeats(spark.createDataFrame(given_, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == brute(given_)
