import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from dosefold.llm import periodic_runs as pr
from dosefold.llm.common import word_codes
from dosefold.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, runs int, start string"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_runs(words, least=12):
    """Every run straight from its definition: for each period the maximal stretches, without those of a smaller period."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                stretch = words[i : i + length]
                if not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    assert len({(s, n) for s, n, _ in out}) == len(out)
    return sorted(out, key=lambda r: (r[0], r[2]))


def runs_by_period(words, least=12):
    """As plain_runs, for long texts: each period by one comparison of the whole text with itself."""
    codes = np.unique(words, return_inverse=True)[1] if words else np.empty(0, int)
    spans = {}
    for q in range(1, len(codes) // 2 + 1):
        edges = np.diff(np.concatenate([[0], codes[:-q] == codes[q:], [0]]).astype(int))
        for i, j in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
            if j - i + q >= max(least, 2 * q):
                spans.setdefault((i, j - i + q), q)  # a multiple of the period has the same span
    return sorted(((i, n, q) for (i, n), q in spans.items()), key=lambda r: (r[0], r[2]))


def looped(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, words, found):
    dropped = {x for s, n, q in found for x in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    numbers = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *numbers, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def texts():
    draw = random.Random(11)
    out = ["", None, "  ", "a", "a " * 12, "a " * 11, "b " + "a " * 300, "a b " * 200 + "a", ("a a b " * 9 + "a a c ") * 7, "x y z " * 4, "x y z " * 3 + "x y"]
    for alphabet in ("ab", "abc", "abcd"):  # small alphabets give many overlapping runs
        for n in (30, 80, 200):
            out += [" ".join(draw.choice(alphabet) for _ in range(n)) for _ in range(12)]
    for _ in range(60):  # powers of words, in other words, with faults
        block = [draw.choice("abcdefgh") for _ in range(draw.randrange(1, 30))]
        body = (block * 8)[: draw.randrange(2, 8 * len(block) + 1)]
        if draw.random() < 0.5:
            body[draw.randrange(len(body))] = "!"
        out.append("\n".join([draw.choice("abc") for _ in range(draw.randrange(5))] + body * draw.randrange(1, 4) + [draw.choice("abc")] * draw.randrange(5)))
    fibonacci = ["a", "b"]
    while len(fibonacci) < 400:
        fibonacci += fibonacci[: len(fibonacci) // 2] if len(fibonacci) < 5 else fibonacci[: int(len(fibonacci) * 0.618)]
    return out + [" ".join(fibonacci), " ".join("ab"[bin(i).count("1") % 2] for i in range(300)), "é ü " * 20, "\x0b\x0c a\x01 \x0b" * 30]


def found_in(text_list, least=12):
    offsets, codes, _ = word_codes(pa.array(text_list, pa.string()))
    start, length, period = pr.runs_of(offsets, codes, least)
    owner = np.searchsorted(offsets, start, side="right") - 1
    out = [[] for _ in text_list]
    for o, s, n, q in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
        out[o].append((s - int(offsets[o]), n, q))
    return out


@pytest.mark.parametrize("least", [12, 2])
def test_runs_against_definition(least):
    given = texts()
    want = [plain_runs(words_of(t), least) for t in given]
    assert found_in(given, least) == want
    assert [found_in([t], least)[0] for t in given[:40]] == want[:40]
    assert sum(map(len, want)) > 300


def test_proposals_stay_linear():
    for body in (["a"] * 4096, ["a", "b"] * 2048, (["a"] * 15 + ["b"]) * 256):
        codes = np.array([ord(w) for w in body])
        offsets = np.array([0, len(codes)])
        made = []
        real = pr._proposed
        try:
            pr._proposed = lambda *x: made.append(real(*x)) or made[-1]
            pr.runs_of(offsets, codes)
        finally:
            pr._proposed = real
        assert sum(len(left) for left, _ in made) <= 6 * len(codes) * 12


def test_table_with_nulls_ties_and_clashing_columns(spark):
    given = [(i, t, i, "s") for i, t in enumerate(texts())] + [(None, "a " * 20, 1, None), (3, "a", None, None), (3, "a", None, None)]
    got = pr.periodic_runs(spark.createDataFrame(given, SCHEMA).repartition(3)).collect()
    want = sorted(str((d, plain_runs(words_of(t)))) for d, t, *_ in given)
    assert sorted(str((r.doc_id, [tuple(x) for x in r.runs])) for r in got) == want
    assert pr.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_planted_loops(spark):
    given = [(i, f" w{i} " + " ".join(f"v{k}" for k in range(i % 50)), 0, "") for i in range(400)] + [(None, "a b", 0, ""), (5, None, 0, "")] + [(k, "", 0, "") for k in range(300, 340)]
    got = pr.with_planted_loops(spark.createDataFrame(given, SCHEMA)).collect()
    want = sorted(str((d, looped(d, words_of(t)))) for d, t, *_ in given)
    assert sorted(str((r.doc_id, words_of(r.text))) for r in got) == want


def test_query_on_whole_table(spark):
    given = [(r.doc_id, looped(r.doc_id, words_of(r.text))) for r in table(spark, FOLDER, "documents").collect()]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    assert len(got) == len(given)
    for doc_id, words in given:
        found = runs_by_period(words)
        if len(words) <= 300:  # the definition is cubic
            assert found == plain_runs(words)
        assert got[doc_id] == plain_row(doc_id, words, found)
