import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dosefold.llm import quality, toxicity
from dosefold.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, score double, label string"
LABELS = "doc_id long, quality int, toxic int, text string"


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def given(n=400):
    words = "river stone meadow cloud winter garden paper lamp".split()
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        body = [words[(i * 7 + j * j) % len(words)] for j in range(12 + i % 9)]
        text = " ".join(body[:5] + ["Scum!"] * bad + body[5:]) if i % 8 else " ".join(body[:3] + ["you", "utter", "fool"] * bad + body[3:])
        docs.append((i, text, 0.1, "x"))
        labels.append((i, int(not bad), int(bad), "y"))
    docs += [(None, None, None, None), (n, "", None, None), (n + 1, None, 0.0, ""), (1, docs[1][1], 0.2, ""), (n + 2, "é " * 30000, None, None)]
    return docs, labels + [(None, 1, 1, ""), (2, None, None, "")]


def test_ftrl_against_plain_formula():
    draws = np.random.default_rng(3)
    rows = [(int(draws.random() < 0.4), np.unique(draws.integers(0, 60, 7)).astype(np.int32)) for _ in range(200)]
    places, weights, bias = toxicity.ftrl(rows, 6, alpha=0.5, beta=1.0, l1=0.4, l2=1.0, rounds=2)
    z, n, b, bn = [0.0] * 64, [0.0] * 64, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= 0.4:
            return 0.0
        return -(z[i] - (0.4 if z[i] > 0 else -0.4)) / ((1.0 + n[i] ** 0.5) / 0.5 + 1.0)

    for _ in range(2):
        for label, ids in rows:
            w = {int(i): weight(i) for i in ids}
            g = 1 / (1 + np.exp(-(b + sum(w.values())))) - label
            for i, v in w.items():
                step = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
                z[i] += g - step * v
                n[i] += g * g
            bn += g * g
            b -= 0.5 / (1 + bn**0.5) * g
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert set(map(int, places)) == set(want) and 0 < len(want) < 60
    assert max(abs(want[int(i)] - w) for i, w in zip(places, weights)) < 1e-3 and abs(bias - b) < 1e-3


def test_features_are_words_neighbours_and_skips():
    rows, places = toxicity.features(pa.array(["a B c", None, "", "x"]), 24)
    assert list(rows) == [0, 0, 0, 3, 0, 0, 0] and len(places) == 7
    assert set(toxicity.features(pa.array(["«b»,"]), 24)[1]) == set(toxicity.features(pa.array(["B"]), 24)[1])


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_small_tables(spark, kind):
    docs, labels = given()
    run = toxicity.toxicity if kind == "toxic" else quality.quality
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = run(d, l).collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in docs), key=str)
    assert all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    turned = [(i, 1 - q, 1 - t, x) if held(i) and q is not None else (i, q, t, x) for i, q, t, x in labels]
    again = run(d, spark.createDataFrame(turned, LABELS)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    if kind == "toxic":
        right = [(r.predicted == 1) == (r.doc_id % 4 == 0) for r in got if r.held_out and r.doc_id < 400]
        assert np.mean(right) > 0.9
    empty = run(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.columns == ["doc_id", "held_out", "score", "predicted"] and empty.count() == 0
    assert {r.score for r in run(d, spark.createDataFrame([], LABELS)).collect()} <= {0.5} if kind == "toxic" else True


def test_clean_documents_keeps_columns(spark):
    docs, labels = given()
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    kept = toxicity.clean_documents(d, l)
    ids = sorted((r.doc_id for r in toxicity.toxicity(d, l).where("predicted = 0").collect()), key=str)
    assert kept.columns == d.columns and sorted((r.doc_id for r in kept.collect()), key=str) == ids


def test_worth_follows_preferences():
    draws = np.random.default_rng(1)
    x = draws.normal(size=(600, 3))
    label = (x @ [2.0, -1.0, 0.0] + draws.logistic(size=600) * 0.3 > -1).astype(int)
    w, cut = quality.bradley_terry(x, label)
    assert w[0] > 0 > w[1] and abs(w[2]) < 0.3 * w[0] and ((x @ w >= cut) == label).mean() > 0.9


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r for r in table(spark, FOLDER, "labels").collect()}
    good = QUERIES["op6_quality"](spark, FOLDER).collect()
    assert len(good) == 1000
    rows = [(r.predicted, labels[r.doc_id].quality) for r in good if r.held_out and r.doc_id in labels]
    assert np.mean([p == y for p, y in rows]) > 0.95


@pytest.mark.parametrize("rows", [3999, 4000, 9000])
def test_every_row_of_the_commoner_label_is_fitted(rows):
    """One rule at every size: 1 % bad; each of ten good rows alone has a value in a column, whose weight is 0 if the row isn't drawn."""
    label = (np.arange(rows) >= rows // 100).astype(int)
    x = np.zeros((rows, 11))
    x[:, 0] = np.random.default_rng(3).normal(size=rows) + label
    x[np.arange(10) + rows - 10, np.arange(1, 11)] = 1
    w, _ = quality.bradley_terry(x, label)
    assert (w != 0).all()


def plain_measures(text):
    """The measures of one text, character by character."""
    data = (text or "").encode()
    if not data:
        return [0.0] * 24
    kinds = Counter()
    for b in data:
        c = chr(b)
        for name, chars in (("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", "abcdefghijklmnopqrstuvwxyz"), ("digit", "0123456789"), ("stop", ",.;:"),
                            ("call", "!?"), ("bar", "|"), ("sign", "#$%&*+=<>@^_~\\/"), ("quote", "()[]{}\"'`-")):
            kinds[name] += c in chars
        kinds["other"] += b >= 0xC0
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = data.split(b"\n")
    n, count = len(data), len(words)
    some = max(count, 1)
    letters = max(kinds["upper"] + kinds["lower"] + kinds["other"], 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / some
    distinct, most = len(set(words)) / some, max(Counter(words).values(), default=0) / some
    marked = sum(w[-1] < 128 and not w[-1:].isalnum() for w in words) / some
    share = {k: v / n for k, v in kinds.items()}
    return [
        kinds["upper"] / letters, share["digit"], share["stop"], share["call"], share["bar"], share["sign"], share["quote"], share["other"],
        math.sqrt(share["call"]), math.sqrt(share["bar"]), math.sqrt(share["sign"]), math.sqrt(again), again,
        sum(map(len, words)) / some / 10, marked, distinct, most, most**2,
        math.log1p(count) / 10, len(lines) / some, 1 - len(set(lines)) / len(lines), math.log1p(count) / 10 * distinct,
        float(count < 5), float(count < 20),
    ]


ODD = ["", None, " ", "a", "A a a\n\nb!", "é Ünï 12, 3;", "x|y|z ((" * 40, "word " * 3000, "\n\n\n", "one two three four five.\nsix\nsix\n", "\x01 \x02"]


def test_measures_against_plain_version(spark):
    texts = ODD + [r.text for r in table(spark, FOLDER, "documents").limit(300).collect()]
    assert np.allclose(quality.measures(pa.array(texts)), [plain_measures(t) for t in texts], rtol=1e-12, atol=0)


def test_scores_do_not_depend_on_the_batch(spark):
    texts = pa.array(ODD + [r.text for r in table(spark, FOLDER, "documents").collect()])
    weights = np.random.default_rng(4).normal(size=24)
    whole = quality.worths(quality.measures(texts), weights)
    for size in (1, 7, 500):
        parts = [quality.worths(quality.measures(texts.slice(k, size)), weights) for k in range(0, len(texts), size)]
        assert (np.concatenate(parts) == whole).all()


def test_whole_query_against_plain_scores(spark):
    """Every score of the query again from plain measures and the fitted weights, one text at a time."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    weights, cut = quality.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality"](spark, FOLDER).collect()}
    for row in docs.collect():
        worth = math.fsum(a * b for a, b in zip(plain_measures(row.text), weights)) - cut + math.log(0.3 / 0.7)
        score = 1 / (1 + math.exp(-min(max(worth, -35), 35)))
        assert abs(got[row.doc_id].score - score) < 1e-9 and got[row.doc_id].predicted == int(got[row.doc_id].score >= 0.3)
    assert len(got) == docs.count()
