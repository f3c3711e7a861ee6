import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dosefold.llm import pieces
from dosefold.llm.queries import QUERIES, table

FOLDER = "/root/testdata/sf0.001"


def small(found):
    made = pieces.Pieces.__new__(pieces.Pieces)
    made.byte_ids = np.arange(1000, 1256).astype(np.int32)
    made.text = [p.replace(b"\xe2\x96\x81", b" ") for p, *_ in found] + [b""] * (1000 - len(found)) + [bytes([i]) for i in range(256)]
    made.build(found)
    return made


SOME = [(p.encode(), i, s) for i, (p, s) in enumerate([("a", -1.5), ("b", -2.0), ("ab", -2.5), ("abc", -9.0), ("▁", -1.0), ("▁a", -2.25), ("ca", -1.0), ("bab", -3.0), ("é", -2.0), ("▁▁", -1.5)])]


def best_score(model, text):
    """The best sum of scores over every way to cut `text`."""
    data = ("▁" + text.replace(" ", "▁")).encode()
    scores = {p: s for p, _, s in SOME}
    best = [0.0] + [-np.inf] * len(data)
    for j in range(1, len(data) + 1):
        best[j] = best[j - 1] + (0.0 if data[j - 1] & 0xC0 == 0x80 else model.penalty)
        for i in range(j):
            if data[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[data[i:j]])
    return best[-1]


def score_of(model, ids, text):
    data = ("▁" + text.replace(" ", "▁")).encode()
    total, at = 0.0, 0
    for i in ids:
        if i >= 1000:
            total += 0.0 if data[at] & 0xC0 == 0x80 else model.penalty
            at += 1
        else:
            total += SOME[i][2]
            at += len(SOME[i][0])
    assert at == len(data)
    return total


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc é▁x\n", max_size=14), min_size=1, max_size=5))
def test_best_scores_and_round_trip(texts):
    model = small(SOME)
    ids, offsets = model.encode(pa.array(texts))
    for text, a, b in zip(texts, offsets[:-1], offsets[1:]):
        if text:
            assert abs(score_of(model, ids[a:b].tolist(), text) - best_score(model, text)) < 1e-9
            assert ids[a:b].tolist() == model.encode_long(("▁" + text.replace(" ", "▁")).encode())
        else:
            assert a == b
    back = [x.decode() for x in model.decode(ids, offsets)]
    assert back == [t.replace("▁", " ") for t in texts]


def test_pieces_across_marks_are_not_split():
    found = SOME + [("a▁b".encode(), 10, -0.1)]
    model = small(found)
    assert not model.split
    ids, _ = model.encode(pa.array(["a b"]))
    assert ids.tolist() == [4, 10]


def test_tables(spark):
    rows = [(1, "hello  world\n", "x"), (2, None, None), (3, "", "y"), (None, "日本 ☃", "z"), (1, "hello  world\n", "x"), (4, "ab" * 3000, ""), (5, "▁", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {(r.doc_id, r.decoded): r for r in pieces.encode_and_decode(df).collect()}
    assert got[(2, "")].n_tokens == 0 and got[(3, "")].round_trip and got[(None, "日本 ☃")].round_trip
    assert got[(4, "ab" * 3000)].round_trip and not got[(5, " ")].round_trip
    encoded = pieces.encode(df)
    sums = {r.doc_id: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in encoded.collect()}
    assert sums[1] == got[(1, "hello  world\n")].ids_crc32
    assert sorted((r.doc_id, r.text) for r in pieces.decode(encoded).where("doc_id < 4").collect()) == [(1, "hello  world\n"), (1, "hello  world\n"), (2, ""), (3, "")]
    assert pieces.encode_and_decode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_table_round_trip(spark):
    got = QUERIES["op5_pieces"](spark, FOLDER).collect()
    assert len(got) == table(spark, FOLDER, "documents").count() and all(r.round_trip for r in got)


@pytest.mark.parametrize("text", ["It is, on the whole, well.", "Über die Brücke", "x=1; y=[2]"])
def test_library_never_beats_it(text):
    import sentencepiece

    model = pieces.load(pieces.default_model())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    ids, _ = model.encode(pa.array([text]))
    total = lambda x: sum(library.get_score(int(i)) for i in x)
    assert total(ids) >= total(library.encode(text)) and library.decode([int(i) for i in ids]) == text
