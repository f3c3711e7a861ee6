import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from dosefold.llm import contamination
from dosefold.llm.queries import QUERIES, table

DOCS = "doc_id long, text string, item_id string, _items int"
ITEM = "one two three four five. Six seven eight nine ten! Eleven twelve thirteen fourteen fifteen"


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is defined: search all places again after each mark."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, d)
        if best is None:
            return out
        n, i, d = best
        out.append(best)
        free_i[i : i + n], free_d[d : d + n] = [False] * n, [False] * n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.lists(st.integers(0, 3), max_size=14), st.integers(2, 5))
def test_tiles_against_definition(doc, item, least):
    got = contamination.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), least)
    want = plain_tiles(doc, item, least)
    assert sorted(t[0] for t in got) == sorted(t[0] for t in want)
    assert got == want


def rows():
    return [
        (1, "before " + ITEM + " after", "", 1),
        (2, "Eleven twelve thirteen fourteen fifteen and SIX seven, eight nine ten -- one two three four five", None, 1),
        (3, "one two three four five only", "", None), (4, None, "", 1), (5, "", "", 1), (6, "one two", "", 1),
        (None, ITEM, "", 1), (7, ITEM, "", 1), (7, ITEM, "", 1), (8, "a a a a a a a a a", "", 1), (9, "word " * 20000 + ITEM, "", 1),
    ]


def test_documents(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    items = spark.createDataFrame([(10, ITEM, 1), (11, "a a a a a a", 2), (12, "one two", 3), (13, None, 4), (None, ITEM, 5), (14, "", 6)], "item_id long, text string, doc_id int")
    want = {1: [10], 2: [10], 3: [], 4: [], 5: [], 6: [], None: [10], 7: [10], 8: [11], 9: [10]}
    for words in (2_000_000, 8):  # one block, and several
        got = contamination.decontaminate(docs, items, block_words=words).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in rows()), key=str)
        assert all(r.item_ids == want[r.doc_id] and r.contaminated == bool(want[r.doc_id]) for r in got)
        assert {round(r.coverage, 3) for r in got if r.doc_id == 3} == {0.333}
        kept = contamination.uncontaminated(docs, items, block_words=words)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in contamination.decontaminate(docs, none).collect())
    assert contamination.decontaminate(spark.createDataFrame([], DOCS), items).count() == 0


def test_whole_table_against_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    normal = lambda t: " " + " ".join(w.decode() for w in contamination.bare((t or "").encode().split()) if w) + " "
    items = {r.item_id: normal(r.text) for r in table(spark, folder, "benchmark").collect()}
    got = {r.doc_id: r for r in QUERIES["op9_decontamination"](spark, folder).collect()}
    for r in table(spark, folder, "documents").collect():
        whole = [i for i, t in items.items() if t in normal(r.text)]
        assert set(whole) <= set(got[r.doc_id].item_ids)
    assert any(r.contaminated for r in got.values())
