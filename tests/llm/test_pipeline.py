import hashlib
from collections import defaultdict

import corpus_pipeline
from dosefold.llm import contamination, toxicity
from dosefold.llm.queries import table
from tests.llm.test_minhash import brute as near_brute

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage's rows, and the whole run, on a whole small folder."""
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, table(spark, FOLDER, "labels")).collect()}
    left = [i for i in rows if scores[i] < 0.5]
    groups = defaultdict(list)
    for i in left:
        groups[rows[i].text or ""].append(i)
    left = sorted(max(ids) for ids in groups.values())
    left = [i for i, _, component in near_brute([(i, rows[i].text) for i in left], 5, 80, 100) if i == component]
    items = {r.item_id: [w for w in contamination.bare((r.text or "").encode().split()) if w] for r in table(spark, FOLDER, "benchmark").collect()}
    clean = []
    for i in left:
        text = b" " + b" ".join(w for w in contamination.bare((rows[i].text or "").encode().split()) if w) + b" "
        if not any(b" " + b" ".join(words) + b" " in text for words in items.values()):
            clean.append(i)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(clean)
    assert all(r.decoded_sha256 == hashlib.sha256((rows[i].text or "").encode()).hexdigest() and r.round_trip for i, r in got.items())


def test_stages_keep_columns_and_pass_empty_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "", 0), (2, None, None, "s", 1), (3, "a b", "", "", 3), (3, "a b", "", "", 3)], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, FOLDER).columns == empty.columns and stage(spark, empty, FOLDER).count() == 0
        out = stage(spark, odd, FOLDER)
        assert out.columns == odd.columns and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, FOLDER).count() == 0
