import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from dosefold.llm.exact_dedup import exact_dedup, exact_identities, exact_kept

SCHEMA = "doc_id long, text string, name string, pos int"
LONG = "abcdefghij" * 700


def rows():
    out = [(1, "one", "x", 1), (2, "one", "y", 2), (3, None, None, None), (4, "", "z", 0), (5, "one ", "x", 1)]
    out += [(6, LONG, "", 1), (7, LONG + "é", "", 1), (8, LONG, "", 1), (9, LONG[:-1] + "k", "", 1), (10, LONG[:1024], "", 1)]
    out += [(11, LONG, "r", 1), (11, LONG, "r", 1), (12, "p", "", 1), (12, "q", "", 1), (None, "nobody", "", 1), (None, "one", "", 1)]
    out += [(20 + i, "copied text", "", i) for i in range(50)]
    return out


def brute(given):
    groups = defaultdict(list)
    for doc_id, text, *_ in given:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [4, 1024])
def test_against_brute_force(spark, block):
    got = exact_dedup(spark.createDataFrame(rows(), SCHEMA), block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_colliding_hashes_do_not_join_texts(spark):
    weak = lambda c: F.octet_length(c).cast("long") % 3
    got = exact_dedup(spark.createDataFrame(rows(), SCHEMA), 16, weak).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows())


def test_names_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    first = exact_identities(df, 64).collect()
    again = exact_identities(df.repartition(5, "name"), 64).collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_empty_table_and_kept_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(df).count() == 0
    kept = exact_kept(spark.createDataFrame(rows(), SCHEMA))
    assert kept.columns == ["doc_id", "text", "name", "pos"]
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([2, 4, 5, 11, 11, 7, 9, 10, 12, 12, None, 69], key=str)
