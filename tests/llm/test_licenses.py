import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dosefold.llm import licenses
from dosefold.llm.license_rules import MENTION, NAME, Rule, rules

SCHEMA = "doc_id long, text string, label string, rule int"
RULES = rules()


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_scan(text, signatures):
    """Detections one by one, each held against all others."""
    words = words_of(text)
    line = " " + " ".join(words) + " "
    found = []
    for k, rule in enumerate(signatures):
        if set(rule.keywords) & set(words):
            for m in re.finditer(f" ({rule.pattern})(?= )", line):
                start = line[: m.start() + 1].count(" ") - 1
                found.append((start, start + m[1].count(" "), rule.priority, k))
    kept = [
        a for a in found
        if signatures[a[3]].base
        or not any(
            b[0] <= a[0] and b[1] >= a[1] and b[2] <= a[2] and ((b[1] - b[0] > a[1] - a[0]) or (b[2], b[3]) < (a[2], a[3]))
            for b in found if b != a)
    ]
    base = [a for a in found if signatures[a[3]].base]

    def labels(some):
        return ",".join(sorted({signatures[a[3]].label for a in some}))

    starts = [a[0] for a in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), labels(base), labels(kept), max((signatures[a[3]].weight for a in kept), default=0.0))


TEXTS = [
    None, "", " \n", "plain words only", "Released under the MIT License.", "under the MIT license under the mit license, UNDER THE MIT LICENSE",
    "Licensed under the Apache License, Version 2.0.", "apache license version 2 apache license version 2", "CC BY-NC 4.0 and cc-by-nc-sa 4.0; CC BY 3.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "GPLv3, gpl 3, GNU General Public License, version 2 or (at your option) any later version",
    "GNU Lesser General Public License v2.1", "Permission is hereby granted, free of charge, to any person obtaining a copy of this",
    "This is free and unencumbered software released into the public domain.", "Copyright (c) 2019 All rights reserved. see the LICENSE file",
    "released under some odd old license", "transmit licenses mit der Lizenz", "ünder the mit license é apacheé license version 2", "under the mİt license",
    "Neither the name of the Example Group nor the names of its contributors may be used to endorse or promote", "under the\x00mit\x1flicense",
    "creative commons attribution non-commercial share alike license 4.0", "mit " * 3000 + "under the mit license " * 500, "distributed under the boost software license version 1.0",
    "Mozilla Public License 2.0 or EPL-1.0; 3-clause BSD", "https://opensource.org/licenses/MIT https://spdx.org/licenses/Apache-2.0",
]


def test_hundreds_of_rules():
    assert len(RULES) > 300 and len({r.name for r in RULES}) == len(RULES)
    assert [r.base for r in RULES[:3]] == [True] * 3 and not any(r.base for r in RULES[3:])


@settings(max_examples=600, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.data())
def test_keywords_never_hide_a_match(data):
    rule = data.draw(st.sampled_from(RULES))
    match = data.draw(st.from_regex(rule.pattern, fullmatch=True, alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0123456789 ")))
    assert set(match.split()) & set(rule.keywords), (rule.name, match)


def test_texts_against_plain_version(spark):
    given_rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "", 2), (4, TEXTS[4], None, None), (4, TEXTS[4], "", 3), (4, TEXTS[6], "", 3)]
    got = licenses.license_scan(spark.createDataFrame(given_rows, SCHEMA).repartition(4)).collect()
    want = [(d, *plain_scan(t, RULES)) for d, t, *_ in given_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    named = {r.doc_id: r.labels for r in got}
    assert named[9] == "gpl-2.0-or-later" and named[11] == "lgpl-2.1" and named[25] == "apache-2.0,mit"


def test_same_rows_from_sql():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    rows = [(i, t) for i, t in enumerate(TEXTS) if not t or "\x00" not in t]
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = con.execute(licenses.SQL).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(((d, *plain_scan(t, RULES)) for d, t in rows), key=str)


def test_suppression_by_priority_and_containment(spark):
    own = [
        Rule("long-low", "a", MENTION, 0.3, ("k",), "k(?: [^ ]+){3}"), Rule("short-high", "b", NAME, 0.6, ("k",), "k x"), Rule("same", "c", NAME, 0.6, ("k",), "k x"),
        Rule("inside", "d", MENTION, 0.3, ("k",), "x y"), Rule("across", "e", NAME, 0.5, ("k",), "y z z"), Rule("base", "f", MENTION, 0.1, ("k",), "x", True),
    ]
    given_rows = [(0, "k x y z z z", "", 0), (1, "k k x y z", "", 0), (2, "x y z z", "", 0), (3, "k x " * 300, "", 0)]
    got = {r.doc_id: tuple(r)[1:] for r in licenses.license_scan(spark.createDataFrame(given_rows, SCHEMA), own).collect()}
    assert got == {d: plain_scan(t, own) for d, t, *_ in given_rows}
    assert got[0][5] == "a,b,e,f" and got[2][4:] == ("", "", 0.0)


def test_empty_table(spark):
    found = licenses.license_scan(spark.createDataFrame([], SCHEMA))
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"] and found.count() == 0


@pytest.mark.parametrize("phrase,label", [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")])
def test_base_phrases_stay(spark, phrase, label):
    text = f"SPDX-License-Identifier: {phrase} {phrase}"
    row = licenses.license_scan(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    assert row.base_labels == label and label in row.labels.split(",") and row.n_base == 2 and row.first_word == 3
