"""License scan by ordered signature rules.

1. A text becomes its words with one space between. The words that are keywords
   of rules choose the rules to try, so most texts meet no pattern at all.
2. A rule's matches are marked in the text by one replacement; the numbers of
   the marked words are the detections.
3. A detection that lies inside one of a rule of equal or higher priority gives
   way to it (of equal ones the earlier rule stays). Detections of a text are
   rows, sorted by start; running maxima of the ends, one for each priority,
   tell what is covered. Base detections always stay.

Only DataFrame functions: no Python workers. What is shuffled are numbers of
words and names of rules; rows of equal doc_id and text are counted first.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.llm.license_rules import MENTION, TAG, Rule, rules

RULES = rules()
PRIORITIES = range(TAG, MENTION + 1)
_RULE = "array<struct<rule:int,label:string,priority:int,weight:double,base:boolean,keywords:array<string>,pattern:string>>"


def _once(value: Column, use) -> Column:
    """`use(value)` with `value` worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(text: Column) -> Column:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z as a-z, each between single spaces; a space if none.

    Letters outside ASCII become lower case too; they stay parts of words, and none of them becomes a word of a base phrase.
    """
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return _once(F.trim(spaced), lambda words: F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" "))))


def _places(text: Column, rule: Column) -> Column:
    """Detections of one rule in a normalised text."""
    pattern = F.concat(F.lit(" ("), rule["pattern"], F.lit(")(?= )"))
    words = F.split(F.regexp_replace(text, pattern, F.lit(" \u0001$1\u0002")), " ")

    def numbers(marked: Column, hit) -> Column:
        return F.filter(F.transform(marked, lambda word, i: F.when(hit(word), i - 1)), lambda i: i.isNotNull())

    def spans(marked: Column) -> Column:
        first, last = numbers(marked, lambda w: F.startswith(w, F.lit("\u0001"))), numbers(marked, lambda w: F.endswith(w, F.lit("\u0002")))
        return F.zip_with(first, last, lambda a, b: F.struct(
            rule["rule"].alias("rule"), rule["label"].alias("label"), rule["priority"].alias("priority"), rule["weight"].alias("weight"),
            rule["base"].alias("base"), a.alias("start"), b.alias("end")))

    return _once(words, spans)


def detections(docs: DataFrame, signatures: list[Rule] = RULES) -> DataFrame:
    """A row for each detection, and one with null rule for each text without: doc_id, digest, copies, n_words, rule, label, priority,
    weight, base, start, end (numbers of the first and last word), kept.

    Rows of equal doc_id and text are one, `copies` of them. `digest` is the
    text's SHA-256. A null text counts as empty; a null doc_id is an id of its
    own. Other columns are ignored; an empty table gives no rows.
    """
    listed = [{"rule": k, "label": r.label, "priority": r.priority, "weight": r.weight, "base": r.base, "keywords": list(r.keywords), "pattern": r.pattern} for k, r in enumerate(signatures)]
    table = F.from_json(F.lit(json.dumps(listed)), _RULE)
    keywords = F.array(*[F.lit(w) for w in sorted({w for r in signatures for w in r.keywords})])
    texts = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), normalised(F.col("text")).alias("norm"))
    gated = texts.select("doc_id", "digest", "norm", F.split("norm", " ").alias("words")).select(
        "doc_id", "digest", "norm", (F.size("words") - 2).cast("long").alias("n_words"), F.array_intersect("words", keywords).alias("found"))
    tried = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], F.col("found")))
    hits = F.flatten(F.transform(tried, lambda r: _places(F.col("norm"), r)))
    found = gated.select("doc_id", "digest", "n_words", F.when(F.size("found") > 0, hits).alias("hits"))
    rows = found.select("doc_id", "digest", "n_words", F.inline_outer("hits"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    before = Window.partitionBy("doc_id", "digest").orderBy("start", F.col("end").desc(), "priority", "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for rank in PRIORITIES:
        reach = F.max(F.when(F.col("priority") <= rank, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") == rank) & F.coalesce(reach >= F.col("end"), F.lit(False)))
    kept = F.when(F.col("rule").isNotNull(), F.col("base") | ~covered)
    return rows.select("doc_id", "digest", "copies", "n_words", "rule", "label", "priority", "weight", "base", "start", "end", kept.alias("kept"))


def license_scan(docs: DataFrame, signatures: list[Rule] = RULES) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The words count base detections alone; `labels` are those of every kept
    detection; `score` is the greatest weight of a kept rule, 0 without one.
    Repeated rows each get their row; a null text has no words.
    """
    base = F.col("base") & F.col("rule").isNotNull()

    def joined(condition: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = detections(docs, signatures).groupBy("doc_id", "digest").agg(
        F.max("copies").alias("copies"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("kept")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("kept"), F.col("weight"))), F.lit(0.0)).alias("score"))
    return found.withColumn("_copy", F.explode(F.expr("sequence(1L, copies)"))).drop("_copy", "copies", "digest")


def oracle_sql(signatures: list[Rule] = RULES) -> str:
    """The scan in SQL. Words have two spaces between, so that neighbouring matches share none."""

    def literal(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()

    listed = ",\n".join(
        "(" + ", ".join([str(k), literal(r.label), str(r.priority), str(r.weight), literal(r.base), "[" + ", ".join(map(literal, r.keywords)) + "]", literal(r.pattern.replace(" ", "  ").replace("  ?", "(?:  )?"))]) + ")"
        for k, r in enumerate(signatures))
    covered = " OR ".join(
        f"(priority = {rank} AND coalesce(max(CASE WHEN priority <= {rank} THEN last END) OVER before >= last, false))" for rank in PRIORITIES)
    return f"""
WITH rules(rule, label, priority, weight, base, keywords, pattern) AS (VALUES {listed}),
numbered AS (SELECT row_number() OVER () AS k, doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g')) AS words FROM documents),
texts AS (SELECT k, doc_id, '  ' || words || '  ' AS norm, CASE WHEN words = '' THEN 0 ELSE len(string_split(words, '  ')) END AS n_words FROM numbered),
gates AS (SELECT rule, unnest(keywords) AS word FROM rules),
gated AS (SELECT DISTINCT k, rule FROM (SELECT k, unnest(list_distinct(string_split(norm, '  '))) AS word FROM texts) JOIN gates USING (word)),
tried AS (SELECT k, norm, rules.* FROM gated JOIN texts USING (k) JOIN rules USING (rule)),
marked AS (SELECT k, rule, label, priority, weight, base,
        string_split(regexp_replace(norm, ' (' || pattern || ') ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g'), '  ') AS parts
    FROM tried WHERE regexp_matches(norm, ' (' || pattern || ') ')),
spans AS (SELECT k, rule, label, priority, weight, base,
        unnest([i - 2 for w, i in parts if starts_with(w, chr(1))]) AS first,
        unnest([i - 2 for w, i in parts if ends_with(w, chr(2))]) AS last
    FROM marked),
judged AS (SELECT *, base OR NOT ({covered}) AS kept FROM spans
    WINDOW before AS (PARTITION BY k ORDER BY first, last DESC, priority, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
folded AS (SELECT k, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
        array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list(label) FILTER (kept))), ',') AS labels, max(weight) FILTER (kept) AS score
    FROM judged GROUP BY k)
SELECT doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM texts LEFT JOIN folded USING (k)
"""


SQL = oracle_sql()
