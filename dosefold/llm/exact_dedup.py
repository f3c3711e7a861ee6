"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes. Distinct blocks are
sorted into integer names; then the names of adjacent pairs are named again,
and so on, until one name stands for the whole text. Two texts have the same
(level, name) exactly if they are equal: names are given to contents, never to
hashes alone. A 64-bit hash only carries a block's name back to its document; where
two contents share a hash, the contents themselves are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.llm.common import numbered, stored


def _blocks(docs: DataFrame, size: int, hashed) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    count = F.greatest(F.ceil(F.octet_length("data") / size), F.lit(1)).cast("int")
    return (
        docs.select("doc_id", data.alias("data"))
        .select("doc_id", "data", F.xxhash64("data").alias("tag"), F.sha2("data", 256).alias("sha"), count.alias("width"))
        .select("doc_id", "tag", "data", "sha", "width", F.explode(F.expr("sequence(0, width - 1)")).alias("pos"))
        .withColumn("block", F.expr(f"substring(data, pos * {size} + 1, {size})"))
        .select("doc_id", "tag", "pos", "width", F.when(F.col("pos") == 0, F.unhex("sha")).alias("sha"),
                hashed(F.col("block")).alias("h"), "block")
    )


def _block_names(blocks: DataFrame) -> DataFrame:
    """(h, block, name); block only where several contents share h."""
    # copies of a block meet on the map side; a set has one content unless hashes collide
    contents = blocks.groupBy("h").agg(F.sort_array(F.collect_set("block")).alias("contents"))
    shared = F.size("contents") > 1
    each = contents.select("h", F.posexplode(F.when(shared, F.col("contents")).otherwise(F.array(F.lit(None).cast("binary")))))
    return stored(numbered(each.toDF("h", "place", "block"), ["h", "place"], "name").select("h", "block", "name"), "block-names")


def _level_zero(docs: DataFrame, size: int, hashed) -> DataFrame:
    blocks = _blocks(docs, size, hashed)
    names = _block_names(blocks)
    rows = blocks.drop("block")
    clear = names.where("block is null").select("h", "name")
    named = rows.join(clear, "h")
    unclear = names.where("block is not null")
    if not unclear.isEmpty():
        named = named.unionByName(blocks.join(unclear, ["h", "block"]).drop("block"))
    return named.select("doc_id", "tag", "pos", "width", "sha", "name", F.lit(1).cast("long").alias("copies"))


def _pair_up(rows: DataFrame) -> DataFrame:
    left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
    return rows.groupBy("doc_id", "tag", (F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.ceil(F.max("width") / 2).cast("int").alias("width"),
        F.max("sha").alias("sha"),
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("b"),
        F.sum(F.when(left, F.col("copies"))).alias("copies"),
    )


def exact_identities(docs: DataFrame, block_bytes: int = 1024, hashed=F.xxhash64) -> DataFrame:
    """(doc_id, tag, sha, copies, level, name): equal (level, name) exactly for equal texts.

    `tag` keeps rows apart that share a doc_id; wholly equal rows of several
    blocks come as one row with their number in `copies`.
    """
    rows = stored(_level_zero(docs.select("doc_id", "text"), block_bytes, hashed), "named")
    done, level = [], 0
    while True:
        ended = rows.where("width = 1").select("doc_id", "tag", "sha", "copies", F.lit(level).alias("level"), "name")
        done.append(ended)
        pending = rows.where("width > 1")
        if pending.isEmpty():
            break
        level += 1
        pairs = stored(_pair_up(pending), "pairs")
        names = numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name")
        rows = stored(pairs.join(names, ["a", "b"]).drop("a", "b"), "named")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = 1024, hashed=F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays. A null text counts as empty; a
    null doc_id ranks lowest, and stays only where all of a group are null.
    Rows that repeat a doc_id each get their row and count in group_size.
    Other columns of `docs` are ignored; an empty table gives no rows.
    """
    found = exact_identities(docs, block_bytes, hashed)
    groups = found.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (
        found.join(groups, ["level", "name"])
        .withColumn("_copy", F.explode(F.expr("sequence(1L, copies)")))
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                F.lower(F.hex("sha")).alias("text_sha256"))
    )


def exact_kept(docs: DataFrame, block_bytes: int = 1024) -> DataFrame:
    """The rows of `docs` that stay: of equal texts, those with the largest doc_id (all rows that share it)."""
    decided = exact_dedup(docs, block_bytes).where("kept").select(F.col("doc_id").alias("_id"), "text_sha256").distinct()
    tagged = docs.withColumn("_sha", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    same: Column = tagged["doc_id"].eqNullSafe(decided["_id"]) & (tagged["_sha"] == decided["text_sha256"])
    return tagged.join(decided, same, "left_semi").drop("_sha")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
