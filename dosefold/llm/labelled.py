"""Labelled training rows: a bounded sample that never holds a held-out row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no rest by 5; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int) -> DataFrame:
    """(order, label, text) of about `sample_rows` labelled rows that are not held out, an even draw by a hash of doc_id.

    Rows without id or label don't count. Only drawn documents are joined, so
    no other text is shuffled; of contradicting labels the larger counts.
    """
    draw = F.xxhash64("doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    total = known.count()
    share = min(1.0, sample_rows / max(total, 1))
    # the hash is even over [-2^63, 2^63)
    drawn = (draw / 2.0**63 + 1.0) / 2.0 <= share
    texts = docs.where(drawn & F.col("doc_id").isNotNull()).select("doc_id", "text")
    return texts.join(known.where(drawn), "doc_id").select(draw.alias("order"), F.col("label").cast("int"), "text")
