"""A corpus pipeline of the operators in dosefold.llm.

STAGES are (name, function) pairs. Each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read again as the next one's
docs. run() applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosefold.llm import contamination, exact_dedup, minhash, pieces, toxicity
from dosefold.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the given documents and labels, calls toxic go."""
    return toxicity.clean_documents(docs, _table(spark, sf_dir, "labels"))


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.exact_kept(docs)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 on five-word shingles the smallest doc_id stays."""
    return minhash.near_kept(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item to 80 % go."""
    return contamination.uncontaminated(docs, _table(spark, sf_dir, "benchmark"))


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip of what is left."""
    found = pieces.encode_and_decode(docs)
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", copies_out),
    ("near_dedup", near_copies_out),
    ("decontamination", contaminated_out),
    ("pieces", to_pieces),
]

#: A learnt classifier, near copies and an encoder can't be expressed in SQL; tests/llm/test_pipeline.py tests run() by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Empty tables pass through all stages and give no rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
