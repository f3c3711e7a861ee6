"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosefold.llm import (
    archives, contamination, exact_dedup, licenses, line_dedup, minhash, periodic_runs, pieces, quality, ranked_search, repeats, token_files, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_exact_dedup", exact_dedup.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


@register("op10_archives", archives.SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive_round_trip(table(spark, folder, "pages"))


@register("op6_quality")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@register("op5_pieces")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = pieces.encode_and_decode(table(spark, folder, "documents"))
    return found.select("doc_id", "n_tokens", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), "round_trip")


@register("op9_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op3_token_files")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_round_trip(table(spark, folder, "documents"))


@register("op2_minhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_dedup(table(spark, folder, "documents"), words=3, num=85, den=100)


@register("op7_repeats")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.repeats(table(spark, folder, "documents"))


@register("op4_line_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents"))


@register("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    looped = periodic_runs.with_planted_loops(table(spark, folder, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(looped))


@register("op12_license_scan", licenses.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_scan(table(spark, folder, "documents"))


@register("op13_ranked_search", ranked_search.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
