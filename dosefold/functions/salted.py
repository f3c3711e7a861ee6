"""Joins of a large table with few rows per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grown(df: DataFrame) -> DataFrame:
    """`df`, many rows of which came from one by explode, for a join by shuffle.

    Spark takes an explode's size for that of its input and would send such a table
    through the driver to every executor.
    """
    return df.hint("merge")


#: Parts that the rows of one key are dealt to.
SALTS = 64


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """`large` joined with `small` on `on`, the rows of a key spread over SALTS tasks by their columns `spread`.

    For scalars of a patient, or its beams, where one patient may hold most rows of
    `large`: `small` is repeated for every part, so a shuffle of `large` is never
    by the key alone. Catalyst may still broadcast `small`, if it is small enough.
    `how` is inner or left.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    everywhere = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("_part", part).join(everywhere, [*on, "_part"], how).drop("_part")


#: Rows of a block, and the parts that the rows of a key are dealt to on either side of `block_join`.
BLOCK, DEAL = 1024, 16


def block_join(rows: DataFrame, packed: DataFrame, on: list[str], spread: list[str], packed_spread: list[str]) -> tuple[DataFrame, str]:
    """`rows` joined with blocks of `packed` on keys that many rows of both sides share; the caller inlines the blocks' column.

    For a result that grows with the product of the sides: its rows are made in the
    task, from `rows` met with arrays of at most BLOCK rows of `packed`, and never
    shuffled. Rows of a key are dealt by their columns `spread` and
    `packed_spread` to DEAL parts each, and each pair of parts is a key of its own, so
    that no task holds all of a key's rows. The tasks are as many as the session has
    room for, since the bytes that meet there tell nothing of the rows that they make.
    Neither side goes through the driver.
    """
    rest = [c for c in packed.columns if c not in on]
    session = packed.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    part = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(DEAL)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))
    dealt = rows.withColumn("_a", part(spread)).withColumn("_b", every)
    line = Window.partitionBy(*on, "_b").orderBy(*packed_spread)
    numbered = packed.withColumn("_b", part(packed_spread)).withColumn("_block", F.floor((F.row_number().over(line) - 1) / BLOCK))
    blocks = numbered.groupBy(*on, "_b", "_block").agg(F.collect_list(F.struct(*rest)).alias("_rows")).drop("_block").withColumn("_a", every)
    keys = [*on, "_a", "_b"]
    met = dealt.repartition(tasks, *keys).join(blocks.repartition(tasks, *keys).hint("merge"), keys)
    return met.drop("_a", "_b"), "_rows"
