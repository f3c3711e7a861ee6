"""Masks as row runs.

A mask row is a handful of intervals along x. Growing, shrinking and labelling
work on those intervals: a margin becomes wider or narrower intervals in nearby
rows, merged or counted by a sweep along each row. Work grows with rows, not with
voxels times kernel size, and no window is longer than one grid row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.numeric import literal_structs

ROW = ["iz", "iy"]
MAX_PASS = 8


def to_runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal intervals [x1, x2] per row; duplicate voxels are allowed."""
    line = Window.partitionBy(*keys, *ROW).orderBy("ix")
    return (
        mask.select(*keys, *ROW, "ix").distinct()
        .withColumn("_island", F.col("ix") - F.row_number().over(line))
        .groupBy(*keys, *ROW, "_island")
        .agg(F.min("ix").alias("x1"), F.max("ix").alias("x2"))
        .drop("_island")
    )


def to_voxels(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence("x1", "x2")).alias("ix"), "iy", "iz")


def ball(k: int) -> list[tuple[int, int, int]]:
    """Row offsets and half-widths of k steps with the 18-neighbour kernel."""
    return [
        (dz, dy, min(k, 2 * k - abs(dz) - abs(dy)))
        for dz in range(-k, k + 1)
        for dy in range(-k, k + 1)
        if abs(dz) + abs(dy) <= 2 * k
    ]


def flat(m: int) -> list[tuple[int, int, int]]:
    """An in-plane square of half-width m."""
    return [(0, dy, m) for dy in range(-m, m + 1)]


FACES = [(0, 0, 1), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0)]


def _spread(runs: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    steps = literal_structs(["dz", "dy", "w"], offsets)
    return runs.select("*", F.inline(steps))


def merge_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or touching intervals per row."""
    line = Window.partitionBy(*keys, *ROW).orderBy("x1", "x2")
    reach = F.max("x2").over(line.rowsBetween(Window.unboundedPreceding, -1))
    return (
        runs.withColumn("_new", F.coalesce(F.col("x1") > reach + 1, F.lit(True)).cast("int"))
        .withColumn("_island", F.sum("_new").over(line))
        .groupBy(*keys, *ROW, "_island")
        .agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
        .drop("_island")
    )


def dilate(runs: DataFrame, keys: list[str], offsets, size: tuple[int, int, int]) -> DataFrame:
    nx, ny, nz = size
    moved = (
        _spread(runs, offsets)
        .select(
            *keys, (F.col("iz") + F.col("dz")).alias("iz"), (F.col("iy") + F.col("dy")).alias("iy"),
            F.greatest(F.col("x1") - F.col("w"), F.lit(0)).alias("x1"),
            F.least(F.col("x2") + F.col("w"), F.lit(nx - 1)).alias("x2"),
        )
        .filter(F.col("iz").between(0, nz - 1) & F.col("iy").between(0, ny - 1))
        .distinct()
    )
    return merge_runs(moved, keys)


def erode(runs: DataFrame, keys: list[str], offsets) -> DataFrame:
    """Cells covered by the narrowed interval of every offset row; beyond the grid counts as empty."""
    moved = _spread(runs, offsets).select(
        *keys, (F.col("iz") - F.col("dz")).alias("iz"), (F.col("iy") - F.col("dy")).alias("iy"),
        (F.col("x1") + F.col("w")).alias("x1"), (F.col("x2") - F.col("w")).alias("x2"),
    ).filter("x1 <= x2")
    return covered(moved.withColumn("rows", F.lit(len(offsets))), keys)


def covered(moved: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that as many of the moved runs cover as their column `rows` says."""
    edges = F.array(
        F.struct(F.col("x1").alias("x"), F.lit(1).alias("step")),
        F.struct((F.col("x2") + 1).alias("x"), F.lit(-1).alias("step")),
    )
    line = Window.partitionBy(*keys, *ROW).orderBy("x")
    return (
        moved.select(*keys, *ROW, "rows", F.inline(edges))
        .groupBy(*keys, *ROW, "x").agg(F.sum("step").alias("step"), F.max("rows").alias("rows"))
        .select(*keys, *ROW, "rows", F.col("x").alias("x1"), F.sum("step").over(line).alias("cover"),
                (F.lead("x").over(line) - 1).alias("x2"))
        .filter("cover = rows")
        .drop("cover", "rows")
    )


def passes(k: int) -> list[int]:
    """Split k kernel steps into bounded passes; sums of steps are equal to one large step."""
    return [MAX_PASS] * (k // MAX_PASS) + ([k % MAX_PASS] if k % MAX_PASS else [])

