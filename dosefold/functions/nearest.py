"""Exact nearest-cell search on a regular grid, one axis at a time.

The squared distance separates by axis: first the nearest site in each row, then
the best row of each column, then the best slice of each line. A row is read by
window functions; columns and lines by the lower envelope of the parabolas that
their cells stand for, at a cost linear in cells. Every step gathers at most one
grid line, and no query cell meets all sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from dosefold.functions.envelope import along_lines

NEAR = ArrayType(StructType([StructField("h", DoubleType()), StructField("id", LongType())]))
STEPS = ("rx", "ry", "rz")


def _enveloped(lines: DataFrame) -> DataFrame:
    """Lines (column `line`, places `low` .. `high`, `step`) with `near`, the best site of each place, in their stead."""
    rest = [f for f in lines.schema.fields if f.name not in ("line", "low", "high", "step")]
    return lines.mapInArrow(along_lines, StructType([*rest, StructField("near", NEAR)]))


def nearest_site(query: DataFrame, sites: DataFrame, spacing: tuple[float, float, float] | DataFrame, keys: list[str]) -> DataFrame:
    """Add `site_id` and `dist2` of the nearest site to each query cell; ties take the smaller id.

    Both tables have `keys`, ix, iy, iz; sites have `site_id`. `spacing` is one
    for all groups, or a table of the keys and the struct spacing (x, y, z): each
    group's own. Groups without a site (or without a spacing) give NULL.
    """
    cells = sites.groupBy(*keys, "iz", "iy", "ix").agg(F.min("site_id").alias("site_id"))
    box = query.groupBy(*keys).agg(
        F.min("ix").alias("x1"), F.max("ix").alias("x2"), F.min("iy").alias("y1"), F.max("iy").alias("y2"),
        F.min("iz").alias("z1"), F.max("iz").alias("z2"),
    )
    if isinstance(spacing, DataFrame):
        steps = spacing.select(*keys, *[F.col("spacing")[a].cast("double").alias(r) for a, r in zip("xyz", STEPS)])
        box = box.join(steps, keys)
    else:
        box = box.select("*", *[F.lit(float(s)).alias(r) for s, r in zip(spacing, STEPS)])
    targets = cells.select(*keys, "iz", "iy").distinct().join(box, keys).select(
        *keys, "iz", "iy", F.explode(F.sequence("x1", "x2")).alias("ix"), F.lit(None).cast("long").alias("site_id"), "rx"
    )
    line = Window.partitionBy(*keys, "iz", "iy").orderBy("ix", F.col("site_id").isNull())
    site = F.when(F.col("site_id").isNotNull(), F.struct("ix", "site_id"))
    seen = cells.withColumn("rx", F.lit(None).cast("double")).unionByName(targets).select(
        *keys, "iz", "iy", "ix", "site_id", "rx",
        F.last(site, True).over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("left"),
        F.first(site, True).over(line.rowsBetween(0, Window.unboundedFollowing)).alias("right"),
    ).filter("site_id IS NULL")

    def along_x(side):
        gap = (F.col("ix") - F.col(f"{side}.ix")) * F.col("rx")
        return F.when(F.col(side).isNotNull(), F.struct((gap * gap).alias("h"), F.col(f"{side}.site_id").alias("id")))

    def gathered(at):
        return F.collect_list(F.struct(F.col(at).cast("long").alias("at"), F.col("best.h").alias("h"), F.col("best.id").alias("id"))).alias("line")

    rows = seen.select(*keys, "iz", "iy", "ix", F.least(along_x("left"), along_x("right")).alias("best"))
    columns = rows.groupBy(*keys, "iz", "ix").agg(gathered("iy")).join(box, keys).select(
        *keys, "iz", "ix", "line", F.col("y1").cast("long").alias("low"), F.col("y2").cast("long").alias("high"), F.col("ry").alias("step"))
    planes = _enveloped(columns.withColumn("y1", F.col("low"))).select(*keys, "iz", "ix", "y1", F.posexplode("near").alias("_at", "best")).select(
        *keys, "iz", "ix", (F.col("y1") + F.col("_at")).alias("iy"), "best")
    lines = planes.groupBy(*keys, "ix", "iy").agg(gathered("iz")).join(box, keys).select(
        *keys, "ix", "iy", "line", F.col("z1").cast("long").alias("low"), F.col("z2").cast("long").alias("high"), F.col("rz").alias("step"))
    found = query.join(_enveloped(lines.withColumn("_z1", F.col("low"))), [*keys, "ix", "iy"], "left")
    best = F.get("near", (F.col("iz") - F.col("_z1")).cast("int"))
    return found.withColumn("site_id", best["id"]).withColumn("dist2", best["h"]).drop("near", "_z1")
