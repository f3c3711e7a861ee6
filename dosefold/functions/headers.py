"""A grid header per patient.

A header table has patient_id and the structs origin, spacing (x, y, z as
doubles, mm) and size (x, y, z as integers). No two patients need share a grid:
the header is a column of the patient's rows, joined where a formula needs it. It
has one row per patient, so Catalyst broadcasts it below the session's threshold;
beyond, the rows of a patient are spread over many tasks. Operators of
`dosefold.operators` that take origin, spacing or size also take such a table
as `headers`, in their stead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.functions import runs as rl
from dosefold.functions.salted import salted_join

AXES = ("x", "y", "z")
CELL = ["patient_id", "ix", "iy", "iz"]


def with_header(df: DataFrame, headers: DataFrame) -> DataFrame:
    """`df` with the columns origin, spacing and size of each row's patient; a patient without a header is dropped."""
    return _headed(df, headers, ["origin", "spacing", "size"])


def _headed(df: DataFrame, headers: DataFrame, parts: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != "patient_id"]
    return salted_join(df, headers.select("patient_id", *parts), ["patient_id"], rest or ["patient_id"])


def on_grid(df: DataFrame, headers: DataFrame | None, **parts):
    """`df` and the x, y, z of each named part: what is given for all patients, or with `headers` each row's own columns."""
    if headers is None:
        return (df, *parts.values())
    missing = [p for p in parts if p not in df.columns]  # what the rows carry already needs no join
    return (_headed(df, headers, missing) if missing else df, *(axis(p) for p in parts))


def axis(part: str) -> tuple[Column, ...]:
    """The x, y and z of origin, spacing or size."""
    return tuple(F.col(part)[a] for a in AXES)


def voxel_volume_cc() -> Column:
    x, y, z = axis("spacing")
    return x * y * z / 1000


def margin_columns(margin_mm: float) -> tuple[Column, Column]:
    """Kernel steps in 3-D and the half-width of the in-plane steps that follow, clipped to the grid (half-even rounding)."""
    sx, _, sz = axis("spacing")
    nx, nz = (F.greatest(F.rint(margin_mm / s), F.lit(1.0)) for s in (sx, sz))
    times = F.greatest(F.floor(nx / nz), F.lit(1))
    steps = F.greatest(F.rint(nx / times), F.lit(1.0)).cast("int")
    longest = F.greatest(*axis("size")).cast("int")
    return F.least(steps, longest), F.least(((times - 1) * steps).cast("int"), longest)


def _stepped(runs: DataFrame, headers: DataFrame, margin_mm: float, kind: int, at: int) -> DataFrame:
    """Runs with the steps `k` of this pass, at most MAX_PASS, and what is left of the patient's steps."""
    whole = margin_columns(margin_mm)[kind]
    return with_header(runs, headers).withColumn("k", F.greatest(F.least(whole - at, F.lit(rl.MAX_PASS)), F.lit(0)))


def _spread(runs: DataFrame, flat: bool) -> DataFrame:
    k = F.col("k")
    every = runs.select("*", F.explode(F.sequence(-k, k)).alias("dy"))
    if flat:
        return every.withColumn("dz", F.lit(0)).withColumn("w", k)
    every = every.select("*", F.explode(F.sequence(-k, k)).alias("dz"))
    return every.withColumn("w", F.least(k, 2 * k - F.abs("dz") - F.abs("dy")))


def _passes(headers: DataFrame, margin_mm: float, kind: int) -> range:
    """Starts of the passes that the patient with most steps needs; grids are bounded, so are the passes."""
    most = headers.agg(F.max(margin_columns(margin_mm)[kind])).first()[0] or 0
    return range(0, math.ceil(most / rl.MAX_PASS) * rl.MAX_PASS, rl.MAX_PASS)


def expand(mask: DataFrame, margin_mm: float, headers: DataFrame) -> DataFrame:
    """Grow a mask by a margin inside each patient's grid; margin 0 keeps it."""
    if margin_mm < 0:
        raise ValueError(f"Invalid margin {margin_mm}")
    if margin_mm == 0:
        return mask.select(*CELL)
    keys, grown = ["patient_id"], rl.to_runs(mask, ["patient_id"])
    nx, ny, nz = axis("size")
    for kind in (0, 1):
        for at in _passes(headers, margin_mm, kind):
            moved = _spread(_stepped(grown, headers, margin_mm, kind, at), kind == 1).select(
                *keys, (F.col("iz") + F.col("dz")).alias("iz"), (F.col("iy") + F.col("dy")).alias("iy"),
                F.greatest(F.col("x1") - F.col("w"), F.lit(0)).alias("x1"), F.least(F.col("x2") + F.col("w"), nx - 1).alias("x2"),
                ny.alias("ny"), nz.alias("nz"),
            ).filter("iz >= 0 AND iz < nz AND iy >= 0 AND iy < ny").drop("ny", "nz")
            grown = rl.merge_runs(moved, keys)
    return rl.to_voxels(grown, keys).select(*CELL)


def shrink(mask: DataFrame, margin_mm: float, headers: DataFrame) -> DataFrame:
    """Erode a mask by the same steps; cells beyond the grid count as empty."""
    keys, left = ["patient_id"], rl.to_runs(mask, ["patient_id"])
    for kind in (0, 1):
        for at in _passes(headers, margin_mm, kind):
            rows = F.when(F.lit(kind == 1), 2 * F.col("k") + 1).otherwise((2 * F.col("k") + 1) * (2 * F.col("k") + 1))
            moved = _spread(_stepped(left, headers, margin_mm, kind, at), kind == 1).select(
                *keys, (F.col("iz") - F.col("dz")).alias("iz"), (F.col("iy") - F.col("dy")).alias("iy"),
                (F.col("x1") + F.col("w")).alias("x1"), (F.col("x2") - F.col("w")).alias("x2"), rows.alias("rows"),
            ).filter("x1 <= x2")
            left = rl.covered(moved, keys)
    return rl.to_voxels(left, keys).select(*CELL)


def structure_volume(structures: DataFrame, ct: DataFrame, headers: DataFrame) -> DataFrame:
    """Volume in cc by each patient's spacing, and fraction inside the calculation box; `ct` holds voxel_id, NULL outside the box."""
    counts = (
        structures.select("structure", *CELL).join(ct.select(*CELL, "voxel_id"), CELL, "left")
        .groupBy("patient_id", "structure").agg(F.count(F.lit(1)).alias("n"), F.count("voxel_id").alias("inside"))
    )
    return with_header(counts, headers).select(
        "patient_id", "structure", (F.col("n") * voxel_volume_cc()).alias("volume_cc"), (F.col("inside") / F.col("n")).alias("frac_in_box")
    )


def structure_opt_voxels(structures: DataFrame, ct: DataFrame, headers: DataFrame, include_zero: bool = False) -> DataFrame:
    """Dose voxels of each structure weighed by their CT cells in cc of each patient's grid; voxel 0 only on request."""
    mapped = ct.filter(F.col("voxel_id").isNotNull())
    if not include_zero:
        mapped = mapped.filter("voxel_id > 0")
    counts = structures.select("structure", *CELL).join(mapped.select(*CELL, "voxel_id"), CELL).groupBy("patient_id", "structure", "voxel_id").agg(
        F.count(F.lit(1)).alias("n"))
    return with_header(counts, headers).select("patient_id", "structure", "voxel_id", (F.col("n") * voxel_volume_cc()).alias("volume_cc"))


def voxel_centers(ct: DataFrame, headers: DataFrame) -> DataFrame:
    """Centre of each dose voxel in its patient's frame: middle of its smallest and largest CT index per axis, in mm."""
    ends = ct.filter(F.col("voxel_id").isNotNull()).groupBy("patient_id", "voxel_id").agg(
        *[((F.min(f"i{a}") + F.max(f"i{a}")) / 2).alias(f"mid_{a}") for a in AXES]
    )
    return with_header(ends, headers).select(
        "patient_id", "voxel_id", *[(F.col(f"mid_{a}") * s + o).alias(f"{a}_mm") for a, o, s in zip(AXES, axis("origin"), axis("spacing"))]
    )


def crop_box(grid: DataFrame, boxes: DataFrame, headers: DataFrame) -> DataFrame:
    """Cells between each patient's two points (structs start_mm and end_mm); the last slice belongs to the box, the last row and column do not."""
    at = with_header(grid.join(boxes, "patient_id"), headers)
    low, high = (
        [F.floor((F.col(end)[a] - o) / s + 0.5) for a, o, s in zip(AXES, axis("origin"), axis("spacing"))] for end in ("start_mm", "end_mm")
    )
    ix, iy, iz = (F.col(f"i{a}") for a in AXES)
    inside = iz.between(low[2], high[2]) & (iy >= low[1]) & (iy < high[1]) & (ix >= low[0]) & (ix < high[0])
    return at.filter(inside).select(*grid.columns)
