"""CT and dose grids: maps, slices, crops and resampling."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.headers import on_grid
from dosefold.functions.numeric import clamp, literal_structs, scan_code
from dosefold.functions.salted import grown, salted_join


CELL = ["patient_id", "ix", "iy", "iz"]


def downsample_map(ct: DataFrame, block_xyz: tuple[int, int, int], size_xyz: tuple[int, int, int] | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Group CT cells in blocks and weigh member dose voxels by their cell share.

    Incomplete blocks at the far ends are dropped; used blocks are numbered in
    z, y, x order. The numbering ranks blocks slice by slice and shifts by the
    slices before, so it stays parallel inside one large patient.
    """
    bx, by, bz = block_xyz
    mapped, size_xyz = on_grid(ct.filter(F.col("voxel_id").isNotNull()).select(*CELL, "voxel_id"), headers, size=size_xyz)
    nx, ny, nz = (size - size % block for size, block in zip(size_xyz, block_xyz))
    cells = mapped.filter(
        (F.col("ix") < nx) & (F.col("iy") < ny) & (F.col("iz") < nz)
    ).select(
        "patient_id", "voxel_id", F.floor(F.col("iz") / bz).alias("kz"), F.floor(F.col("iy") / by).alias("ky"),
        F.floor(F.col("ix") / bx).alias("kx"),
    )
    block = ["patient_id", "kz", "ky", "kx"]
    counts = cells.groupBy(*block, "voxel_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*block).agg(F.sum("n").alias("total"))
    in_slice = Window.partitionBy("patient_id", "kz").orderBy("ky", "kx")
    slices = totals.groupBy("patient_id", "kz").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("patient_id").orderBy("kz").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("patient_id", "kz", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    numbered = totals.withColumn("k", F.row_number().over(in_slice) - 1).join(starts, ["patient_id", "kz"])
    return counts.join(numbered, block).select(
        "patient_id", "voxel_id", (F.col("start") + F.col("k")).cast("long").alias("block_id"),
        (F.col("n") / F.col("total")).alias("share"),
    )


def voxel_centers(ct: DataFrame, origin: tuple, resolution: tuple) -> DataFrame:
    """Centre of each dose voxel: middle of its smallest and largest CT index per axis, in mm."""
    axes = list(zip(("ix", "iy", "iz"), ("x_mm", "y_mm", "z_mm"), origin, resolution))
    ends = ct.filter(F.col("voxel_id").isNotNull()).groupBy("patient_id", "voxel_id").agg(
        *[F.min(i).alias(f"{i}_lo") for i, *_ in axes], *[F.max(i).alias(f"{i}_hi") for i, *_ in axes]
    )
    return ends.select(
        "patient_id", "voxel_id",
        *[((F.col(f"{i}_lo") + F.col(f"{i}_hi")) / 2 * r + o).alias(name) for i, name, o, r in axes],
    )


def cell_index(position: Column, origin: float, spacing: float) -> Column:
    """Nearest grid index of a physical coordinate, halves upwards."""
    return F.floor((position - origin) / spacing + 0.5)


def inside(size: tuple[int, int, int]) -> Column:
    nx, ny, nz = size
    return F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1) & F.col("iz").between(0, nz - 1)


def build_voxel_map(
    points: DataFrame, body: DataFrame, origin: tuple | None = None, spacing: tuple | None = None, size: tuple[int, int, int] | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """CT cell to dose point: later points overwrite, gaps inside the bounding box take the nearest mapped cell.

    Points beyond the CT are ignored and cells outside the body stay unmapped.
    """
    from dosefold.functions.nearest import nearest_site

    points, origin, spacing, size = on_grid(points.select("patient_id", "point_id", "x_mm", "y_mm", "z_mm"), headers, origin=origin, spacing=spacing, size=size)
    at = points.withColumns({
        i: cell_index(F.col(p), o, s) for p, i, o, s in zip(("x_mm", "y_mm", "z_mm"), ("ix", "iy", "iz"), origin, spacing)
    }).filter(inside(size))
    mapped = at.groupBy(*CELL).agg(F.max("point_id").alias("site_id"))
    box = mapped.groupBy("patient_id").agg(*[f(c).alias(f"{n}{c}") for c in ("ix", "iy", "iz") for n, f in (("lo_", F.min), ("hi_", F.max))])
    cells = (
        box.withColumn("iz", F.explode(F.sequence("lo_iz", "hi_iz")))
        .withColumn("iy", F.explode(F.sequence("lo_iy", "hi_iy")))
        .withColumn("ix", F.explode(F.sequence("lo_ix", "hi_ix"))).select(*CELL)
    )
    wanted = cells.join(body.select(*CELL), CELL, "left_semi")
    filled = nearest_site(wanted, mapped, (1.0, 1.0, 1.0), ["patient_id"])
    return filled.select(*CELL, F.col("site_id").alias("voxel_id"))


def uniform_voxel_map(
    points: DataFrame, origin: tuple | None = None, spacing: tuple | None = None, dose_spacing: tuple | None = None,
    size: tuple[int, int, int] | None = None, headers: DataFrame | None = None,
) -> DataFrame:
    """Each dose point fills its block of CT cells; later points overwrite. `headers` has dose_spacing too."""
    corner, origin, spacing, dose_spacing, size = on_grid(
        points.select("patient_id", "point_id", "x_mm", "y_mm", "z_mm"), headers, origin=origin, spacing=spacing, dose_spacing=dose_spacing, size=size)
    block = [F.rint(F.lit(d) / s).cast("long") for d, s in zip(dose_spacing, spacing)]
    for p, i, o, s, d in zip(("x_mm", "y_mm", "z_mm"), ("x0", "y0", "z0"), origin, spacing, dose_spacing):
        corner = corner.withColumn(i, cell_index(F.col(p) - d / 2 + s / 2, o, s))
    cells = corner
    for i, name, n in zip(("x0", "y0", "z0"), ("ix", "iy", "iz"), block):
        cells = cells.withColumn(name, F.explode(F.sequence(F.col(i), F.col(i) + n - 1)))
    return cells.filter(inside(size)).groupBy(*CELL).agg(F.max("point_id").alias("voxel_id"))


def dose_to_grid(ct: DataFrame, dose: DataFrame) -> DataFrame:
    """Dose on every CT cell, zero outside the map; for each plan of the patient, if the dose has plan_id."""
    plan = [c for c in ("plan_id",) if c in dose.columns]
    cells = ct.select(*CELL, "voxel_id")
    if plan:
        cells = salted_join(cells, dose.select("patient_id", *plan).distinct(), ["patient_id"], ["ix", "iy", "iz"])
    return cells.join(dose, ["patient_id", *plan, "voxel_id"], "left").select(
        *plan, *CELL, F.coalesce("dose_gy", F.lit(0.0)).alias("dose_gy")
    )


def grid_to_dose(ct: DataFrame, grid: DataFrame, value: str = "dose_gy") -> DataFrame:
    """Dose vector from the grid, for each plan it has; the last cell in z, y, x order gives the value."""
    plan = [c for c in ("plan_id",) if c in grid.columns]
    return ct.filter(F.col("voxel_id").isNotNull()).select(*CELL, "voxel_id").join(grid, CELL).groupBy(
        *plan, "patient_id", "voxel_id").agg(F.max_by(value, scan_code(F.col("iz"), F.col("iy"), F.col("ix"))).alias(value))


def crop_box(grid: DataFrame, start_mm: tuple, end_mm: tuple, origin: tuple, spacing: tuple) -> DataFrame:
    """Cells between two points; the last slice belongs to the box, the last row and column do not."""
    (x0, y0, z0), (x1, y1, z1) = (
        [math.floor((p - o) / s + 0.5) for p, o, s in zip(point, origin, spacing)] for point in (start_mm, end_mm)
    )
    return grid.filter(
        F.col("iz").between(z0, z1) & (F.col("iy") >= y0) & (F.col("iy") < y1) & (F.col("ix") >= x0) & (F.col("ix") < x1)
    )


def slice_window(labels: DataFrame, depth: int, size_xy: tuple[int, int], window: int = 128, half: int = 150) -> DataFrame:
    """A z window of `window` slices around organs with label 3 and above, and the centred in-plane box."""
    organ = F.when(F.col("label") >= 3, F.col("iz"))
    ends = labels.groupBy("patient_id").agg(
        F.coalesce(F.min(organ), F.lit(-1)).alias("low"), F.coalesce(F.max(organ), F.lit(-1)).alias("high")
    )
    low, high = F.col("low"), F.col("high")
    spare = F.lit(window) - (high - low + 1)
    # centred on the organs (the odd slice in front), then moved inside the volume
    start = clamp(low - F.ceil(spare / 2), 0, max(depth - window, 0))
    if depth < window:
        z1, z2 = F.lit(0), F.lit(depth)
    else:
        z1 = F.when(spare <= 0, low).otherwise(start)
        z2 = F.when(spare <= 0, high).otherwise(start + (window - 1))
    cx, cy = size_xy[0] // 2, size_xy[1] // 2
    return ends.select(
        "patient_id", z1.cast("long").alias("z_start"), z2.cast("long").alias("z_end"),
        *[F.lit(v).cast("long").alias(n) for n, v in (("y_start", cy - half), ("y_end", cy + half), ("x_start", cx - half), ("x_end", cx + half))],
    )


CORNERS = [(dx, dy, dz) for dz in (0, 1) for dy in (0, 1) for dx in (0, 1)]


def corner_weights(targets: DataFrame, keys: list[str]) -> DataFrame:
    """The up to eight source cells around each target with non-zero weight."""
    based = targets.withColumn("x0", F.floor("fx")).withColumn("y0", F.floor("fy")).withColumn("z0", F.floor("fz"))
    spread = based.select("*", F.inline(literal_structs(["dx", "dy", "dz"], CORNERS)))
    def part(f, base, d):
        t = F.col(f) - F.col(base)
        return F.when(F.col(d) == 1, t).otherwise(1 - t)
    return grown(spread.select(
        *keys, (F.col("x0") + F.col("dx")).alias("ix"), (F.col("y0") + F.col("dy")).alias("iy"), (F.col("z0") + F.col("dz")).alias("iz"),
        (part("fx", "x0", "dx") * part("fy", "y0", "dy") * part("fz", "z0", "dz")).alias("w"),
    ).filter("w > 0"))


def resample_linear(
    targets: DataFrame, source: DataFrame, keys: list[str], value: str, default: float = 0.0, zero_padding: bool = False
) -> DataFrame:
    """Trilinear value at fractional source indices fx, fy, fz; `default` where a needed cell is missing.

    `keys` identify a target and include patient_id. With `zero_padding` missing
    cells count as zero instead.
    """
    joined = corner_weights(targets, keys).join(source.select(*CELL, F.col(value).alias("_v")), CELL, "left")
    total = F.sum(F.col("w") * F.coalesce("_v", F.lit(0.0)))
    if zero_padding:
        return joined.groupBy(*keys).agg(total.alias(value))
    return joined.groupBy(*keys).agg(F.when(F.count("_v") == F.count(F.lit(1)), total).otherwise(default).alias(value))


def resize_targets(cells: DataFrame, size: tuple[int, int, int] | None, target: tuple[int, int, int], headers: DataFrame | None = None) -> DataFrame:
    """Targets jx, jy, jz of a grid resized by pixel areas, with mirrored source indices at the edges."""
    cells, size = on_grid(cells, headers, size=size)
    for name, n in zip(("jz", "jy", "jx"), reversed(target)):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    for f, j, n, m in zip(("fx", "fy", "fz"), ("jx", "jy", "jz"), size, target):
        at = F.abs((F.col(j) + 0.5) * (n / m) - 0.5)
        cells = cells.withColumn(f, F.when(at > n - 1, 2.0 * (n - 1) - at).otherwise(at))
    return cells if headers is None else cells.drop("size")


def resample_nearest(targets: DataFrame, source: DataFrame, keys: list[str], value: str, default: float = 0.0) -> DataFrame:
    at = targets.select(
        *keys, F.floor(F.col("fx") + 0.5).alias("ix"), F.floor(F.col("fy") + 0.5).alias("iy"), F.floor(F.col("fz") + 0.5).alias("iz")
    )
    return at.join(source.select(*CELL, value), CELL, "left").select(*keys, F.coalesce(value, F.lit(default)).alias(value))


def resample_masked(
    targets: DataFrame, source: DataFrame, keys: list[str], value: str, valid: str,
    default: float = 0.0, eps: float = 1e-6, threshold: float = 1e-3,
) -> DataFrame:
    """Mask-weighted resampling: weighted values over weights where enough valid weight is near."""
    joined = corner_weights(targets, keys).join(source.select(*CELL, F.col(value).alias("_v"), F.col(valid).alias("_m")), CELL, "left")
    full = F.count("_m") == F.count(F.lit(1))
    top = F.when(full, F.sum(F.col("w") * F.col("_v") * F.col("_m"))).otherwise(0.0)
    bottom = F.when(full, F.sum(F.col("w") * F.col("_m"))).otherwise(0.0)
    return joined.groupBy(*keys).agg(top.alias("_top"), bottom.alias("_bottom")).select(
        *keys, F.when(F.col("_bottom") > threshold, F.col("_top") / (F.col("_bottom") + eps)).otherwise(default).alias(value),
        F.col("_bottom").alias("valid_weight"),
    )


def reference_box(
    body: DataFrame, z_center_mm: float, origin: tuple | None, spacing: tuple | None, box_spacing: tuple, box_size: tuple, headers: DataFrame | None = None
) -> DataFrame:
    """Cells of a box centred on the body's mean x and y and a given z, with physical positions."""
    means = body.groupBy("patient_id").agg(F.avg("ix").alias("mx"), F.avg("iy").alias("my"))
    means, origin, spacing = on_grid(means, headers, origin=origin, spacing=spacing)
    centre = means.select(
        "patient_id", (F.col("mx") * spacing[0] + origin[0]).alias("cx"), (F.col("my") * spacing[1] + origin[1]).alias("cy"),
        F.lit(float(z_center_mm)).alias("cz"),
    )
    half = [s * (n - 1) / 2 for s, n in zip(box_spacing, box_size)]
    cells = centre
    for name, n in zip(("jz", "jy", "jx"), reversed(box_size)):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.select(
        "patient_id", *[F.col(j).cast("long").alias(j) for j in ("jx", "jy", "jz")],
        *[(F.col(c) - h + F.col(j) * s).alias(p) for c, h, j, s, p in zip(("cx", "cy", "cz"), half, ("jx", "jy", "jz"), box_spacing, ("x_mm", "y_mm", "z_mm"))],
    )


def fractional_index(targets: DataFrame, origin: tuple | None = None, spacing: tuple | None = None, headers: DataFrame | None = None) -> DataFrame:
    """Add source indices fx, fy, fz of physical positions."""
    targets, origin, spacing = on_grid(targets, headers, origin=origin, spacing=spacing)
    for f, p, o, s in zip(("fx", "fy", "fz"), ("x_mm", "y_mm", "z_mm"), origin, spacing):
        targets = targets.withColumn(f, (F.col(p) - o) / s)
    return targets if headers is None else targets.drop("origin", "spacing")


def paste_back(ct: DataFrame, cropped: DataFrame, start_xyz: tuple[int, int, int], value: str) -> DataFrame:
    """A cropped grid placed in a zero grid at a cell offset."""
    x0, y0, z0 = start_xyz
    moved = cropped.select(
        "patient_id", (F.col("ix") + x0).alias("ix"), (F.col("iy") + y0).alias("iy"), (F.col("iz") + z0).alias("iz"), value
    )
    return ct.select(*CELL).join(moved, CELL, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def axial_slice(
    ct: DataFrame, grid_dose: DataFrame, structures: DataFrame, iz: int, prescription_gy: float, levels: list[float]
) -> DataFrame:
    """One slice: HU, dose inside the body, isodose band and the names of structures through each cell."""
    named = structures.filter(F.col("iz") == iz).groupBy(*CELL).agg(
        F.array_join(F.array_sort(F.collect_set("structure")), ",").alias("structures"),
        F.max((F.col("structure") == "BODY").cast("int")).alias("in_body"),
    )
    cells = ct.filter(F.col("iz") == iz).select(*CELL, "hu").join(
        grid_dose.filter(F.col("iz") == iz).select(*CELL, "plan_id", "dose_gy"), CELL
    ).join(named, CELL, "left")
    shown = F.when(F.col("in_body") == 1, F.col("dose_gy")).otherwise(0.0)
    band = F.lit(None).cast("double")
    for level in sorted(levels):
        band = F.when(shown >= level * prescription_gy, level).otherwise(band)
    return cells.select(*CELL, "plan_id", "hu", shown.alias("dose_gy"), band.alias("level"), F.coalesce("structures", F.lit("")).alias("structures"))


HU_LOW, HU_HIGH = -1000.0, 3071.0
# Calibration knots from HU to relative electron density.
DENSITY_HU = [-3000.0, -1050.0, -1000.0, -900.0, -750.0, -500.0, -250.0, 0.0, 100.0, 350.0, 600.0, 1500.0, 6424.0, 15000.0, 27780.0]
DENSITY_VALUE = [0.000, 0.000, 0.000, 0.098, 0.249, 0.499, 0.750, 1.000, 1.059, 1.208, 1.356, 1.910, 3.790, 8.290, 15.000]
DENSITY_SCALE = 3.79


def hu_normalize(hu: Column) -> Column:
    return (clamp(hu.cast("double"), HU_LOW, HU_HIGH) - HU_LOW) / (HU_HIGH - HU_LOW)


def hu_to_density(hu: Column) -> Column:
    """Piecewise linear density over the knots, scaled and clipped to [0, 1]."""
    x = clamp(hu.cast("double"), DENSITY_HU[0], DENSITY_HU[-1])
    red = F.lit(DENSITY_VALUE[-1])
    spans = list(zip(DENSITY_HU, DENSITY_HU[1:], DENSITY_VALUE, DENSITY_VALUE[1:]))
    for x1, x2, y1, y2 in reversed(spans):
        red = F.when(x <= x2, F.lit(y1) + (x - x1) * ((y2 - y1) / (x2 - x1))).otherwise(red)
    return clamp(red / DENSITY_SCALE, 0.0, 1.0)


def downsample_masked(
    source: DataFrame, mask: DataFrame, value: str, size: tuple[int, int, int] | None, target: tuple[int, int, int], headers: DataFrame | None = None
) -> DataFrame:
    """Coarser grid: linear inside the mask but never below the minimum around the source cell; 0 outside.

    `source` is a complete grid; targets map to source indices end to end.
    """
    cells, size = on_grid(source.select("patient_id").distinct(), headers, size=size)
    for name, n in zip(("jz", "jy", "jx"), reversed(target)):
        cells = cells.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    ratio = [(s - 1) / (t - 1) if t > 1 else 0.0 for s, t in zip(size, target)]
    for f, j, r in zip(("fx", "fy", "fz"), ("jx", "jy", "jz"), ratio):
        cells = cells.withColumn(f, F.col(j) * r)
    keys = ["patient_id", "jx", "jy", "jz"]
    carried = [] if headers is None else ["size"]
    near = cells.select(*keys, *carried, *[F.floor(F.col(f) + 0.5).alias(i) for f, i in zip(("fx", "fy", "fz"), ("ix", "iy", "iz"))])
    used = near.join(mask.select(*CELL), CELL, "left_semi")
    linear = resample_linear(cells.join(grown(used), keys, "left_semi"), source, keys, value)
    around = used
    for d, s, t in zip(("dx", "dy", "dz"), size, target):
        width = F.ceil(F.lit(s) / t)
        around = around.withColumn(d, F.explode(F.sequence(-F.floor(width / 2), width - 1 - F.floor(width / 2))))
    around = around.select(
        *keys, (F.col("ix") + F.col("dx")).alias("ix"), (F.col("iy") + F.col("dy")).alias("iy"), (F.col("iz") + F.col("dz")).alias("iz")
    )
    lows = grown(around).join(source.join(mask.select(*CELL), CELL, "left_semi").select(*CELL, value), CELL).groupBy(*keys).agg(F.min(value).alias("_low"))
    return cells.select(*keys).join(linear, keys, "left").join(lows, keys, "left").select(
        "patient_id", *[F.col(j).cast("long").alias(j) for j in ("jx", "jy", "jz")],
        F.coalesce(F.greatest(value, "_low"), F.lit(0.0)).alias(value),
    )
