"""Influence-matrix operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.numeric import clamp, scan_code
from dosefold.functions.prefix import running_before
from dosefold.functions.salted import salted_join


def dose_from_fluence(
    influence: DataFrame, fluence: DataFrame, voxels: DataFrame | None = None,
    plan_ids: list[str] | None = None, scale: float = 1.0,
) -> DataFrame:
    """d = A x per plan; voxels no entry reaches get zero.

    The zero rows are unioned under the same aggregate instead of a second join,
    so the product needs one shuffle by voxel. The fluence join is left to
    Catalyst: it broadcasts only below the session's size threshold.
    """
    keys = [c for c in ("patient_id", "beamlet_id") if c in fluence.columns]
    parts = influence.join(fluence, keys).select(
        "plan_id", "patient_id", "voxel_id", (F.col("a") * F.col("intensity")).alias("part")
    )
    if voxels is not None:
        if plan_ids is not None:
            zero = voxels.select(
                F.explode(F.array(*[F.lit(p) for p in plan_ids])).alias("plan_id"), "patient_id", "voxel_id"
            )
        else:
            plans = fluence.select("patient_id", "plan_id").distinct()
            zero = salted_join(voxels.select("patient_id", "voxel_id"), plans, ["patient_id"], ["voxel_id"])
        parts = parts.unionByName(zero.withColumn("part", F.lit(0.0)))
    return parts.groupBy("plan_id", "patient_id", "voxel_id").agg((F.sum("part") * scale).alias("dose_gy"))


CELL_MM = 2.5
BEAM = ["beam_id"]


def finest_grid(beamlets: DataFrame, beam: list[str] = BEAM) -> DataFrame:
    """Cells of 2.5 mm each beamlet covers; where beamlets overlap the later one in scan order wins.

    Rows count down from the top edge and columns right from the left edge of the
    beam's beamlets. Cells no beamlet covers have no row.
    """
    left = F.col("x_mm") - F.col("width_mm") / 2
    top = F.col("y_mm") + F.col("height_mm") / 2
    placed = beamlets.withColumn("left", left).withColumn("top", top)
    frame = placed.groupBy(*beam).agg(
        F.min("left").alias("left0"), F.max("top").alias("top0"),
        F.min_by(F.col("left") + F.col("width_mm"), F.struct(-F.col("left"), "beamlet_id")).alias("right0"),
        F.min_by(F.col("top") - F.col("height_mm"), F.struct("top", "beamlet_id")).alias("bottom0"),
    )
    def cells(expr):
        return F.bround(expr / CELL_MM).cast("long")

    start = placed.join(frame, beam).select(
        *beam, "beamlet_id",
        cells(F.col("top0") - F.col("top")).alias("r0"), cells(F.col("left") - F.col("left0")).alias("c0"),
        F.floor(F.col("height_mm") / CELL_MM).alias("nr"), F.floor(F.col("width_mm") / CELL_MM).alias("nc"),
        cells(F.col("top0") - F.col("bottom0")).alias("rows"), cells(F.col("right0") - F.col("left0")).alias("cols"),
    )
    painted = start.withColumn("row", F.explode(F.expr("sequence(r0, r0 + nr - 1)"))).withColumn(
        "col", F.explode(F.expr("sequence(c0, c0 + nc - 1)"))
    ).filter((F.col("row") < F.col("rows")) & (F.col("col") < F.col("cols")))
    return painted.groupBy(*beam, "row", "col").agg(
        F.max_by("beamlet_id", scan_code(F.col("r0"), F.col("c0"))).alias("beamlet_id")
    )


ID_CHUNK = 4096


def contiguous_ids(retained: DataFrame, patient: list[str] | None = None) -> DataFrame:
    """Number retained beamlets 0..n-1 in (beam, id) order.

    Ranks are counted inside beams and shifted by the totals of earlier beams, so
    no window spans a whole matrix.
    """
    patient = patient or []
    ranked = running_before(
        retained.select(*patient, "beam_id", "beamlet_id").withColumn("_one", F.lit(1)),
        [*patient, "beam_id"], F.floor(F.col("beamlet_id") / ID_CHUNK), ["beamlet_id"], "_one", "rank",
    )
    sizes = ranked.groupBy(*patient, "beam_id").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*(patient or [F.lit(0)])).orderBy("beam_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*patient, "beam_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return ranked.join(starts, [*patient, "beam_id"]).select(
        *patient, "beam_id", "beamlet_id", (F.col("start") + F.col("rank")).cast("long").alias("column_id")
    )


def contour_edges(contours: DataFrame, beam: list[str] = BEAM) -> DataFrame:
    """Closed edges from contour points (beam, structure, segment, seq, x_mm, y_mm)."""
    ring = [*beam, "structure", "segment"]
    w = Window.partitionBy(*ring).orderBy("seq")
    first = Window.partitionBy(*ring).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return contours.select(
        *ring, F.col("x_mm").alias("x1"), F.col("y_mm").alias("y1"),
        F.coalesce(F.lead("x_mm").over(w), F.first("x_mm").over(first)).alias("x2"),
        F.coalesce(F.lead("y_mm").over(w), F.first("y_mm").over(first)).alias("y2"),
    )


def bev_mask(
    beamlets: DataFrame, contours: DataFrame, structure: str = "PTV", margin_mm: float = 3.0, beam: list[str] = BEAM
) -> DataFrame:
    """Beamlets whose centre lies in a contour grown by `margin_mm`, rows filled between first and last hit.

    An edge only meets beamlets in the 2.5 mm bands its grown y-range touches, so
    the join is an equi-join on (beam, band).
    """
    edges = contour_edges(contours.filter(F.col("structure") == structure), beam)
    band_low = F.floor((F.least("y1", "y2") - margin_mm) / CELL_MM)
    band_high = F.floor((F.greatest("y1", "y2") + margin_mm) / CELL_MM)
    banded = edges.withColumn("band", F.explode(F.sequence(band_low, band_high)))
    near = beamlets.withColumn("band", F.floor(F.col("y_mm") / CELL_MM)).join(banded, [*beam, "band"])
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    px, py = F.col("x_mm") - F.col("x1"), F.col("y_mm") - F.col("y1")
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, clamp((px * dx + py * dy) / length2, 0.0, 1.0)).otherwise(0.0)
    gap2 = (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)
    straddles = (F.col("y1") > F.col("y_mm")) != (F.col("y2") > F.col("y_mm"))
    crosses = straddles & (F.col("x_mm") < dx * py / dy + F.col("x1"))
    hits = (
        near.groupBy(*beam, "segment", "row_idx", "col_idx", "beamlet_id")
        .agg(F.sum(crosses.cast("int")).alias("crossings"), F.min(gap2).alias("gap2"))
        .filter((F.col("crossings") % 2 == 1) | (F.col("gap2") < margin_mm * margin_mm))
    )
    spans = hits.groupBy(*beam, "row_idx").agg(F.min("col_idx").alias("c1"), F.max("col_idx").alias("c2"))
    return beamlets.join(spans, [*beam, "row_idx"]).filter(F.col("col_idx").between(F.col("c1"), F.col("c2"))).drop("c1", "c2")


def _collapse_axis(cells: DataFrame, beam: list[str], axis: str, other: str) -> DataFrame:
    """Compact index of each distinct line along `axis`, after dropping overlapping partial lines.

    Line i repeats line i-1 when no cell differs. Neighbouring cells are compared
    inside each crossing line, so no line is ever collected or self-joined.
    """
    across = Window.partitionBy(*beam, other).orderBy(axis)
    same = (F.lag(axis).over(across) == F.col(axis) - 1) & (F.lag("beamlet_id").over(across) == F.col("beamlet_id"))
    ends = F.coalesce(F.lead(axis).over(across) != F.col(axis) + 1, F.lit(True))
    extent = Window.partitionBy(*beam)
    changed = (
        cells.select(
            *beam, axis,
            F.when(~F.coalesce(same, F.lit(False)), F.col(axis)).alias("_here"), F.when(ends, F.col(axis) + 1).alias("_next"),
        )
        .select(*beam, F.col(axis).alias("_at"), F.explode(F.array_compact(F.array("_here", "_next"))).alias(axis))
        .groupBy(*beam, axis)
        .agg(F.max("_at").alias("_at"))
        .withColumn("_last", F.max("_at").over(extent))
        .filter(F.col(axis) <= F.col("_last"))
    )
    in_order = Window.partitionBy(*beam).orderBy(axis)
    kept = changed.select(*beam, axis, (F.row_number().over(in_order) - 1).alias("line"))
    by_beamlet = Window.partitionBy(*beam, "beamlet_id").orderBy("line")
    members = (
        cells.join(kept, [*beam, axis])
        .groupBy(*beam, axis, "line", "beamlet_id")
        .agg(F.count(F.lit(1)).alias("cells"))
        .withColumn("shared", (F.lag("line").over(by_beamlet) == F.col("line") - 1).cast("int"))
        .groupBy(*beam, axis, "line")
        .agg(F.sum("cells").alias("n"), F.coalesce(F.max("shared"), F.lit(0)).alias("overlap"))
    )
    by_line = Window.partitionBy(*beam).orderBy("line")
    follows = F.lag("line").over(by_line) == F.col("line") - 1
    state = members.withColumn(
        "shorter", (F.when(follows, F.lag("n").over(by_line)).otherwise(0) > F.col("n")).cast("int")
    ).withColumn("run", F.sum(1 - F.col("overlap")).over(by_line))
    in_run = Window.partitionBy(*beam, "run").orderBy("line")
    state = state.withColumn("dropped", F.col("overlap") * F.max(F.col("overlap") * F.col("shorter")).over(in_run))
    state = state.withColumn(
        "dropped_by_next", F.coalesce(F.lead(F.col("overlap") * (1 - F.col("shorter"))).over(by_line), F.lit(0))
    )
    alive = state.filter((F.col("dropped") == 0) & (F.col("dropped_by_next") == 0))
    return alive.select(*beam, axis, (F.row_number().over(in_order) - 1).cast("long").alias(f"compact_{axis}"))


def compact_grid(cells: DataFrame, beam: list[str] = BEAM) -> DataFrame:
    """Finest grid with repeated and overlapping partial rows and columns removed."""
    by_row = _collapse_axis(cells, beam, "row", "col")
    by_col = _collapse_axis(cells.join(by_row, [*beam, "row"]).drop("compact_row"), beam, "col", "row")
    return cells.join(by_row, [*beam, "row"]).join(by_col, [*beam, "col"]).select(
        *beam, F.col("compact_row").alias("row"), F.col("compact_col").alias("col"), "beamlet_id"
    )


def beamlet_info(columns: DataFrame, beamlets: DataFrame, column_ids: list[int]) -> DataFrame:
    """Beam, position and size of the given matrix columns."""
    return columns.filter(F.col("column_id").isin(column_ids)).join(beamlets, ["beam_id", "beamlet_id"])


def influence_select(influence: DataFrame, columns: DataFrame) -> DataFrame:
    """Keep the retained columns and renumber them: one inner join."""
    keys = [c for c in ("patient_id", "beamlet_id") if c in columns.columns]
    return influence.join(columns, keys)


def beamlet_blocks(
    cells: DataFrame, width_mm: float, height_mm: float, remove_corners: bool = False, beam: list[str] = BEAM
) -> DataFrame:
    """Map of coarse blocks to the distinct fine beamlets they hold."""
    if width_mm % CELL_MM or height_mm % CELL_MM:
        raise ValueError("block sizes must be multiples of 2.5 mm")
    nr, nc = int(height_mm / CELL_MM), int(width_mm / CELL_MM)
    blocks = cells.select(
        *beam, F.floor(F.col("row") / nr).alias("block_row"), F.floor(F.col("col") / nc).alias("block_col"),
        "beamlet_id",
    )
    if remove_corners:
        full = blocks.groupBy(*beam, "block_row", "block_col").count().filter(F.col("count") >= nr * nc)
        blocks = blocks.join(full, [*beam, "block_row", "block_col"], "left_semi")
    return blocks.distinct()


def beamlet_downsample(influence: DataFrame, blocks: DataFrame, beam: list[str] = BEAM) -> DataFrame:
    keys = [c for c in ("patient_id", "beamlet_id") if c in blocks.columns]
    return influence.join(blocks, keys).groupBy("patient_id", "beam_id", "block_row", "block_col", "voxel_id").agg(
        F.sum("a").alias("a")
    )


def voxel_downsample(matrix: DataFrame, voxel_map: DataFrame, columns: list[str]) -> DataFrame:
    """Weighted sum of member rows: `voxel_map` has patient_id, voxel_id, block_id and share."""
    return matrix.join(voxel_map, ["patient_id", "voxel_id"]).groupBy("patient_id", "block_id", *columns).agg(
        F.sum(F.col("share") * F.col("a")).alias("a")
    )


def open_field_dose(influence: DataFrame, voxels: DataFrame, prescription_gy: float) -> DataFrame:
    """Dose of unit intensities, min-max scaled to 1.2 times the prescription per patient."""
    parts = influence.select("patient_id", "voxel_id", "a").unionByName(
        voxels.select("patient_id", "voxel_id", F.lit(0.0).alias("a"))
    )
    total = parts.groupBy("patient_id", "voxel_id").agg(F.sum("a").alias("raw"))
    ends = total.groupBy("patient_id").agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    return salted_join(total, ends, ["patient_id"], ["voxel_id"]).select(
        "patient_id", "voxel_id",
        ((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low")) * (1.2 * prescription_gy)).alias("open_field_gy"),
    )


def sparsify_threshold(
    influence: DataFrame, threshold_perc: float = 1.0, threshold_abs: float | None = None, strict: bool = False
) -> DataFrame:
    """Drop entries below a share of the patient's largest entry, or below an absolute value."""
    def passes(limit):
        return F.col("a") > limit if strict else F.col("a") >= limit

    if threshold_abs is not None:
        return influence.filter(passes(F.lit(float(threshold_abs))))
    top = influence.groupBy("patient_id").agg(F.max("a").alias("_top"))
    return salted_join(influence, top, ["patient_id"], ["voxel_id", "beamlet_id"]).filter(passes(F.col("_top") * threshold_perc * 0.01)).drop("_top")


def mixed_uniform(*keys: Column, seed: int = 0) -> Column:
    """A reproducible number in [0, 1): 52 bits of a hash of the seed and the keys, so a retried task draws the same."""
    text = F.concat_ws("|", F.lit(str(seed)), *[key.cast("string") for key in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / 2.0**52


def sparsify_randomised(influence: DataFrame, threshold: float, seed: int = 0) -> DataFrame:
    """Replace the small entries of each row by ceil(sum/threshold) draws proportional to size.

    Draws and share boundaries are merged into one sorted sequence per row, which
    assigns every draw to its interval without pairing draws with entries.
    """
    row = ["patient_id", "voxel_id"]
    small = (F.abs("a") <= threshold) & (F.col("a") != 0)
    totals = influence.filter(small).groupBy(*row).agg(F.sum("a").alias("mass")).filter("mass != 0").withColumn(
        "k", F.ceil(F.col("mass") / threshold)
    )
    before = Window.partitionBy(*row).orderBy("beamlet_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        influence.filter(small).join(totals, row)
        .select(*row, "beamlet_id", (F.coalesce(F.sum("a").over(before), F.lit(0.0)) / F.col("mass")).alias("at"),
                F.lit(0).alias("is_draw"), F.lit(None).cast("double").alias("part"))
    )
    draws = totals.withColumn("draw", F.explode(F.expr("sequence(1, k)"))).select(
        *row, F.lit(None).cast("long").alias("beamlet_id"),
        mixed_uniform(F.col("patient_id"), F.col("voxel_id"), F.col("draw"), seed=seed).alias("at"),
        F.lit(1).alias("is_draw"), (F.col("mass") / F.col("k")).alias("part"),
    )
    line = Window.partitionBy(*row).orderBy("at", "is_draw", "beamlet_id").rowsBetween(Window.unboundedPreceding, 0)
    drawn = starts.unionByName(draws).withColumn("hit", F.last("beamlet_id", ignorenulls=True).over(line)).filter(
        "is_draw = 1"
    ).select(*row, F.col("hit").alias("beamlet_id"), F.col("part").alias("a"))
    large = influence.filter(F.abs("a") > threshold).select(*row, "beamlet_id", "a")
    return large.unionByName(drawn).groupBy(*row, "beamlet_id").agg(F.sum("a").alias("a"))


def fluence_to_grid(fluence: DataFrame, cells: DataFrame) -> DataFrame:
    keys = [c for c in ("plan_id", "patient_id", "beamlet_id") if c in cells.columns and c in fluence.columns]
    return cells.join(fluence, keys, "left").withColumn("intensity", F.coalesce("intensity", F.lit(0.0)))


def grid_to_fluence(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Cells back to beamlets; the last cell in row-major order gives the value."""
    return grid.groupBy(*keys, "beamlet_id").agg(F.max_by("intensity", scan_code(F.col("row"), F.col("col"))).alias("intensity"))


def fluence_transfer(coarse: DataFrame, coarse_cells: DataFrame, fine_cells: DataFrame, beam: list[str] = BEAM) -> DataFrame:
    """Coarse solution on a finer beamlet set through the finest grid; finer to coarser raises."""
    painted = fluence_to_grid(coarse, coarse_cells).select("plan_id", *beam, "row", "col", "intensity")
    merged = fine_cells.join(painted, [*beam, "row", "col"])
    n_coarse = coarse_cells.groupBy(*beam).agg(F.count_distinct("beamlet_id").alias("n_coarse"))
    n_fine = fine_cells.groupBy(*beam).agg(F.count_distinct("beamlet_id").alias("n_fine"))
    guard = n_coarse.join(n_fine, beam).select(
        *beam,
        F.when(F.col("n_fine") < F.col("n_coarse"), F.raise_error(F.lit("the target beamlets are coarser")).cast("boolean"))
        .otherwise(F.lit(True)).alias("_ok"),
    )
    # one value for all, as a join by beam would sort a beam's cells in one task
    return grid_to_fluence(merged.filter(guard.agg(F.bool_and("_ok")).scalar()), ["plan_id", *beam])


def column_group_sum(influence: DataFrame, groups: DataFrame) -> DataFrame:
    """A M for a 0/1 group map (beamlet_id, group_id)."""
    return influence.join(groups, [c for c in ("patient_id", "beamlet_id") if c in groups.columns]).groupBy(
        "patient_id", "voxel_id", "group_id"
    ).agg(F.sum("a").alias("a"))


def column_tail_zero(influence: DataFrame, fraction: float = 0.001, inclusive: bool = True) -> DataFrame:
    """Drop entries at (inclusive) or below a share of their column's maximum."""
    tops = influence.groupBy("patient_id", "beamlet_id").agg(F.max("a").alias("_top"))
    limit = F.col("_top") * fraction
    keep = F.col("a") > limit if inclusive else F.col("a") >= limit
    return influence.join(tops, ["patient_id", "beamlet_id"]).filter(keep).drop("_top")


def matrix_compare(first: DataFrame, second: DataFrame, keys: list[str], value: str = "a", by: tuple[str, ...] = ("patient_id",)) -> DataFrame:
    """Largest and mean absolute difference and relative norm of two sparse tables.

    Union and one aggregate instead of a full outer join: one shuffle of each side.
    """
    both = first.select(*keys, F.col(value).alias("u"), F.lit(0.0).alias("v")).unionByName(
        second.select(*keys, F.lit(0.0).alias("u"), F.col(value).alias("v"))
    ).groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("v").alias("v"))
    d = F.abs(F.col("u") - F.col("v"))
    return both.groupBy(*by).agg(
        F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"),
        (F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("u") * F.col("u")))).alias("relative_norm"),
    )


def dose_correction(
    accurate: DataFrame, approximate: DataFrame, opt_voxels: DataFrame, structures: DataFrame,
    prescription_gy: float, fractions: int, structure: str = "PTV", volume_perc: float = 90.0,
) -> DataFrame:
    """Per-fraction correction between two normalised doses, and the corrected total dose."""
    from dosefold.operators.evaluation import dose_at_volume

    keys = ["patient_id", "plan_id"]
    pair = accurate.select(*keys, "voxel_id", F.col("dose_gy").alias("full_gy")).join(
        approximate.select(*keys, "voxel_id", F.col("dose_gy").alias("sparse_gy")), [*keys, "voxel_id"]
    )
    target = opt_voxels.filter(F.col("structure") == structure)
    for name in ("full_gy", "sparse_gy"):
        side = accurate if name == "full_gy" else approximate
        level = dose_at_volume(target.join(side, ["patient_id", "voxel_id"]), structures, [volume_perc]).select(
            *keys, (F.col("dose_at_volume_gy") / prescription_gy).alias(f"_{name}")
        )
        pair = pair.join(level, keys)
    norm = {n: F.when(F.col(f"_{n}") != 0, F.col(n) / F.col(f"_{n}")) for n in ("full_gy", "sparse_gy")}
    delta = (norm["full_gy"] - norm["sparse_gy"]) / fractions
    return pair.select(
        *keys, "voxel_id", delta.alias("delta_gy"),
        ((F.col("sparse_gy") / fractions + delta) * fractions).alias("corrected_gy"),
    )


def first_column_lookup(cells: DataFrame, wanted: DataFrame, beam: list[str] = BEAM, default: float | None = None) -> DataFrame:
    """Column of the first row-major occurrence of each wanted id."""
    first = cells.groupBy(*beam, "beamlet_id").agg(F.min_by("col", scan_code(F.col("row"), F.col("col"))).alias("col"))
    return wanted.join(first, [*beam, "beamlet_id"], "left").withColumn(
        "first_col", F.coalesce(F.col("col").cast("double"), F.lit(default).cast("double"))
    ).drop("col")
