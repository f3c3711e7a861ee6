"""Arc delivery tables: control points, leaf rows, openness and monitor units.

`cells` are compact beamlets (beam_id, row, col, beamlet_id); `arcs` give the
control-point order as (arc_id, position, beam_id). Every table may carry
patient_id and plan_id: they are then part of every key, and a table that lacks
a key of the first one is an error, so arcs of different patients and plans
never mix. Windows span one leaf row, one beam's rows or one plan's control
points, all bounded by the machine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.prefix import running_min_before
from dosefold.functions.salted import salted_join
from dosefold.operators.matrix import mixed_uniform

# Leaf edges in mm, 10 mm leaves outside and 5 mm leaves inside 100 mm.
LEAF_EDGES_MM = [float(y) for y in [*range(-200, -100, 10), *range(-100, 100, 5), *range(100, 201, 10)]]


def plan_keys(first: DataFrame, *others: DataFrame) -> list[str]:
    """The keys of patient and plan that `first` carries; raises where another table lacks one or has one more."""
    keys = [c for c in ("patient_id", "plan_id") if c in first.columns]
    for other in others:
        found = [c for c in ("patient_id", "plan_id") if c in other.columns]
        if found != keys:
            raise ValueError(f"tables of one call need the same keys of patient and plan: {keys} and {found}")
    return keys


def arc_points(arcs: DataFrame) -> DataFrame:
    """Control points of arcs given as (arc_id, beam_ids array)."""
    k = plan_keys(arcs)
    return arcs.select(*k, "arc_id", F.posexplode("beam_ids").alias("position", "beam_id")).select(
        *k, "arc_id", F.col("position").cast("long").alias("position"), F.col("beam_id").cast("long").alias("beam_id")
    )


def arc_table(points: DataFrame, cells: DataFrame, beamlets: DataFrame) -> DataFrame:
    """Control points with their beamlet ranges and the ranges of the whole arc."""
    k = plan_keys(points, cells, beamlets)
    grid = cells.groupBy(*k, "beam_id").agg(
        F.min("beamlet_id").alias("start_beamlet"), F.max("beamlet_id").alias("end_beamlet"), F.count_distinct("row").alias("num_rows")
    )
    reach = beamlets.groupBy(*k, "beam_id").agg(F.min("x_mm").alias("min_x_mm"), F.max("x_mm").alias("max_x_mm"))
    per_beam = points.join(grid, [*k, "beam_id"]).join(reach, [*k, "beam_id"])
    per_arc = per_beam.groupBy(*k, "arc_id").agg(
        F.count(F.lit(1)).alias("num_beams"), F.min_by("start_beamlet", "position").alias("arc_start_beamlet"),
        F.max_by("end_beamlet", "position").alias("arc_end_beamlet"), F.sum("num_rows").alias("total_rows"),
        F.min("min_x_mm").alias("arc_min_x_mm"), F.max("max_x_mm").alias("arc_max_x_mm"),
    )
    return per_beam.join(per_arc, [*k, "arc_id"])


def _leaf_array() -> Column:
    pairs = list(zip(LEAF_EDGES_MM, LEAF_EDGES_MM[1:]))
    return F.array(*[
        F.struct(F.lit(i + 1).cast("long").alias("pair"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high) in enumerate(pairs)
    ])


def leaf_row_match(rows: DataFrame) -> DataFrame:
    """Leaf pairs inside each beamlet row (y_mm, height_mm); the 60 leaves are a literal, so no join."""
    low, high = F.col("y_mm") - F.col("height_mm") / 2, F.col("y_mm") + F.col("height_mm") / 2
    covered = F.filter(_leaf_array(), lambda leaf: (leaf["low"] >= low) & (leaf["high"] <= high))
    return rows.select("*", F.inline(covered)).select(
        *rows.columns, F.col("pair").alias("leaf_pair"), (F.col("high") - F.col("low")).alias("thickness_mm")
    )


def arc_offsets(points: DataFrame, matches: DataFrame, beamlets: DataFrame, width_mm: float, height_mm: float) -> DataFrame:
    """Row and column offset of every control point inside its arc's common grid."""
    k = plan_keys(points, matches, beamlets)
    ends = matches.groupBy(*k, "beam_id").agg(F.max("leaf_pair").alias("start_leaf_pair"), F.min("leaf_pair").alias("end_leaf_pair"))
    reach = beamlets.groupBy(*k, "beam_id").agg(F.min("x_mm").alias("min_x_mm"))
    per_beam = points.join(ends, [*k, "beam_id"]).join(reach, [*k, "beam_id"])
    per_arc = per_beam.groupBy(*k, "arc_id").agg(F.max("start_leaf_pair").alias("arc_start"), F.min("min_x_mm").alias("arc_min_x_mm"))
    joined = per_beam.join(per_arc, [*k, "arc_id"])
    above = F.filter(
        _leaf_array(), lambda leaf: (leaf["pair"] > F.col("start_leaf_pair")) & (leaf["pair"] <= F.col("arc_start"))
    )
    rows_above = F.aggregate(
        above, F.lit(0.0), lambda total, leaf: total + F.least((leaf["high"] - leaf["low"]) / height_mm, F.lit(1.0))
    )
    return joined.select(
        *k, "arc_id", "beam_id", "start_leaf_pair", "end_leaf_pair",
        ((F.col("min_x_mm") - F.col("arc_min_x_mm")) / width_mm).alias("offset_x"), F.ceil(rows_above).alias("offset_y"),
    )


def open_leaf_positions(cells: DataFrame, seed: int | None = None) -> DataFrame:
    """Leaves just outside the beam's-eye view of each row, or seeded random leaves inside it."""
    k = plan_keys(cells)
    rows = cells.groupBy(*k, "beam_id", "row").agg((F.min("col") - 1).alias("left"), (F.max("col") + 1).alias("right"))
    if seed is None:
        return rows
    u1 = mixed_uniform(*[F.col(c) for c in k], F.col("beam_id"), F.col("row"), F.lit(1), seed=seed)
    u2 = mixed_uniform(*[F.col(c) for c in k], F.col("beam_id"), F.col("row"), F.lit(2), seed=seed)
    picked = rows.withColumn("_l", F.col("left") + F.floor(u1 * F.greatest(F.col("right") - 1 - F.col("left"), F.lit(1))))
    return picked.select(
        *k, "beam_id", "row", F.col("_l").alias("left"),
        (F.col("_l") + 2 + F.floor(u2 * F.greatest(F.col("right") - 1 - F.col("_l"), F.lit(1)))).alias("right"),
    )


def split_rows(leaves: DataFrame, view: DataFrame, widths: DataFrame, forward: bool, step: int) -> DataFrame:
    """Column ranges of left boundary, interior and right boundary per leaf row.

    `leaves` has left and right, `view` the open positions of the row, `widths` the
    number of columns of the beam. Moving forward closes up to `step` columns from
    both sides, alternating back where the leaves would collide; backward opens up
    to `step` columns inside the view.
    """
    k = plan_keys(leaves, view, widths)
    df = leaves.join(
        view.select(*k, "beam_id", "row", F.col("left").alias("view_left"), F.col("right").alias("view_right")), [*k, "beam_id", "row"]
    ).join(widths, [*k, "beam_id"])
    left, right = F.col("left"), F.col("right")
    ahead = step if forward else 0
    back = 0 if forward else step
    near_l, near_r = F.least(left + ahead, right - 1), F.greatest(right - ahead, left + 1)
    clash = F.greatest(near_l - near_r + 1, F.lit(0))
    near_l, near_r = near_l - F.ceil(clash / 2), near_r + F.floor(clash / 2)
    far_l = F.greatest(F.greatest(left - back, F.lit(-1)), F.col("view_left"))
    far_r = F.least(F.least(right + back, F.col("num_cols")), F.col("view_right"))
    l1, l2 = F.least(far_l, left) + 1, F.greatest(near_l, left)
    r1, r2 = F.least(near_r, right), F.greatest(far_r, right) - 1
    df = df.withColumn("l1", l1).withColumn("l2", l2).withColumn("r1", r1).withColumn("r2", r2)
    return df.select(
        *k, "beam_id", "row", "left", "right", "l1", "l2", "r1", "r2",
        F.when(F.col("l1") <= F.col("l2"), F.col("l2") + 1).otherwise(left + 1).alias("i1"),
        F.when(F.col("r1") <= F.col("r2"), F.col("r1") - 1).otherwise(right - 1).alias("i2"),
    )


def classify_cells(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """Class of each beamlet in its row; closed beamlets have no row."""
    k = plan_keys(cells, ranges)
    c = F.col("col")
    kind = (
        F.when(c.between(F.col("l1"), F.col("l2")), "left").when(c.between(F.col("r1"), F.col("r2")), "right")
        .when(c.between(F.col("i1"), F.col("i2")), "interior")
    )
    return cells.join(ranges, [*k, "beam_id", "row"]).withColumn("kind", kind).filter("kind IS NOT NULL").select(
        *k, "beam_id", "row", "col", "beamlet_id", "kind"
    )


def openness(weights: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Share of each beamlet that is open: weight over monitor units, at most one, zero without units.

    Weights that carry their beam's `mu` need no table of units: a weight for each
    patient, plan and beamlet is many rows to shuffle for it.
    """
    if units is not None:
        weights = weights.join(units, [*plan_keys(weights, units), "beam_id"])
    return weights.withColumn(
        "open", F.when(F.col("mu") > 0, F.least(F.lit(1.0), F.col("weight") / F.col("mu"))).otherwise(0.0)
    )


def pack_openness(opened: DataFrame, classes: DataFrame) -> DataFrame:
    """Deliverable openness: boundary fractions pushed against the interior.

    The k-th boundary cell counted from the interior gets what is left of the
    boundary's sum after k whole cells. Rows with at most one fractional cell, or two
    that do not touch, stay as they are.
    """
    k = plan_keys(opened, classes)
    df = opened.join(classes.select(*k, "beam_id", "beamlet_id", "kind"), [*k, "beam_id", "beamlet_id"], "left")
    row = Window.partitionBy(*k, "beam_id", "row")
    part = (F.col("open") > 0) & (F.col("open") < 1)
    fractional = F.count(F.when(part, 1)).over(row)
    gap = F.max(F.when(part, F.col("col"))).over(row) - F.min(F.when(part, F.col("col"))).over(row)
    keep = (fractional <= 1) | ((fractional == 2) & (gap > 1))
    side = Window.partitionBy(*k, "beam_id", "row", "kind")
    total = F.sum("open").over(side)
    place = F.when(
        F.col("kind") == "left", F.row_number().over(side.orderBy(F.col("col").desc()))
    ).otherwise(F.row_number().over(side.orderBy(F.col("col").asc()))) - 1
    packed = F.greatest(F.least(total - place, F.lit(1.0)), F.lit(0.0))
    return df.withColumn(
        "actual", F.when(keep | ~F.coalesce(F.col("kind").isin("left", "right"), F.lit(False)), F.col("open")).otherwise(packed)
    )


def reference_leaves(opened: DataFrame, classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaf positions for the next pass: whole boundary cells backward, begun cells forward."""
    k = plan_keys(opened, classes, leaves)
    sums = opened.join(classes.select(*k, "beam_id", "beamlet_id", "kind"), [*k, "beam_id", "beamlet_id"]).groupBy(*k, "beam_id", "row").agg(
        F.max(F.when(F.col("kind") == "left", F.col("col"))).alias("lc"), F.sum(F.when(F.col("kind") == "left", F.col("open"))).alias("ls"),
        F.min(F.when(F.col("kind") == "right", F.col("col"))).alias("rc"), F.sum(F.when(F.col("kind") == "right", F.col("open"))).alias("rs"),
    )
    return leaves.join(sums, [*k, "beam_id", "row"], "left").select(
        *k, "beam_id", "row",
        F.coalesce(F.col("lc") - F.floor("ls"), F.col("left")).alias("left_backward"), F.coalesce(F.col("lc") - F.ceil("ls"), F.col("left")).alias("left_forward"),
        F.coalesce(F.col("rc") + F.floor("rs"), F.col("right")).alias("right_backward"), F.coalesce(F.col("rc") + F.ceil("rs"), F.col("right")).alias("right_forward"),
    )


def continuous_leaves(leaves_mu: DataFrame, units: DataFrame) -> DataFrame:
    """Leaf positions from position-times-units values, with the aperture area per control point."""
    k = plan_keys(leaves_mu, units)
    def position(c):
        return F.rint(F.col(c) / (F.col("mu") + 1e-12) * 1e4) / 1e4

    rows = leaves_mu.join(units, [*k, "beam_id"]).withColumn("left_pos", position("left_mu")).withColumn("right_pos", position("right_mu"))
    area = rows.groupBy(*k, "beam_id").agg(F.sum(F.col("right_pos") - F.col("left_pos")).alias("area"))
    return rows.join(area, [*k, "beam_id"]).select(*k, "beam_id", "row", "left_pos", "right_pos", "area")


def angle_weights(points: DataFrame, gantry: DataFrame) -> DataFrame:
    """Half the circular gantry gap between the neighbours; the ends use their single neighbour."""
    k = plan_keys(points, gantry)
    arc = Window.partitionBy(*k, "arc_id").orderBy("position")
    g = F.col("gantry_angle")
    low, high = F.coalesce(F.lag(g).over(arc), g), F.coalesce(F.lead(g).over(arc), g)
    gap = F.abs(high - low)
    return points.join(gantry, [*k, "beam_id"]).withColumn("angle_weight", F.least(gap, 360 - gap) / 2)


def arc_dose(
    influence: DataFrame, weights: DataFrame, points: DataFrame, correction: DataFrame | None = None,
    alpha: float = 0.0, n_columns: int | None = None, factors: DataFrame | None = None,
) -> DataFrame:
    """Dose of delivered weights times angle weights, per patient, voxel and (if the weights have one) plan.

    `weights`: beamlet_id, beam_id, weight; `points` carry angle_weight. Weights with a
    patient meet that patient's influence only; weights without one are of all patients.
    The correction adds alpha times the mean delivered weight of a patient and plan
    times a per-voxel delta.

    With `factors` (keys of `points`, beam_id, factor) a weight is that of its beamlet
    times its beam's factor, and `weights` need only the keys that their own values
    depend on: patients that share beamlets then don't repeat them. The matrix meets
    the beamlets first, each entry one, and the factors of its beam after.
    """
    if factors is not None:
        return _factored_dose(influence, weights, points, factors, correction, alpha, n_columns)
    k = plan_keys(weights, points)
    used = weights.join(points.select(*k, "beam_id", "angle_weight"), [*k, "beam_id"]).select(
        *k, "beamlet_id", (F.col("weight") * F.col("angle_weight")).alias("w")
    )
    meet = [c for c in k if c in influence.columns]
    out = ["patient_id", *[c for c in k if c != "patient_id"], "voxel_id"]
    dose = influence.join(used, [*meet, "beamlet_id"]).groupBy(*out).agg(F.sum(F.col("a") * F.col("w")).alias("dose_gy"))
    if correction is None or not alpha:
        return dose
    mean = (F.sum("weight") / (F.lit(n_columns) if n_columns else F.count(F.lit(1)))).alias("_mean")
    if k:
        # a mean for each patient and plan: small beside the voxels, and joined on its own keys
        shifted = correction.join(weights.groupBy(*k).agg(mean), [c for c in k if c in correction.columns])
    else:
        shifted = correction.withColumn("_mean", weights.agg(mean).scalar())
    shifted = shifted.select(*out, (alpha * F.col("_mean") * F.col("delta_gy")).alias("dose_gy"))
    return dose.unionByName(shifted).groupBy(*out).agg(F.sum("dose_gy").alias("dose_gy"))


def _factored_dose(
    influence: DataFrame, weights: DataFrame, points: DataFrame, factors: DataFrame, correction: DataFrame | None, alpha: float, n_columns: int | None
) -> DataFrame:
    k = plan_keys(points, factors)
    own = [c for c in k if c in weights.columns]
    out = ["patient_id", *[c for c in k if c != "patient_id"], "voxel_id"]
    entries = influence.join(weights, [*[c for c in own if c in influence.columns], "beamlet_id"]).select(
        "patient_id", *[c for c in own if c != "patient_id"], "voxel_id", "beam_id", (F.col("a") * F.col("weight")).alias("part"))
    beams = points.join(factors, [*k, "beam_id"]).select(*k, "beam_id", (F.col("factor") * F.col("angle_weight")).alias("_f"))
    met = salted_join(entries, beams, [*[c for c in k if c in entries.columns], "beam_id"], ["voxel_id"])
    parts = met.select(*out, (F.col("part") * F.col("_f")).alias("dose_gy"))
    if correction is not None and alpha:
        sums = weights.groupBy(*own, "beam_id").agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
        mean = F.sum(F.col("_w") * F.col("factor")) / (F.lit(n_columns) if n_columns else F.sum("_n"))
        each = factors.join(sums, [*own, "beam_id"])
        if k:
            shifted = salted_join(correction, each.groupBy(*k).agg(mean.alias("_mean")), [c for c in k if c in correction.columns], ["voxel_id"])
        else:
            shifted = correction.withColumn("_mean", each.agg(mean).scalar())
        parts = parts.unionByName(shifted.select(*out, (alpha * F.col("_mean") * F.col("delta_gy")).alias("dose_gy")))
    return parts.groupBy(*out).agg(F.sum("dose_gy").alias("dose_gy"))


def aperture_regularity(leaves: DataFrame) -> DataFrame:
    """Squared leaf steps between neighbouring rows of each control point."""
    k = plan_keys(leaves)
    rows = Window.partitionBy(*k, "beam_id").orderBy("row")
    follows = F.lead("row").over(rows) == F.col("row") + 1
    dl = F.when(follows, F.lead("left").over(rows) - F.col("left"))
    dr = F.when(follows, F.lead("right").over(rows) - F.col("right"))
    return leaves.withColumn("s", dl * dl + dr * dr).groupBy(*k, "beam_id").agg(F.coalesce(F.sum("s"), F.lit(0)).alias("regularity"))


def aperture_similarity(leaves: DataFrame, points: DataFrame) -> DataFrame:
    """Squared leaf steps of matching rows between consecutive control points, per arc."""
    k = plan_keys(points, leaves)
    along = Window.partitionBy(*k, "arc_id", "row").orderBy("position")
    follows = F.lead("position").over(along) == F.col("position") + 1
    dl = F.when(follows, F.lead("left").over(along) - F.col("left"))
    dr = F.when(follows, F.lead("right").over(along) - F.col("right"))
    return leaves.join(points, [*k, "beam_id"]).withColumn("s", dl * dl + dr * dr).groupBy(*k, "arc_id").agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("similarity"), F.count("s").alias("pairs")
    )


def mu_similarity(points: DataFrame, units: DataFrame) -> DataFrame:
    """Absolute and squared differences of monitor units between neighbours of an arc."""
    k = plan_keys(points, units)
    arc = Window.partitionBy(*k, "arc_id").orderBy("position")
    d = F.lead("mu").over(arc) - F.col("mu")
    return points.join(units, [*k, "beam_id"]).withColumn("d", d).groupBy(*k, "arc_id").agg(
        F.sum(F.abs("d")).alias("sum_abs"), F.sum(F.col("d") * F.col("d")).alias("sum_squared")
    )


def arc_mu_balance(points: DataFrame, units: DataFrame) -> DataFrame:
    """Mean over arcs of the squared difference of weighted units between consecutive arcs, per patient and plan.

    Arcs are numbered with steps of any size. The next arc is found among the
    arcs of the plan, of which a machine delivers a few.
    """
    k = plan_keys(points, units)
    sums = points.join(units, [*k, "beam_id"]).groupBy(*k, "arc_id").agg(F.sum(F.col("mu") * F.col("angle_weight")).alias("total"))
    arcs = sums.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("arc_id", "total"))).alias("a"))
    steps = F.transform(F.sequence(F.lit(1), F.size("a") - 1), lambda i: F.pow(F.col("a")[i]["total"] - F.col("a")[i - 1]["total"], F.lit(2)))
    total = F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)
    return arcs.select(*k, F.when(F.size("a") > 1, total / F.size("a")).alias("balance"))


def meterset(points: DataFrame, units: DataFrame) -> DataFrame:
    """Cumulative share of units per control point, 4 decimals."""
    k = plan_keys(points, units)
    arc = Window.partitionBy(*k, "arc_id").orderBy("position")
    total = F.sum("mu").over(Window.partitionBy(*k, "arc_id"))
    return points.join(units, [*k, "beam_id"]).withColumn("meterset", F.rint(F.sum("mu").over(arc) / total * 1e4) / 1e4)


def fluence_levels(fluence: DataFrame, levels: int = 40, keys: list[str] = ["plan_id", "beam_id"]) -> DataFrame:
    """Whole intensity levels per beam, half-even; the beam maximum comes from a map-side combined aggregate."""
    top = fluence.groupBy(*keys).agg(F.max("intensity").alias("_top"))
    return fluence.join(top, keys).withColumn(
        "level", F.when(F.col("_top") > 0, F.rint(F.col("intensity") / F.col("_top") * levels)).otherwise(0.0).cast("long")
    ).drop("_top")


ITERATION_CHUNK = 4096


def accepted_iterations(iterations: DataFrame, run: list[str]) -> DataFrame:
    """Iterations below the best objective so far, with their gain in percent."""
    seen = running_min_before(iterations, run, F.floor(F.col("iteration") / ITERATION_CHUNK), ["iteration"], "objective", "best_before")
    accepted = F.col("best_before").isNull() | (F.col("objective") < F.col("best_before"))
    return seen.withColumn("accepted", accepted).withColumn(
        "gain_perc", F.when(accepted, (F.col("best_before") - F.col("objective")) / F.col("best_before") * 100)
    )


def best_iterations(iterations: DataFrame, run: list[str]) -> DataFrame:
    return iterations.groupBy(*run).agg(F.min(F.struct("objective", "iteration")).alias("b")).select(
        *run, F.col("b.iteration").alias("best_iteration"), F.col("b.objective").alias("best_objective")
    )


CLOSED_MM, DEFAULT_BANK_MM = 0.5, 0.5


def delivery_leaves(
    points: DataFrame, rows: DataFrame, matches: DataFrame, units: DataFrame, min_x: DataFrame, cell_mm: float = 2.5
) -> DataFrame:
    """Bank positions in mm for every leaf pair and control point, with scaled units and their running share.

    `rows`: beam_id, row, left_pos, right_pos in cells; `matches`: leaf pairs of each row.
    Openings under 0.5 mm keep the default on one bank and zero on the other; pairs
    without a row keep the defaults. The first control point delivers no units.
    """
    k = plan_keys(points, rows, matches, units, min_x)
    placed = matches.select(*k, "beam_id", "row", "leaf_pair").join(rows, [*k, "beam_id", "row"]).join(min_x, [*k, "beam_id"])
    left, right = F.col("left_pos") * cell_mm, F.col("right_pos") * cell_mm
    shut = right - left < CLOSED_MM
    banks = placed.select(
        *k, "beam_id", "leaf_pair", F.when(shut, DEFAULT_BANK_MM).otherwise(F.col("min_x_mm") + left - cell_mm / 2).alias("bank_b_mm"),
        F.when(shut, 0.0).otherwise(F.col("min_x_mm") + right + cell_mm / 2).alias("bank_a_mm"),
    )
    arc = Window.partitionBy(*k, "arc_id").orderBy("position")
    scaled = points.join(units, [*k, "beam_id"]).withColumn("mu100", F.when(F.col("position") == 0, 0.0).otherwise(F.col("mu") * 100.0))
    shares = scaled.withColumn(
        "meterset", F.sum("mu100").over(arc) / F.nullif(F.sum("mu100").over(Window.partitionBy(*k, "arc_id")), F.lit(0.0))
    )
    pairs = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(len(LEAF_EDGES_MM) - 1).cast("long")))
    every = shares.select(*k, "arc_id", "position", "beam_id", "mu100", "meterset", pairs.alias("leaf_pair"))
    return every.join(banks, [*k, "beam_id", "leaf_pair"], "left").select(
        *k, "arc_id", "position", "beam_id", "leaf_pair", F.coalesce("bank_b_mm", F.lit(DEFAULT_BANK_MM)).alias("bank_b_mm"),
        F.coalesce("bank_a_mm", F.lit(DEFAULT_BANK_MM)).alias("bank_a_mm"), "mu100", "meterset",
    )
