"""Objective values and gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.salted import salted_join
from dosefold.functions.stored import bucketed


def step_lookup(distance: Column, knots: list[tuple[float, float]]) -> Column:
    """Value of the next knot at or beyond the distance; NULL past the last knot."""
    chosen = None
    for at, value in knots:
        chosen = F.when(distance <= at, value) if chosen is None else chosen.when(distance <= at, value)
    return chosen


GROUP = ["patient_id", "plan_id"]


def penalty(dose: Column, kind: Column, target: Column) -> Column:
    """Voxel penalty of the three quadratic objective types."""
    over = F.greatest(dose - target, F.lit(0.0))
    under = F.greatest(target - dose, F.lit(0.0))
    return F.when(kind == "quadratic-overdose", over * over).when(kind == "quadratic-underdose", under * under).when(
        kind == "quadratic", dose * dose
    )


def slope(dose: Column, kind: Column, target: Column) -> Column:
    """Half the derivative of the penalty."""
    return F.when(kind == "quadratic-overdose", F.greatest(dose - target, F.lit(0.0))).when(
        kind == "quadratic-underdose", F.least(dose - target, F.lit(0.0))
    ).when(kind == "quadratic", dose)


def objective_terms(sd: DataFrame, objectives: DataFrame, volume_weighted: bool = False) -> DataFrame:
    """Value of each objective: weight times the plain or volume-weighted mean penalty.

    `sd` has per-fraction `dose`; `objectives`: objective_id, type, structure,
    weight_factor, target (per fraction). Objectives of absent structures give no row.
    """
    p = penalty(F.col("dose"), F.col("type"), F.col("target"))
    mean = F.sum(F.col("weight") * p) / F.sum("weight") if volume_weighted else F.sum(p) / F.count(F.lit(1))
    return sd.join(objectives, "structure").groupBy(*GROUP, "objective_id", "type", "structure").agg(
        (F.max("weight_factor") * mean).alias("value")
    )


def weighted_quadratic(sd: DataFrame, voxel_weights: DataFrame, weight: float) -> DataFrame:
    """Sum of per-voxel weight times squared dose over the voxel count."""
    return sd.join(voxel_weights, ["patient_id", "structure", "voxel_id"]).groupBy(*GROUP, "structure").agg(
        (F.sum(F.col("voxel_weight") * F.col("dose") * F.col("dose")) / F.count(F.lit(1)) * weight).alias("value")
    )


def neighbour_pairs(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal and vertical neighbours on a beamlet grid; one window per grid line, no self join."""
    def along(fixed, axis, label):
        line = Window.partitionBy(*keys, fixed).orderBy(axis)
        return grid.select(
            *keys, F.lit(label).alias("direction"), "beamlet_id", F.lead("beamlet_id").over(line).alias("other"),
            F.col(axis).alias("_at"), F.lead(axis).over(line).alias("_next"),
        ).filter("_next = _at + 1").drop("_at", "_next")

    return along("row", "col", "right").unionByName(along("col", "row", "down"))


def smoothness(grid: DataFrame, beam: list[str], plan: list[str]) -> DataFrame:
    """0.6/cols times squared right differences plus 0.4/rows times squared down differences.

    `grid` has plan, beam, row, col and intensity of compact beamlets; empty cells have no row.
    """
    size = grid.groupBy(*plan, *beam).agg((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c")).groupBy(*plan).agg(
        F.sum("r").alias("rows"), F.sum("c").alias("cols")
    )
    def squares(fixed, axis, name):
        line = Window.partitionBy(*plan, *beam, fixed).orderBy(axis)
        diff = F.when(F.lead(axis).over(line) == F.col(axis) + 1, F.col("intensity") - F.lead("intensity").over(line))
        return grid.withColumn(name, diff).groupBy(*plan).agg(F.coalesce(F.sum(F.col(name) * F.col(name)), F.lit(0.0)).alias(name))

    return squares("row", "col", "sx").join(squares("col", "row", "sy"), plan).join(size, plan).select(
        *plan, (0.6 / F.col("cols") * F.col("sx") + 0.4 / F.col("rows") * F.col("sy")).alias("value")
    )


def mimicking(dose: DataFrame, predicted: DataFrame, body: DataFrame, target: DataFrame) -> DataFrame:
    """Mean squared deviation from a predicted dose in the target, mean squared excess elsewhere in the body."""
    flagged = body.select("patient_id", "voxel_id").join(
        target.select("patient_id", "voxel_id", F.lit(True).alias("_t")), ["patient_id", "voxel_id"], "left"
    )
    e = F.col("dose") - F.col("predicted")
    over = F.greatest(e, F.lit(0.0))
    joined = flagged.join(dose, ["patient_id", "voxel_id"]).join(predicted, ["patient_id", "voxel_id"])
    inside = F.col("_t").isNotNull()
    return joined.groupBy(*GROUP).agg(
        F.avg(F.when(inside, e * e)).alias("target_value"), F.avg(F.when(~inside, over * over)).alias("organ_value")
    )


def distance_falloff(
    dose: DataFrame, distance: DataFrame, limits: list[tuple[float, float]], weights: list[tuple[float, float]],
    factor: float, kind: str,
) -> DataFrame:
    """Penalty by distance from a target: linear excess over the stepped limit, or weighted squared dose."""
    at = F.col("distance_mm")
    w, goal = step_lookup(at, weights), step_lookup(at, limits)
    term = w * F.greatest(F.col("dose") - goal, F.lit(0.0)) if kind == "linear" else w * F.col("dose") * F.col("dose")
    return dose.join(distance.select("patient_id", "voxel_id", "distance_mm"), ["patient_id", "voxel_id"]).groupBy(*GROUP).agg(
        (F.sum(term) / F.count(F.lit(1)) * factor).alias("value")
    )


def objective_total(terms: DataFrame) -> DataFrame:
    """Sum per term and in total, rounded to 4 decimals; the total has a NULL term."""
    return terms.groupBy(*GROUP, F.col("type").alias("term")).agg(F.sum("value").alias("value")).rollup(*GROUP, "term").agg(
        F.sum("value").alias("value")
    ).filter("plan_id IS NOT NULL").withColumn("value", F.bround("value", 4))


def _sizes(sd: DataFrame) -> DataFrame:
    """Voxel count per structure; counting the dose column keeps the dose shuffle shared with the caller's."""
    return sd.groupBy(*GROUP, "structure").agg(F.count("dose").alias("n"))


def voxel_residual(sd: DataFrame, objectives: DataFrame) -> DataFrame:
    """Gradient of the objective sum with respect to voxel dose, all objectives folded per voxel."""
    sizes = _sizes(sd)
    r = 2 * F.col("weight_factor") / F.col("n") * slope(F.col("dose"), F.col("type"), F.col("target"))
    return salted_join(sd.join(objectives, "structure"), sizes, [*GROUP, "structure"], ["voxel_id"]).groupBy(*GROUP, "voxel_id").agg(
        F.sum(r).alias("residual")
    )


def gradient(influence: DataFrame, residual: DataFrame) -> DataFrame:
    """A transposed times the residual: one join on voxel and one map-side combined sum per beamlet."""
    return influence.join(residual, ["patient_id", "voxel_id"]).groupBy(*GROUP, "beamlet_id").agg(
        F.sum(F.col("a") * F.col("residual")).alias("gradient")
    )


def scaled_scores(grad: DataFrame) -> DataFrame:
    """Gradients as shares of the plan's largest. The window holds one plan's beamlets, so the gradient is not made twice for a join."""
    top = F.max(F.abs("gradient")).over(Window.partitionBy(*GROUP))
    return grad.withColumn("_top", top).withColumn("score", F.when(F.col("_top") > 0, F.col("gradient") / F.col("_top"))).drop("_top")


def finite_difference(
    influence: DataFrame, sd: DataFrame, objectives: DataFrame, selected: DataFrame, delta: float = 1e-3
) -> DataFrame:
    """Objective change per unit intensity of each unselected beamlet, from the voxels its column reaches."""
    sizes = _sizes(sd)
    kind, target = F.col("type"), F.col("target")
    moved = penalty(F.col("dose") + delta * F.col("a"), kind, target) - penalty(F.col("dose"), kind, target)
    return (
        influence.join(selected, [c for c in ("patient_id", "beamlet_id") if c in selected.columns], "left_anti")
        .join(sd, ["patient_id", "voxel_id"]).join(objectives, "structure").join(sizes, [*GROUP, "structure"])
        .groupBy(*GROUP, "beamlet_id")
        .agg((F.sum(F.col("weight_factor") / F.col("n") * moved) / delta).alias("score"))
    )


def best_row_segments(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Per leaf row the contiguous segment with the most negative score sum; NULL bounds when none is negative.

    One prefix-sum window per grid row, at most the field width long.
    """
    line = Window.partitionBy(*keys, "row").orderBy("col")
    prefix = scores.withColumn("p", F.sum("score").over(line))
    past = line.rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("col").over(Window.partitionBy(*keys, "row"))
    top = F.max(F.struct("p", (-F.col("col")).alias("neg"), "next_col")).over(past)
    ranked = prefix.withColumn("next_col", F.lead("col").over(line)).select(
        *keys, "row", "col", "p", first.alias("c0"), top.alias("top")
    ).select(
        *keys, "row", "col",
        (F.col("p") - F.greatest(F.coalesce("top.p", F.lit(0.0)), F.lit(0.0))).alias("value"),
        F.when(F.col("top.p") > 0, F.col("top.next_col")).otherwise(F.col("c0")).alias("start"),
    )
    best = ranked.groupBy(*keys, "row").agg(F.min(F.struct("value", "col", "start")).alias("b"))
    open_row = F.col("b.value") < 0
    return best.select(
        *keys, "row", F.when(open_row, F.col("b.start")).alias("first_col"), F.when(open_row, F.col("b.col")).alias("last_col"),
        F.when(open_row, F.col("b.value")).otherwise(0.0).alias("segment_score"),
    )


def best_aperture(segments: DataFrame, group: list[str]) -> DataFrame:
    per_beam = segments.groupBy(*group, "beam_id").agg(F.sum("segment_score").alias("aperture_score"))
    return per_beam.groupBy(*group).agg(F.min(F.struct("aperture_score", "beam_id")).alias("b")).select(
        *group, F.col("b.beam_id").alias("beam_id"), F.col("b.aperture_score").alias("aperture_score")
    )


def _gaps(x: DataFrame, pairs: DataFrame, smooth: tuple[float, float], values: list[str]) -> DataFrame:
    """Differences `g<value>` of each neighbour pair that a plan has, from either side, with the weight `w` of its direction.

    A pair meets once and then becomes two rows: half the rows of a join from both sides.
    """
    w = F.when(F.col("direction") == "right", smooth[0]).otherwise(smooth[1])
    peer = x.selectExpr(*GROUP, "beamlet_id AS other", *[f"{v} AS _{v}" for v in values])
    met = x.join(pairs.select("beamlet_id", "other", w.alias("w")), "beamlet_id").join(peer, [*GROUP, "other"])
    there = ", ".join(f"{v} - _{v} AS g{v}" for v in values)
    back = ", ".join(f"_{v} - {v} AS g{v}" for v in values)
    return met.selectExpr(*GROUP, "w", f"inline(array(struct(beamlet_id, {there}), struct(other AS beamlet_id, {back})))")


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _both_layouts(influence: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """The matrix in buckets by beamlet, for A x, and by voxel, for A^T r: neither product shuffles it."""
    by_voxel = bucketed(influence.select("patient_id", "voxel_id", "beamlet_id", "a"), f"{folder}/by_voxel", ["patient_id", "voxel_id"])
    return bucketed(by_voxel, f"{folder}/by_beamlet", ["patient_id", "beamlet_id"]), by_voxel


def fluence_descent(
    start: DataFrame, influence: DataFrame, voxels: DataFrame, opt_voxels: DataFrame, objectives: DataFrame,
    pairs: DataFrame, smooth: tuple[float, float], step: float, rounds: int, scale: float = 1.0,
) -> DataFrame:
    """A fixed number of projected gradient steps of fixed length on fluence, keeping each patient's best iterate.

    `settled_descent` chooses its steps and goes on until nothing is gained.

    `start`: patient_id, plan_id, beamlet_id, intensity; `pairs`: neighbouring
    beamlets with direction; `smooth`: weights of right and down differences.
    What a round leaves (intensities, pulls of the neighbours, dose by structure
    voxel, objective by plan) is written to the shared folder as Parquet before the
    next is planned, so the number of rounds doesn't widen the plan. The best
    iterate is picked among the written ones at the end.
    """
    from dosefold.operators.matrix import dose_from_fluence
    from dosefold.session import scratch_folder

    folder, beamlet = scratch_folder(start.sparkSession, "descent"), [*GROUP, "beamlet_id"]
    cells = [*GROUP, "structure", "voxel_id"]
    pairs = _written(pairs.select("beamlet_id", "other", "direction"), f"{folder}/pairs")
    by_beamlet, by_voxel = _both_layouts(influence, folder)
    x = _written(start.select(*beamlet, "intensity"), f"{folder}/x/iteration=0")
    for k in range(rounds + 1):
        dose = dose_from_fluence(by_beamlet, x, voxels, scale=scale)
        sd = _written(opt_voxels.select("patient_id", "structure", "voxel_id").join(dose, ["patient_id", "voxel_id"]).select(
            *cells, F.col("dose_gy").alias("dose")), f"{folder}/dose{k}")
        rough = _written(_gaps(x, pairs, smooth, ["intensity"]).groupBy(*beamlet).agg(
            F.expr("sum(w * gintensity * gintensity / 2)").alias("part"), F.expr("sum(2 * w * gintensity)").alias("pull")), f"{folder}/rough{k}")
        objective_terms(sd, objectives).select(*GROUP, "value").unionByName(
            rough.select(*GROUP, F.col("part").alias("value"))
        ).groupBy(*GROUP).agg(F.sum("value").alias("objective")).write.parquet(f"{folder}/objective/iteration={k}")
        if k == rounds:
            break
        grad = gradient(by_voxel, voxel_residual(sd, objectives)).select(
            *beamlet, (F.col("gradient") * scale).alias("g")
        ).unionByName(rough.select(*beamlet, F.col("pull").alias("g"))).groupBy(*beamlet).agg(F.sum("g").alias("g"))
        x = _written(x.join(grad, beamlet, "left").select(
            *beamlet, F.greatest(F.col("intensity") - step * F.coalesce("g", F.lit(0.0)), F.lit(0.0)).alias("intensity"),
        ), f"{folder}/x/iteration={k + 1}")
    spark = start.sparkSession
    least = spark.read.parquet(f"{folder}/objective").groupBy(*GROUP).agg(F.min(F.struct("objective", "iteration")).alias("_best")).select(
        *GROUP, "_best.objective", "_best.iteration")
    return spark.read.parquet(f"{folder}/x").join(least, [*GROUP, "iteration"]).select(
        *beamlet, "intensity", "objective", F.col("iteration").cast("long").alias("iteration"))


#: Shares of the full step, and of the way from it to the farthest feasible one, that a line search tries.
WITHIN = (0.0, 1 / 256, 1 / 64, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)
BEYOND = (1 / 8, 1 / 4, 3 / 8, 1 / 2, 3 / 4, 1.0)
FARTHEST = 8.0


def _line_search(sd: DataFrame, objectives: DataFrame, beams: DataFrame, rough: DataFrame) -> DataFrame:
    """Per patient and plan the tried step `t` of least objective; `objective` there and `was` at step 0.

    The dose is linear in the step, so every tried step is valued in one pass
    over voxels, without another product with the matrix.
    """
    reach = beams.groupBy(*GROUP).agg(F.expr(f"least(coalesce(min(CASE WHEN d < 0 THEN -x / d END), {FARTHEST}D), {FARTHEST}D)").alias("reach"))
    tries = [f"{t}D" for t in WITHIN] + [f"(1 + (greatest(reach, 1D) - 1) * {t}D)" for t in BEYOND]
    names = [f"v{j}" for j in range(len(tries))]

    def valued(t: str) -> str:
        e = f"(dose + {t} * along - target)"
        return f"""max(weight_factor) * sum(CASE type WHEN 'quadratic-overdose' THEN greatest({e}, 0D) * greatest({e}, 0D)
            WHEN 'quadratic-underdose' THEN least({e}, 0D) * least({e}, 0D) WHEN 'quadratic' THEN ({e} + target) * ({e} + target) END) / count(1)"""

    terms = salted_join(sd, reach, GROUP, ["voxel_id"]).join(objectives, "structure").groupBy(*GROUP, "objective_id", "type", "structure").agg(
        *[F.expr(valued(t)).alias(n) for t, n in zip(tries, names)]
    ).select(*GROUP, *names)
    whole = rough.groupBy(*GROUP).agg(*[F.sum(q).alias(q) for q in ("q0", "q1", "q2")])
    uneven = whole.join(reach, GROUP).selectExpr(*GROUP, *[f"q0 + {t} * q1 + {t} * {t} * q2 AS {n}" for t, n in zip(tries, names)])
    total = terms.unionByName(uneven).groupBy(*GROUP).agg(*[F.expr(f"sum({n})").alias(n) for n in names]).join(reach, GROUP)
    pairs = ", ".join(f"struct({n} AS objective, {t} AS t)" for t, n in zip(tries, names))
    return total.selectExpr(*GROUP, f"array_min(array({pairs})) AS least", "v0 AS was").selectExpr(*GROUP, "least.t AS t", "least.objective AS objective", "was")


def settled_descent(
    start: DataFrame, influence: DataFrame, voxels: DataFrame, opt_voxels: DataFrame, objectives: DataFrame,
    pairs: DataFrame, smooth: tuple[float, float], step: float, scale: float = 1.0, tolerance: float = 1e-3,
) -> DataFrame:
    """Projected conjugate gradient descent on fluence until a plan gains no more than `tolerance` of its objective in a round.

    A round moves along d = max(x - a (g - b s), 0) - x by the best of several
    tried lengths, never uphill. Per patient and plan `a` is `step` first, then the
    two Barzilai-Borwein lengths by turns, and `b` the Hestenes-Stiefel share of
    the last move s (0 where a beamlet is shut). It reads the matrix twice: for
    the dose along d and for the next gradient; the matrix is written once in
    buckets by beamlet and by voxel, so that neither product shuffles it. What a round leaves (beamlets, dose
    by structure voxel, steps by plan) is written to the shared folder, so the plan
    doesn't grow and a lost executor repeats one round at most. A plan that has
    settled leaves the loop; its rows are kept as they are then.

    Arguments as for `fluence_descent`; result: patient_id, plan_id, beamlet_id,
    intensity, objective, iteration (rounds that moved the plan).
    """
    from dosefold.operators.matrix import dose_from_fluence
    from dosefold.session import scratch_folder

    spark = start.sparkSession
    folder = scratch_folder(spark, "descent")
    beamlet, cells = [*GROUP, "beamlet_id"], [*GROUP, "structure", "voxel_id"]

    def written(df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{folder}/{name}")

    def with_pulls(moving: DataFrame) -> DataFrame:
        """Roughness of x + t d as q0 + t q1 + t^2 q2 and its slope as px + t pd, by beamlet."""
        gaps = _gaps(moving.select(*beamlet, "x", "d"), pairs, smooth, ["x", "d"])
        names = {"q0": "w * gx * gx / 2", "q1": "w * gx * gd", "q2": "w * gd * gd / 2", "px": "2 * w * gx", "pd": "2 * w * gd"}
        pulls = gaps.groupBy(*beamlet).agg(*[F.expr(f"sum({v})").alias(n) for n, v in names.items()])
        return moving.join(pulls, beamlet, "left").fillna(0.0, list(names))

    def slopes(sd: DataFrame) -> DataFrame:
        found = gradient(by_voxel, voxel_residual(sd, objectives))
        return found.selectExpr(*beamlet, f"gradient * {scale}D AS _g")

    pairs = written(pairs.select("beamlet_id", "other", "direction"), "pairs")
    by_beamlet, by_voxel = _both_layouts(influence, folder)
    x = written(start.selectExpr(*beamlet, "intensity AS x", "0D AS d"), "start")
    dose = dose_from_fluence(by_beamlet, x.selectExpr(*beamlet, "x AS intensity"), voxels, scale=scale)
    sd = written(opt_voxels.select("patient_id", "structure", "voxel_id").join(dose, ["patient_id", "voxel_id"]).selectExpr(*cells, "dose_gy AS dose"), "dose")
    beams = written(with_pulls(x).join(slopes(sd), beamlet, "left").selectExpr(*beamlet, "x", "coalesce(_g, 0D) + px AS g", "0D AS s", "0D AS y"), "beams")
    lengths = x.select(*GROUP).distinct().withColumn("a", F.lit(float(step)))
    done, k = f"{folder}/done", 0
    while True:
        k += 1
        spectral = "ss / sy" if k % 2 else "sy / yy"
        sums = beams.groupBy(*GROUP).agg(*[F.expr(f"sum({v})").alias(n) for n, v in (
            ("ss", "s * s"), ("sy", "s * y"), ("yy", "y * y"), ("gy", "CASE WHEN x <= 0 AND g > 0 THEN 0D ELSE g * y END"))])
        lengths = written(sums.join(lengths, GROUP).selectExpr(
            *GROUP, f"CASE WHEN sy > 0 AND yy > 0 THEN {spectral} ELSE a END AS a", "CASE WHEN sy > 0 THEN greatest(gy / sy, 0D) ELSE 0D END AS b"), f"lengths{k}")
        ahead = beams.join(lengths, GROUP).selectExpr(
            *beamlet, "x", "g", "greatest(x - a * (g - b * CASE WHEN x > 0 THEN s ELSE 0D END), 0D) - x AS d", "b")
        moving = written(with_pulls(ahead), f"moving{k}")
        along = dose_from_fluence(by_beamlet, moving.selectExpr(*beamlet, "d AS intensity"), scale=scale)
        sd = written(sd.join(along, [*GROUP, "voxel_id"], "left").selectExpr(*cells, "dose", "coalesce(dose_gy, 0D) AS along"), f"dose{k}")
        search = _line_search(sd, objectives, moving, moving).join(lengths.select(*GROUP, "b"), GROUP)
        # a move that gains nothing with a share of the last one is tried again without
        steps = written(search.selectExpr(
            *GROUP, "t", "objective", "CASE WHEN was > 0 THEN 1 - objective / was ELSE 0D END AS gain", "t = 0 AND b > 0 AS again"), f"steps{k}")
        over = F.expr(f"gain <= {tolerance}D AND NOT again")
        left, ended = steps.agg(F.count(F.when(~over, 1)), F.count(F.when(over, 1))).first()
        moved = moving.join(steps, GROUP).selectExpr("*", "greatest(x + t * d, 0D) AS to")
        if ended:
            settled = moved.where(over).selectExpr(*beamlet, "to AS intensity", "objective", f"CASE WHEN t > 0 THEN {k}L ELSE {k - 1}L END AS iteration")
            settled.write.mode("append").parquet(done)
        if not left:
            return spark.read.schema(settled.schema).parquet(done)
        sd = salted_join(sd, steps.where(~over).select(*GROUP, "t"), GROUP, ["voxel_id"]).selectExpr(*cells, "dose + t * along AS dose")
        changed = moved.where(~over).join(slopes(sd), beamlet, "left").selectExpr(
            *beamlet, "to", "g", "to - x AS s", "coalesce(_g, 0D) + px + t * pd AS new")
        beams = written(changed.selectExpr(*beamlet, "to AS x", "new AS g", "s", "new - g AS y"), f"beams{k}")


def dose_limit_report(stats: DataFrame, tails: DataFrame, limits: DataFrame) -> DataFrame:
    """Slack (limit minus value) of max, mean and tail limits.

    `stats` from dose_statistics, `tails` from tail_mean with request_id,
    `limits`: limit_id, kind, structure, limit_gy (limit_id equals request_id for tails).
    """
    plain = stats.join(limits.filter(F.col("kind").isin("max", "mean")), "structure").select(
        *GROUP, "limit_id", "kind", "structure", "limit_gy",
        F.when(F.col("kind") == "max", F.col("max_dose_gy")).otherwise(F.col("mean_dose_gy")).alias("value_gy"),
    )
    tail = tails.join(limits.filter("kind = 'cvar'").withColumnRenamed("limit_id", "request_id"), ["request_id", "structure"]).select(
        *GROUP, F.col("request_id").alias("limit_id"), "kind", "structure", "limit_gy", F.col("tail_mean_gy").alias("value_gy")
    )
    return plain.unionByName(tail).withColumn("slack_gy", F.col("limit_gy") - F.col("value_gy"))


def objective_prediction(
    sd: DataFrame, predicted: DataFrame, objectives: DataFrame, prescription_per_fraction: float, organ_scale: float = 0.1
) -> DataFrame:
    """Prediction-guided objective: target terms against prediction and prescription, organ terms by weight."""
    joined = sd.join(predicted, ["patient_id", "voxel_id"])
    e = F.col("dose") - F.col("predicted")
    off = F.col("dose") - prescription_per_fraction
    target = joined.filter("structure = 'PTV'").groupBy(*GROUP).agg(
        (10 * F.avg(e * e)).alias("target_prediction"), (0.1 * F.avg(off * off)).alias("target_prescription")
    )
    over = F.greatest(e, F.lit(0.0))
    organs = joined.join(objectives.filter("type = 'quadratic'"), "structure").groupBy(*GROUP, "structure").agg(
        (organ_scale * F.max("weight_factor") * F.avg(over * over)).alias("o1"),
        (0.0001 * organ_scale * F.max("weight_factor") * F.avg(F.col("dose") * F.col("dose"))).alias("o2"),
    ).groupBy(*GROUP).agg(F.sum("o1").alias("organ_prediction"), F.sum("o2").alias("organ_quadratic"))
    return target.join(organs, GROUP, "left").fillna(0.0, ["organ_prediction", "organ_quadratic"])
