"""Training tables for dose prediction and the metrics that judge predictions.

Models are not run here: predictions are an input table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.headers import on_grid
from dosefold.functions.numeric import clamp
from dosefold.functions.prefix import exact_quantiles
from dosefold.functions.salted import grown, salted_join
from dosefold.operators import geometry as ge
from dosefold.operators import grids as vx
from dosefold.operators.evaluation import smoothed_dvh
from dosefold.operators.matrix import mixed_uniform

CELL = ["patient_id", "ix", "iy", "iz"]


def training_features(
    ct: DataFrame, dose: DataFrame, labels: DataFrame, open_field: DataFrame, prescription_gy: float
) -> DataFrame:
    """Per voxel: scaled CT, clipped dose, organ label, target flag and open-field dose.

    `ct` is the cropped grid with hu and voxel_id. Target cells carry the prescription
    in the open-field channel. Cases without a target or without dose are left out.
    Each plan of a patient is a case of its own, if the dose has plan_id.
    """
    plan = [c for c in ("plan_id",) if c in dose.columns]
    cases = dose.select("patient_id", *plan).distinct().join(labels.filter("target = 1").select("patient_id"), "patient_id", "left_semi")
    joined = (
        salted_join(ct, cases, ["patient_id"], ["ix", "iy", "iz"])
        .join(dose.select("patient_id", *plan, "voxel_id", "dose_gy"), ["patient_id", *plan, "voxel_id"], "left")
        .join(open_field, ["patient_id", "voxel_id"], "left")
        .join(labels, CELL, "left")
    )
    target = F.coalesce("target", F.lit(0))
    return joined.select(
        *plan, *CELL, vx.hu_normalize(F.col("hu")).alias("ct_norm"),
        clamp(F.coalesce("dose_gy", F.lit(0.0)), 0.0, 1.2 * prescription_gy).alias("dose_gy"),
        F.coalesce("label", F.lit(0)).alias("label"), target.alias("target"),
        F.when(target == 1, float(prescription_gy)).otherwise(F.coalesce("open_field_gy", F.lit(0.0))).alias("open_field_gy"),
    )


def resize_features(features: DataFrame, start_xy: tuple[int, int], size: tuple[int, int, int], target: tuple[int, int, int]) -> DataFrame:
    """Training features on a fixed grid: linear CT, dose and open field, nearest label and target.

    `size` is the cropped grid starting at `start_xy`. All linear channels share one
    join of the eight source cells. plan_id stays a key, if the features have it.
    """
    plan = [c for c in ("plan_id",) if c in features.columns]
    local = features.withColumn("ix", F.col("ix") - start_xy[0]).withColumn("iy", F.col("iy") - start_xy[1])
    keys = [*plan, "patient_id", "jx", "jy", "jz"]
    targets = vx.resize_targets(local.select(*plan, "patient_id").distinct(), size, target)
    smooth = ["ct_norm", "dose_gy", "open_field_gy"]
    linear = vx.corner_weights(targets, keys).join(local.select(*plan, *CELL, *smooth), [*plan, *CELL]).groupBy(*keys).agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in smooth]
    )
    at = targets.select(*keys, *[F.floor(F.col(f) + 0.5).cast("long").alias(i) for f, i in zip(("fx", "fy", "fz"), ("ix", "iy", "iz"))])
    return linear.join(grown(grown(at).join(local.select(*plan, *CELL, "label", "target"), [*plan, *CELL]).drop("ix", "iy", "iz")), keys)


def beamlet_samples(
    influence: DataFrame, framed: DataFrame, beamlets: DataFrame, beams: DataFrame, radius_mm: float, fraction: float = 0.001
) -> DataFrame:
    """Per matrix entry of the chosen beams: target value, ray distances and depth around body entry.

    `framed` are voxels in the beam frame with in_body; `beams` the chosen patient and beam pairs.
    """
    from dosefold.operators.matrix import column_tail_zero

    chosen = influence.join(beamlets, "beamlet_id").join(beams.select("patient_id", "beam_id"), ["patient_id", "beam_id"], "left_semi")
    kept = column_tail_zero(chosen, fraction)
    frame = framed.join(beams.select("patient_id", "beam_id"), ["patient_id", "beam_id"], "left_semi")
    pairs = ge.ray_distances(kept.join(frame, ["patient_id", "beam_id", "voxel_id"]))
    near = ge.near_ray_pairs(frame.filter("in_body"), beamlets, radius_mm)
    return ge.body_entry(pairs, near).select(
        "patient_id", "beam_id", "beamlet_id", "voxel_id", F.col("a").alias("target_value"), "d1_mm", "d2_mm", "entry_mm",
        "outside_mm", "inside_mm", "in_body",
    )


# Channel scales of the prediction model.
D2_SCALE_MM, D1_SCALE_MM, OUTSIDE_SCALE_MM, DOSE_SCALE, DOSE_GAIN, HOT_LEVEL = 600.0, 1600.0, 800.0, 0.7, 10.0, 0.1


def normalize_channels(samples: DataFrame) -> DataFrame:
    """Scaled distances and dose with the hot and scatter masks (columns d1_mm, d2_mm, outside_mm, value)."""
    y = F.col("value") / DOSE_SCALE * DOSE_GAIN
    return samples.select(
        "*", (F.col("d2_mm") / D2_SCALE_MM).alias("d2_norm"), (F.col("d1_mm") / D1_SCALE_MM).alias("d1_norm"),
        (F.col("outside_mm") / OUTSIDE_SCALE_MM).alias("outside_norm"), y.alias("value_norm"),
        (y >= HOT_LEVEL).cast("long").alias("hot"), ((y > 0) & (y < HOT_LEVEL)).cast("long").alias("scatter"),
    )


def normalize_beam(samples: DataFrame, keys: list[str], value: str = "value", quantile: float = 0.99) -> DataFrame:
    """Divide by the 0.99 quantile of the group (its maximum below 16 values) and clip to [0, 1]."""
    q = exact_quantiles(samples, keys, value, {"_q": quantile})
    top = samples.groupBy(*keys).agg(F.max(value).alias("_top"), F.count(F.lit(1)).alias("_n"))
    scale = F.greatest(F.when(F.col("_n") >= 16, F.col("_q")).otherwise(F.col("_top")), F.lit(1e-6))
    return samples.join(q, keys).join(top, keys).withColumn("beam_norm", clamp(F.col(value) / scale, 0.0, 1.0)).drop("_q", "_top", "_n")


def interpolation_operator(ct: DataFrame, ratio: tuple | None, shift: tuple | None, size: tuple[int, int, int] | None, headers: DataFrame | None = None) -> DataFrame:
    """The resampling of a predicted grid to dose voxels as a sparse operator: patient_id, voxel_id, ix, iy, iz, w.

    A dose voxel takes the trilinear value at its last CT cell (z, y, x order),
    none if that lies beyond `size`: the cell t lies at the source index t * ratio + shift. One table
    per set of CTs serves all predictions on them, so store it. `headers` has the
    structs ratio, shift and size for each patient.
    """
    cells, ratio, shift, size = on_grid(ct.filter(F.col("voxel_id").isNotNull()).select(*CELL, "voxel_id"), headers, ratio=ratio, shift=shift, size=size)
    last = F.max(F.struct("iz", "iy", "ix")).alias("_c")
    parts = [] if headers is None else [F.first(p).alias(p) for p in ("ratio", "shift", "size")]
    at = cells.groupBy("patient_id", "voxel_id").agg(last, *parts)
    for f, axis, r, o, n in zip(("fx", "fy", "fz"), ("ix", "iy", "iz"), ratio, shift, size):
        index = F.col("_c")[axis]
        at = at.withColumn(f, F.when((index >= 0) & (index < n), index * r + o))
    at = at.filter("fx IS NOT NULL AND fy IS NOT NULL AND fz IS NOT NULL")
    return vx.corner_weights(at, ["patient_id", "voxel_id"])


def predicted_matrix(predictions: DataFrame, operator: DataFrame, unscale: float = DOSE_SCALE / DOSE_GAIN, tail: float = 0.0) -> DataFrame:
    """Matrix entries from predicted grids: unscale, mask, cut tails, resample to dose voxels by `interpolation_operator`.

    `predictions`: patient_id, beamlet_id, ix, iy, iz, value, mask. Only non-zero
    cells are sent to the voxels they touch; cells beyond the predicted grid are
    zero. A `tail` cuts each beamlet's cells below that share of its largest, by a
    window over the beamlet's own cells.
    """
    column = ["patient_id", "beamlet_id"]
    scaled = predictions.withColumn("value", F.col("value") * unscale * F.col("mask"))
    if tail > 0:
        top = F.max("value").over(Window.partitionBy(*column))
        scaled = scaled.withColumn("_top", top).filter(F.col("value") >= tail * F.col("_top")).drop("_top")
    hit = scaled.filter("value != 0").select(*column, "ix", "iy", "iz", "value").join(operator, CELL)
    return hit.groupBy(*column, "voxel_id").agg(F.sum(F.col("w") * F.col("value")).alias("a")).filter("a != 0")


def prediction_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, R2, correlation and normalised RMSE per sample from one pass of sums.

    Columns true_value, predicted, mask (0 or 1); cells outside the mask count as zero on both sides.
    """
    p, t = F.col("predicted") * F.col("mask"), F.col("true_value") * F.col("mask")
    s = samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.greatest(F.sum("mask"), F.lit(1.0)).alias("n"), F.sum(F.abs(p - t)).alias("ae"),
        F.sum(p).alias("sp"), F.sum(t).alias("st"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("tt"), F.sum(p * t).alias("pt"),
        F.max(t).alias("hi"), F.min(t).alias("lo"),
    )
    pm, tm = F.col("sp") / F.col("n"), F.col("st") / F.col("n")
    size = F.col("cells")
    sst = F.col("tt") - 2 * tm * F.col("st") + size * tm * tm
    spp = F.col("pp") - 2 * pm * F.col("sp") + size * pm * pm
    cross = F.col("pt") - pm * F.col("st") - tm * F.col("sp") + size * pm * tm
    sse = F.col("tt") - 2 * F.col("pt") + F.col("pp")
    def floor_at(value):
        return F.greatest(value, F.lit(1e-8))
    return s.select(
        *keys, (F.col("ae") / F.col("n")).alias("mae"), (1.0 - sse / floor_at(sst)).alias("r2"),
        (cross / (floor_at(F.sqrt(spp)) * floor_at(F.sqrt(sst)))).alias("corr"),
        (F.sqrt(sse / F.col("n")) / floor_at(F.col("hi") - F.col("lo"))).alias("nrmse"),
    )


def scaled_mae(doses: DataFrame, target: DataFrame, body: DataFrame, prescription_gy: float) -> DataFrame:
    """Mean absolute error over dosed body voxels after scaling D97 of the true target dose to the prescription."""
    d97 = exact_quantiles(
        doses.join(target.select("patient_id", "voxel_id"), ["patient_id", "voxel_id"], "left_semi"),
        ["patient_id"], "true_gy", {"d97": 0.03},
    )
    inside = doses.join(body.select("patient_id", "voxel_id"), ["patient_id", "voxel_id"], "left_semi").join(d97, "patient_id")
    scale = prescription_gy / (F.col("d97") + 1e-5)
    t, p = F.col("true_gy") * scale, F.col("predicted_gy") * scale
    dosed = (t > 0) | (p > 0)
    return inside.groupBy("patient_id").agg(F.coalesce(F.avg(F.when(dosed, F.abs(t - p))), F.lit(0.0)).alias("scaled_mae_gy"))


def metric_rollup(metrics: DataFrame, names: list[str]) -> DataFrame:
    """NaN-ignoring mean per patient and overall with sample counts, worst mean absolute error first."""
    means = [F.avg(F.when(~F.isnan(n), F.col(n))).alias(n) for n in names]
    return metrics.rollup("patient_id").agg(F.count(F.lit(1)).alias("samples"), *means).orderBy(F.col(names[0]).desc())


def weighted_l1(samples: DataFrame, keys: list[str], alpha: float = 2.0, eps: float = 1e-6) -> DataFrame:
    """Absolute error weighted by 1 + alpha * true/max(true), with and without the mask."""
    top = samples.groupBy(*keys).agg(F.greatest(F.max("true_value"), F.lit(eps)).alias("_top"))
    w = 1.0 + alpha * F.col("true_value") / F.col("_top")
    e = F.abs(F.col("predicted") - F.col("true_value"))
    m = F.col("mask")
    return samples.join(top, keys).groupBy(*keys).agg(
        (F.sum(e * w) / F.greatest(F.sum(w), F.lit(eps))).alias("loss"),
        (F.sum(e * w * m) / F.greatest(F.sum(w * m), F.lit(eps))).alias("masked_loss"),
    )


def moment_difference(samples: DataFrame, moments: tuple[int, ...] = (1, 2, 10), eps: float = 1e-6) -> DataFrame:
    """Mean over organs and orders of the difference of dose moments (columns structure, true_value, predicted)."""
    def moment(column: str, n: int) -> Column:
        return F.pow(F.greatest(F.avg(F.pow(column, F.lit(float(n)))), F.lit(eps)), F.lit(1.0 / n))

    per_organ = samples.groupBy("patient_id", "structure").agg(
        *[F.abs(moment("predicted", n) - moment("true_value", n)).alias(f"m{n}") for n in moments]
    )
    total = sum((F.col(f"m{n}") for n in moments[1:]), F.col(f"m{moments[0]}"))
    return per_organ.groupBy("patient_id").agg((F.avg(total) / len(moments)).alias("loss"))


def gradient_difference(
    grid: DataFrame, gamma_edge: int = 25, gamma_flat: int = 0, lambda_edge: float = 0.1, lambda_flat: float = 0.05
) -> DataFrame:
    """Mean weighted squared difference of central-difference gradients; edges replicate. Windows span grid lines."""
    df = grid
    for axis, others in (("ix", ["iy", "iz"]), ("iy", ["ix", "iz"]), ("iz", ["ix", "iy"])):
        line = Window.partitionBy("patient_id", *others).orderBy(axis)
        for c in ("true_value", "predicted"):
            ahead, behind = F.coalesce(F.lead(c).over(line), F.col(c)), F.coalesce(F.lag(c).over(line), F.col(c))
            df = df.withColumn(f"_{c}_{axis}", (ahead - behind) / 2.0)
    axes = ("ix", "iy", "iz")
    diff2 = sum(((F.col(f"_predicted_{a}") - F.col(f"_true_value_{a}")) ** 2 for a in axes), F.lit(0.0))
    steep = F.sqrt(sum((F.col(f"_true_value_{a}") ** 2 for a in axes), F.lit(0.0))) + 1e-6

    def term(gamma):
        return diff2 * F.least(F.pow(steep, F.lit(float(gamma))), F.lit(6.0))

    return df.groupBy("patient_id").agg(F.avg(lambda_edge * term(gamma_edge) + lambda_flat * term(gamma_flat)).alias("loss"))


def _curve_pairs(samples: DataFrame) -> DataFrame:
    """Smoothed curves of the true (`t`) and the predicted (`p`) value, both from one pass over the samples."""
    sides = F.array(
        F.struct(F.lit("t").alias("side"), F.col("true_value").alias("dose_gy")),
        F.struct(F.lit("p").alias("side"), F.col("predicted").alias("dose_gy")),
    )
    curve = smoothed_dvh(samples.select("patient_id", "structure", F.inline(sides)), ["patient_id", "structure", "side"], together=["patient_id", "structure"])
    return curve.groupBy("patient_id", "structure", "bin").agg(
        F.max("bin_gy").alias("bin_gy"), *[F.max(F.when(F.col("side") == s, F.col("volume_frac"))).alias(s) for s in ("t", "p")]
    )


def dvh_losses(samples: DataFrame) -> DataFrame:
    """Mean squared difference of the smoothed curves and the Bhattacharyya form."""
    return _curve_pairs(samples).groupBy("patient_id").agg(
        F.avg((F.col("p") - F.col("t")) * (F.col("p") - F.col("t"))).alias("dvh_loss"),
        (-F.log(F.greatest(F.sum(F.sqrt(F.col("p") * F.col("t"))), F.lit(1e-3)))).alias("bhattacharyya_loss"),
    )


def berhu(samples: DataFrame, keys: list[str], delta: float = 1.0, eps: float = 1e-8) -> DataFrame:
    e = (F.col("predicted") - F.col("true_value")) * F.col("mask")
    loss = F.when(F.abs(e) <= delta, F.abs(e)).otherwise((e * e + delta * delta) / (2 * delta))
    return samples.groupBy(*keys).agg((F.sum(loss) / F.greatest(F.sum("mask"), F.lit(eps))).alias("loss"))


def dvh_comparison(samples: DataFrame) -> DataFrame:
    """True and predicted smoothed curves in percent per case and organ."""
    return _curve_pairs(samples).select(
        "patient_id", "structure", "bin", "bin_gy", (F.col("t") * 100).alias("true_perc"), (F.col("p") * 100).alias("predicted_perc")
    )


def augment_parameters(
    samples: DataFrame, size: tuple[int, int, int] | None = None, seed: int = 0, max_shift: float = 10.0, max_angle: float = 10.0, headers: DataFrame | None = None
) -> DataFrame:
    """A seeded affine map per sample: axis flips times a small rotation about the centre, plus a shift.

    Adds m00..m22 and o0..o2 (axes x, y, z).
    """
    def draw(k):
        return mixed_uniform(F.col("patient_id"), F.lit(k), F.lit(k * k), seed=seed)

    flips = [F.when(draw(k) < 0.5, -1.0).otherwise(1.0) for k in (1, 2, 3)]
    angles = [F.radians((draw(k) * 2 - 1) * max_angle) for k in (4, 5, 6)]
    cx, cy, cz = (F.cos(a) for a in angles)
    sx, sy, sz = (F.sin(a) for a in angles)
    # Rz * Ry * Rx
    rotation = [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]
    df, size = on_grid(samples, headers, size=size)
    for i in range(3):
        for j in range(3):
            df = df.withColumn(f"m{i}{j}", flips[i] * rotation[i][j])
    for i in range(3):
        turned = F.col(f"m{i}0") * (size[0] / 2) + F.col(f"m{i}1") * (size[1] / 2) + F.col(f"m{i}2") * (size[2] / 2)
        df = df.withColumn(f"o{i}", size[i] / 2 - turned + (draw(7 + i) * 2 - 1) * max_shift)
    return df if headers is None else df.drop("size")


def augment(
    grid: DataFrame, maps: DataFrame, size: tuple[int, int, int] | None, linear: list[str], nearest: list[str], dose: str = "dose_gy", headers: DataFrame | None = None
) -> DataFrame:
    """Apply one affine map per sample; positions clamp to the grid, dose survives where its moved mask does.

    `grid` is complete, for each plan if it has plan_id. All linear channels share one join of the eight source cells.
    """
    plan = [c for c in ("plan_id",) if c in grid.columns]
    maps, size = on_grid(maps, headers, size=size)
    targets = salted_join(grid.select(*plan, *CELL), maps, ["patient_id"], ["ix", "iy", "iz"])
    for i, (f, n) in enumerate(zip(("fx", "fy", "fz"), size)):
        at = F.col(f"m{i}0") * F.col("ix") + F.col(f"m{i}1") * F.col("iy") + F.col(f"m{i}2") * F.col("iz") + F.col(f"o{i}")
        targets = targets.withColumn(f, clamp(at, 0.0, F.lit(n - 1).cast("double")))
    named = targets.select(*plan, "patient_id", F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("iz").alias("jz"), "fx", "fy", "fz")
    keys = [*plan, "patient_id", "jx", "jy", "jz"]
    corners = vx.corner_weights(named, keys).join(grid.select(*plan, *CELL, *linear), [*plan, *CELL])
    smooth = corners.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in linear])
    source = grid.select(*plan, *CELL, *nearest, (F.col(dose) > 0).cast("int").alias("_dosed"))
    at = named.select(*keys, *[F.floor(F.col(f) + 0.5).cast("long").alias(i) for f, i in zip(("fx", "fy", "fz"), ("ix", "iy", "iz"))])
    sharp = at.join(source, [*plan, *CELL]).select(*keys, *nearest, "_dosed")
    return smooth.join(sharp, keys).withColumn(dose, F.col(dose) * F.col("_dosed")).drop("_dosed")


def feature_channels(features: DataFrame, n_labels: int = 6) -> DataFrame:
    """Channels in model order: CT, open field, one-hot organs without background, target."""
    organs = [(F.col("label") == k).cast("long").alias(f"organ_{k}") for k in range(1, n_labels)]
    plan = [c for c in ("plan_id",) if c in features.columns]
    return features.select(*plan, *CELL, "ct_norm", "open_field_gy", *organs, "target")
