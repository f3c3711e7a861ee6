"""Curve, matrix, objective and geometry rules on hand-sized inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosefold.functions.prefix import exact_quantiles, running_before
from dosefold.operators import arcs as ac
from dosefold.operators import criteria as cr
from dosefold.operators import evaluation as ev
from dosefold.operators import geometry as ge
from dosefold.operators import grids as vx
from dosefold.operators import matrix as im
from dosefold.operators import objectives as ob

SD = "patient_id long, plan_id string, structure string, voxel_id long, dose_gy double, weight double"
ST = "patient_id long, structure string, volume_cc double, frac_in_box double"


def tables(spark, doses, weights, frac=1.0):
    sd = spark.createDataFrame([(1, "A", "S", i, d, w) for i, (d, w) in enumerate(zip(doses, weights))], SD)
    return sd, spark.createDataFrame([(1, "S", sum(weights), frac)], ST)


def curve(doses, weights, frac):
    order = sorted(range(len(doses)), key=lambda i: (doses[i], i))
    x = [doses[i] for i in order] + [max(doses) + 0.01]
    y = [frac]
    for i in order:
        y.append(y[-1] - weights[i] / sum(weights) * frac)
    y[-1] = 0.0
    return x, y


def test_dvh_points_and_properties(spark):
    rng = np.random.default_rng(1)
    doses = [float(d) for d in rng.integers(0, 12, 60)] + [0.0] * 40
    weights = [float(w) for w in rng.integers(1, 9, 100)]
    sd, struct = tables(spark, doses, weights, 0.8)
    points = sorted((r.x, -r.y) for r in ev.dvh(sd, struct).collect())
    x, y = curve(doses, weights, 0.8)
    assert len(points) == 101
    assert np.allclose(sorted(p[0] for p in points), x)
    assert np.allclose(sorted((-p[1] for p in points), reverse=True), y)


@pytest.mark.parametrize("v", [0.0, 1.0, 37.0, 50.0, 79.9, 80.0, 80.1, 95.0, 100.2])
def test_dose_at_volume_matches_interpolation(spark, v):
    rng = np.random.default_rng(2)
    doses = [float(d) for d in rng.integers(0, 15, 50)]
    weights = [float(w) for w in rng.integers(1, 9, 50)]
    sd, struct = tables(spark, doses, weights, 0.8)
    x, y = curve(doses, weights, 0.8)
    got = ev.dose_at_volume(sd, struct, [v]).first().dose_at_volume_gy
    want = 0.0 if v > 80.0 else float(np.interp(v, [100 * b for b in y][::-1], x[::-1]))
    assert got == pytest.approx(want, abs=1e-9)


def test_volume_at_dose_edges(spark):
    sd, struct = tables(spark, [1.0, 2.0, 2.0, 4.0], [1.0, 1.0, 1.0, 1.0], 0.5)
    got = {r.at_dose_gy: r.volume_at_dose_perc for r in ev.volume_at_dose(sd, struct, [0.5, 1, 1.5, 2, 3, 4, 4.01, 9]).collect()}
    assert got[0.5] == pytest.approx(50.0) and got[1] == pytest.approx(50.0)
    assert got[1.5] == pytest.approx((50 + 37.5) / 2) and got[2] == pytest.approx(37.5)
    assert got[3] == pytest.approx((37.5 + 12.5) / 2) and got[4] == pytest.approx(12.5)
    assert got[4.01] == pytest.approx(0.0, abs=1e-9) and got[9] == 0.0


def test_curve_metrics_agree_with_single_operators(spark):
    rng = np.random.default_rng(4)
    sd, struct = tables(spark, [float(d) for d in rng.random(80) * 30], [float(w) for w in rng.integers(1, 5, 80)], 0.9)
    asked = spark.createDataFrame([("S", "D", 33.0), ("S", "V", 12.5), ("S", "max", 0.0), ("S", "mean", 0.0)], "structure string, metric string, value double")
    got = {r.metric: r.raw for r in ev.curve_metrics(sd, struct, asked).collect()}
    stats = ev.dose_statistics(sd, struct).first()
    assert got["max"] == stats.max_dose_gy and got["mean"] == pytest.approx(stats.mean_dose_gy)
    assert got["D"] == pytest.approx(ev.dose_at_volume(sd, struct, [33.0]).first().dose_at_volume_gy)
    assert got["V"] == pytest.approx(ev.volume_at_dose(sd, struct, [12.5]).first().volume_at_dose_perc)


def test_empty_structure_gives_origin_point(spark):
    sd, _ = tables(spark, [1.0], [1.0])
    struct = spark.createDataFrame([(1, "A", "S", 1.0, 1.0), (1, "A", "E", 1.0, 0.0)], "patient_id long, plan_id string, structure string, volume_cc double, frac_in_box double")
    empty = [r for r in ev.dvh(sd, struct).collect() if r.structure == "E"]
    assert [(r.x, r.y) for r in empty] == [(0.0, 0.0)]


def test_tail_takes_at_least_one_voxel(spark):
    sd, struct = tables(spark, [1.0, 5.0, 9.0], [1.0, 1.0, 1.0])
    asked = spark.createDataFrame([("u", "S", 1.0, "upper"), ("l", "S", 99.0, "lower"), ("h", "S", 70.0, "upper")], "request_id string, structure string, volume_perc double, bound_type string")
    got = {r.request_id: r.tail_mean_gy for r in ev.tail_mean(sd, struct, asked).collect()}
    assert got == {"u": 9.0, "l": 1.0, "h": 7.0}


def test_running_sum_and_quantiles_over_buckets(spark):
    rng = np.random.default_rng(6)
    values = [float(v) for v in rng.integers(0, 40, 500)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i long, v double")
    got = {r.i: r.before for r in running_before(df, ["g"], F.floor(F.col("i") / 50), ["i"], "v", "before").collect()}
    want = np.concatenate([[0.0], np.cumsum(values)[:-1]])
    assert all(got[i] == want[i] for i in range(500))
    row = exact_quantiles(df, ["g"], "v", {"a": 0.02, "b": 0.5, "c": 0.975}).first()
    assert np.allclose([row.a, row.b, row.c], np.quantile(values, [0.02, 0.5, 0.975]))


def matrix(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 5, (20, 6)).astype(float)
    rows = [(1, v, b, float(a[v, b])) for v in range(20) for b in range(6) if a[v, b]]
    return a, spark.createDataFrame(rows, "patient_id long, voxel_id long, beamlet_id long, a double")


def test_dose_is_linear_and_complete(spark):
    a, influence = matrix(spark)
    voxels = spark.createDataFrame([(1, v) for v in range(22)], "patient_id long, voxel_id long")
    x = {"P": [1.0, 2, 3, 0, 0, 1], "Q": [0.5, 0, 0, 2, 1, 0]}
    x["R"] = [p + q for p, q in zip(x["P"], x["Q"])]
    fluence = spark.createDataFrame([(p, b, float(v)) for p, xs in x.items() for b, v in enumerate(xs)], "plan_id string, beamlet_id long, intensity double")
    got = {(r.plan_id, r.voxel_id): r.dose_gy for r in im.dose_from_fluence(influence, fluence, voxels, list(x)).collect()}
    assert len(got) == 66 and got[("P", 21)] == 0.0
    for p, xs in x.items():
        assert np.allclose([got[(p, v)] for v in range(20)], a @ np.array(xs))
    assert all(got[("R", v)] == pytest.approx(got[("P", v)] + got[("Q", v)]) for v in range(22))


def test_randomised_sparsify_keeps_row_sums_and_repeats(spark):
    a, influence = matrix(spark)
    thin = im.sparsify_randomised(influence, 2.0, seed=3)
    first, again = ({(r.voxel_id, r.beamlet_id): r.a for r in thin.collect()} for _ in range(2))
    assert first == again
    sums = {}
    for (v, _), value in first.items():
        sums[v] = sums.get(v, 0.0) + value
    assert all(sums.get(v, 0.0) == pytest.approx(a[v].sum()) for v in range(20))


def test_gradient_equals_finite_difference(spark):
    a, influence = matrix(spark)
    sd = spark.createDataFrame([(1, "A", "S", v, float(a[v].sum()) / 7, 1.0) for v in range(20)], SD).withColumnRenamed("dose_gy", "dose")
    objectives = spark.createDataFrame([(1, "quadratic-overdose", "S", 3.0, 1.1), (2, "quadratic-underdose", "S", 5.0, 1.9), (3, "quadratic", "S", 0.5, 0.0)],
                                       "objective_id long, type string, structure string, weight_factor double, target double")
    grad = {r.beamlet_id: r.gradient for r in ob.gradient(influence, ob.voxel_residual(sd, objectives)).collect()}
    none = spark.createDataFrame([], "beamlet_id long")
    near = {r.beamlet_id: r.score for r in ob.finite_difference(influence, sd, objectives, none, 1e-6).collect()}
    assert all(near[b] == pytest.approx(grad[b], rel=1e-4) for b in grad)


ANGLES = [(g, c, t) for g in (0, 33, 178, 251) for c in (0, 17) for t in (0, 115)]


def test_rotations_are_proper_and_keep_the_source_distance(spark):
    beams = spark.createDataFrame([(i, float(g), float(c), float(t), 5.0, -3.0, 2.0) for i, (g, c, t) in enumerate(ANGLES)],
                                  "beam_id long, gantry_angle double, couch_angle double, collimator_angle double, iso_x double, iso_y double, iso_z double")
    beamlets = spark.createDataFrame([(i, 0, 12.5, -7.5) for i in range(len(ANGLES))], "beam_id long, beamlet_id long, x_mm double, y_mm double")
    for r in ge.source_and_beamlet_points(ge.with_rotation(beams), beamlets).collect():
        m = np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(m @ m.T, np.eye(3)) and np.linalg.det(m) == pytest.approx(1.0)
        source, target, iso = (np.array(p) for p in ([r.source_x, r.source_y, r.source_z], [r.target_x, r.target_y, r.target_z], [5.0, -3.0, 2.0]))
        assert np.linalg.norm(source - iso) == pytest.approx(1000.0)
        assert np.allclose((target - iso) @ m, [12.5, 0.0, -7.5])


def test_near_ray_pairs_find_every_close_pair(spark):
    rng = np.random.default_rng(9)
    voxels = [(1, 0, i, *[float(v) for v in p]) for i, p in enumerate(rng.uniform(-40, 40, (120, 3)))]
    framed = spark.createDataFrame(voxels, "patient_id long, beam_id long, voxel_id long, xp double, yp double, zp double")
    grid = [(0, r * 20 + c, c * 2.5 - 25, r * 2.5 - 25) for r in range(20) for c in range(20)]
    beamlets = spark.createDataFrame(grid, "beam_id long, beamlet_id long, x_mm double, y_mm double")
    got = {(r.voxel_id, r.beamlet_id) for r in ge.near_ray_pairs(framed, beamlets, 4.2).collect()}
    want = set()
    for _, _, v, x, y, z in voxels:
        for _, b, bx, by in grid:
            u = np.array([bx, 1000.0, by]) / math.sqrt(bx * bx + 1e6 + by * by)
            p = np.array([x, y + 1000.0, z])
            if np.linalg.norm(p - (p @ u) * u) <= 4.2:
                want.add((v, b))
    assert got == want


def test_interpolation_is_exact_on_ramps_and_defaults_outside(spark):
    origin, spacing, size = (4.0, -7.0, 1.0), (1.5, 3.0, 2.25), (9, 7, 11)
    place = lambda i: [o + s * k for o, s, k in zip(origin, spacing, i)]
    source = [(1, x, y, z, float(np.dot([4, -1, 2.5], place((x, y, z))))) for x in range(size[0]) for y in range(size[1]) for z in range(size[2])]
    grid = spark.createDataFrame(source, "patient_id long, ix long, iy long, iz long, value double")
    asked = [(1, 0, 5.1, -2.2, 9.9), (1, 1, 16.0, 11.0, 23.5), (1, 2, 7.0, -1.0, 3.25), (1, 3, -500.0, 0.0, 0.0)]
    targets = vx.fractional_index(spark.createDataFrame(asked, "patient_id long, t long, x_mm double, y_mm double, z_mm double"), origin, spacing)
    got = {r.t: r.value for r in vx.resample_linear(targets, grid, ["patient_id", "t"], "value", -7.0).collect()}
    for _, t, x, y, z in asked[:3]:
        assert got[t] == pytest.approx(4 * x - y + 2.5 * z)
    assert got[3] == -7.0


def test_bounds_are_parsed_and_never_evaluated(spark):
    texts = ["66", "1.1*prescription_gy", "prescription_gy", "-3", "N/A", "", "__import__('os')", "prescription_gy - 2"]
    df = spark.createDataFrame([(t,) for t in texts], "bound_value string")
    got = [r.v for r in df.select(cr.number_or_formula(F.col("bound_value"), 60.0).alias("v")).collect()]
    assert got == [66.0, pytest.approx(66.0), 60.0, -3.0, None, None, None, None]


def test_score_points_clamp_and_keep_null(spark):
    df = spark.createDataFrame([(v, [(20.0, 8.0), (0.0, 10.0), (37.0, 0.0)]) for v in (-1.0, 0.0, 10.0, 20.0, 30.0, 99.0, None)],
                               "v double, points array<struct<x: double, score: double>>")
    got = [r.s for r in df.select(cr.interpolate_score(F.col("v"), F.col("points")).alias("s")).collect()]
    assert got[:3] == [10.0, 10.0, 9.0] and got[3] == 8.0 and got[4] == pytest.approx(8 - 8 * 10 / 17) and got[5:] == [0.0, None]


def test_packing_pushes_fractions_to_the_interior(spark):
    opened = spark.createDataFrame([(0, 0, c, c, v) for c, v in enumerate([0.25, 0.5, 0.75, 1.0, 0.5, 0.25])],
                                   "beam_id long, row long, col long, beamlet_id long, open double")
    kinds = spark.createDataFrame([(0, c, k) for c, k in enumerate(["left", "left", "left", "interior", "right", "right"])],
                                  "beam_id long, beamlet_id long, kind string")
    got = [r.actual for r in ac.pack_openness(opened, kinds).orderBy("col").collect()]
    assert got == [0.0, 0.5, 1.0, 1.0, 0.75, 0.0]


def test_overlapping_partial_rows_are_dropped(spark):
    rows = {0: [1, 1, 2, 2], 1: [1, 1, None, None], 2: [3, 3, 4, 4], 3: [3, 3, 4, 4]}
    cells = spark.createDataFrame([(0, r, c, b) for r, line in rows.items() for c, b in enumerate(line) if b], "beam_id long, row long, col long, beamlet_id long")
    got = {(r.row, r.col): r.beamlet_id for r in im.compact_grid(cells).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): 4}


def test_smoothed_curve_equals_the_mean_of_all_sigmoids(spark):
    draws = np.random.default_rng(9)
    doses = np.concatenate([draws.random(300) * 80 - 2, np.zeros(50), np.full(20, 0.2 * 7), [69.9999, 70.0, 1e6, -50.0], np.arange(0, 71, 5.0)])
    rows = [("S", float(d)) for d in doses] + [("T", 3.1), ("T", None)]
    got = {(r.structure, r.bin): r for r in ev.smoothed_dvh(spark.createDataFrame(rows, "structure string, dose_gy double"), ["structure"]).collect()}
    assert len(got) == 2 * 351
    width = 70.0 / 350
    with np.errstate(over="ignore"):
        for b in range(351):
            assert abs(got["S", b].volume_frac - np.mean(1 / (1 + np.exp(-(doses - b * width) / width)))) < 1e-12
            assert abs(got["T", b].volume_frac - 0.5 / (1 + np.exp(-(3.1 - b * width) / width))) < 1e-12
            assert abs(got["S", b].bin_gy - b * width) < 1e-12
    plan = ev.smoothed_dvh(spark.createDataFrame(rows, "structure string, dose_gy double"), ["structure"])._jdf.queryExecution().optimizedPlan().toString()
    before_fold = plan[plan.rindex("Aggregate [structure"):]
    assert "explode" not in before_fold and "inline" not in before_fold


@pytest.mark.parametrize("shape", ["below one Gy", "mostly cold", "one value"])
def test_even_buckets_follow_the_data(spark, shape):
    from dosefold.functions import prefix

    draws = np.random.default_rng(12)
    doses = {"below one Gy": draws.random(40_000) * 0.9, "mostly cold": np.concatenate([draws.random(39_000) ** 3 * 0.01, draws.random(1000) * 70]), "one value": np.full(3000, 2.5)}[shape]
    df = spark.createDataFrame([("BODY", float(d)) for d in doses] + [("SMALL", float(d)) for d in range(50)], "structure string, dose_gy double")
    got = prefix.even_buckets(df, ["structure"], "dose_gy", large=1000).collect()
    assert len(got) == len(doses) + 50 and {r.even for r in got if r.structure == "SMALL"} == {0}
    body = sorted((r.dose_gy, r.even) for r in got if r.structure == "BODY")
    assert all(a[1] <= b[1] or a[0] == b[0] for a, b in zip(body, body[1:]))
    sizes = np.unique([e for _, e in body], return_counts=True)[1]
    if shape == "below one Gy":
        assert len(sizes) > 100 and sizes.max() <= 2 * sizes.mean()
    if shape == "mostly cold":
        assert sizes.max() < len(doses) / 2  # equal steps of the first cell, where the cube root crowds
    before = prefix.GROUP_ROWS
    try:
        found = []
        for prefix.GROUP_ROWS in (500, 10**9):
            curve = prefix.weight_curve(df.distinct().withColumn("weight", F.lit(1.0)).withColumn("voxel_id", F.lit(0)), ["structure"])
            found.append(sorted((r.structure, r.dose_gy, r.below, r.total) for r in curve.collect()))
        assert found[0] == found[1]
    finally:
        prefix.GROUP_ROWS = before
