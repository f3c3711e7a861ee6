"""Work and shuffles that must not grow faster than the tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosefold.operators import arcs as ac
from dosefold.operators import evaluation as ev
from dosefold.operators import geometry as ge
from dosefold.operators import grids as vx
from dosefold.operators import matrix as im
from dosefold.sources import metadata as io


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exploded_targets_are_not_broadcast(spark):
    cells = [(1, x, y, z, float(x + y + z)) for x in range(6) for y in range(5) for z in range(3)]
    source = spark.createDataFrame(cells, "patient_id long, ix long, iy long, iz long, value double")
    coarse = vx.downsample_masked(source, source.filter("value > 3"), "value", (6, 5, 3), (3, 2, 2))
    assert optimized(coarse).count("strategy=merge") >= 3


def test_smoothed_curve_fills_the_bins_between_doses(spark):
    doses = [60.0] * 7 + [3.0]
    rows = [("S", "t", d) for d in doses] + [("S", "p", None), ("T", "t", -9.0)]
    df = spark.createDataFrame(rows, "structure string, side string, dose_gy double")
    got = {(r.structure, r.side, r.bin): r.volume_frac for r in ev.smoothed_dvh(df, ["structure", "side"], together=["structure"]).collect()}
    assert len(got) == 3 * 351
    for b in range(351):
        assert got["S", "t", b] == pytest.approx(np.mean(1 / (1 + np.exp(b - np.array(doses) / 0.2))), abs=1e-12)
        assert got["S", "p", b] == 0 and got["T", "t", b] == pytest.approx(1 / (1 + np.exp(b + 45)), abs=1e-12)


def arc_tables(spark):
    keys = [(p, q) for p in (1, 2) for q in "AB"]
    units = spark.createDataFrame([(p, q, b, float(p + b + (q == "A"))) for p, q in keys for b in range(3)], "patient_id long, plan_id string, beam_id long, mu double")
    cells = spark.createDataFrame([(q, i % 3, i, float(i * (2 if q == "A" else 3))) for q in "AB" for i in range(12)], "plan_id string, beam_id long, beamlet_id long, value double")
    return units, cells, units.join(cells, ["plan_id", "beam_id"])


def test_factored_weights_give_the_dose_of_whole_ones(spark):
    units, cells, whole = arc_tables(spark)
    points = units.select("patient_id", "plan_id", "beam_id", (F.col("beam_id") + 1.0).alias("angle_weight"))
    influence = spark.createDataFrame([(p, v, (v * 5 + j) % 12, float(v + j)) for p in (1, 2) for v in range(6) for j in range(3)], "patient_id long, voxel_id long, beamlet_id long, a double")
    delta = spark.createDataFrame([(p, v, float(v - p)) for p in (1, 2) for v in range(7)], "patient_id long, voxel_id long, delta_gy double")
    weights = whole.select("patient_id", "plan_id", "beam_id", "beamlet_id", (F.col("value") * F.col("mu")).alias("weight"))
    factored = ac.arc_dose(influence, cells.withColumnRenamed("value", "weight"), points, delta, alpha=0.5, factors=units.withColumnRenamed("mu", "factor"))
    want = ac.arc_dose(influence, weights, points, delta, alpha=0.5)
    found = {(r.patient_id, r.plan_id, r.voxel_id): r.dose_gy for r in factored.collect()}
    assert found == {(r.patient_id, r.plan_id, r.voxel_id): pytest.approx(r.dose_gy) for r in want.collect()}


def test_openness_takes_units_that_the_weights_carry(spark):
    units, _, whole = arc_tables(spark)
    weights = whole.select("patient_id", "plan_id", "beam_id", "beamlet_id", "mu", (F.col("value") / 9).alias("weight"))
    carried = ac.openness(weights).select("patient_id", "plan_id", "beamlet_id", "open")
    joined = ac.openness(weights.drop("mu"), units).select(*carried.columns)
    assert sorted(map(tuple, carried.collect())) == sorted(map(tuple, joined.collect()))


def test_rays_in_windows_are_all_that_meet_the_mask(spark):
    beams = ge.with_rotation(spark.createDataFrame(
        [(p, b, 40.0 * b, 15.0 * (b % 2), 10.0 * b, 1.0 * p, -2.0, 3.0) for p in (1, 2) for b in range(5)],
        "patient_id long, beam_id long, gantry_angle double, couch_angle double, collimator_angle double, iso_x double, iso_y double, iso_z double"))
    beamlets = spark.createDataFrame([(b, i, (i % 12) * 6.0 - 33.0, (i // 12) * 6.0 - 33.0) for b in range(5) for i in range(480)], "beam_id long, beamlet_id long, x_mm double, y_mm double")
    mask = spark.createDataFrame([(1, x, y, z) for x in range(8) for y in range(6) for z in range(3)], "patient_id long, ix long, iy long, iz long")
    place = {"origin": (-12.0, -9.0, -2.0), "spacing": (3.0, 3.0, 4.0)}
    every = ge.source_and_beamlet_points(ge.beam_windows(beams, mask, **place), beamlets)
    near = ge.points_in_windows(ge.beam_windows(beams, mask, **place), beamlets)
    n = near.count()
    assert 0 < n < every.count() / 8 and every.filter(~ge.in_window()).count() == every.count() - n
    marched = [sorted(map(tuple, ge.ray_march(r, mask, **place).collect())) for r in (every, near)]
    assert marched[0] == marched[1] and len(marched[0]) > 20


def test_near_pairs_of_a_wide_beam(spark):
    """A far beamlet widens no voxel's search: the cells met don't hold more pairs than the close beamlets give."""
    framed = spark.createDataFrame([(1, 0, i, 2.0 * i - 9, 1.0 * i, 3.0 * i - 9) for i in range(10)], "patient_id long, beam_id long, voxel_id long, xp double, yp double, zp double")
    grid = [(0, i, (i % 20) * 2.5 - 25, (i // 20) * 2.5 - 25) for i in range(400)]
    close = ge.near_ray_pairs(framed, spark.createDataFrame(grid, "beam_id long, beamlet_id long, x_mm double, y_mm double"), 4.2)
    wide = ge.near_ray_pairs(framed, spark.createDataFrame([*grid, (0, 999, 1e8, 1e8)], "beam_id long, beamlet_id long, x_mm double, y_mm double"), 4.2)
    assert sorted((r.voxel_id, r.beamlet_id) for r in close.collect()) == sorted((r.voxel_id, r.beamlet_id) for r in wide.collect())


def test_transfer_joins_no_beam_as_a_whole(spark):
    fluence = spark.createDataFrame([("A", 1, 2.0)], "plan_id string, beamlet_id long, intensity double")
    coarse = spark.createDataFrame([(0, 1, 0, 0), (0, 1, 0, 1)], "beam_id long, beamlet_id long, row long, col long")
    fine = spark.createDataFrame([(0, 7, 0, 0), (0, 8, 0, 1)], "beam_id long, beamlet_id long, row long, col long")
    moved = im.fluence_transfer(fluence, coarse, fine)
    assert "LeftSemi" not in optimized(moved)
    assert sorted((r.beamlet_id, r.intensity) for r in moved.collect()) == [(7, 2.0), (8, 2.0)]
    with pytest.raises(Exception, match="coarser"):
        im.fluence_transfer(fluence, fine, coarse).collect()


def test_a_patients_beam_is_one_file(spark, tmp_path):
    rows = [(p, b, v, 3, 1.0, "full") for p in (1, 2) for b in range(2) for v in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many tasks as large tables get
    io.save_matrix(spark.createDataFrame(rows, "patient_id long, beam_id long, voxel_id long, beamlet_id long, a double, variant string"), str(tmp_path / "m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = [f for _, _, names in os.walk(tmp_path / "m") for f in names if f.endswith(".parquet")]
    assert len(files) == 4
    assert io.load_matrix(spark, str(tmp_path / "m"), True).count() == len(rows)


def test_descent_leaves_parquet_and_no_row_checkpoints(spark, tmp_path, monkeypatch):
    from dosefold import session
    from dosefold.plans import load_all

    def refused(df):
        raise AssertionError("rows were checkpointed")

    monkeypatch.setattr(session, "cut_lineage", refused)
    monkeypatch.setattr(session, "scratch_folder", lambda *_: str(tmp_path))
    assert load_all()[0]["fluence_descent"](spark, "/root/testdata/sf0.001").count() > 0
    dose = spark.read.parquet(f"{tmp_path}/dose2")
    assert set(dose.columns) == {"patient_id", "plan_id", "structure", "voxel_id", "dose"}
    size = sum(os.path.getsize(os.path.join(folder, f)) for folder, _, files in os.walk(tmp_path) for f in files)
    matrix = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert size < 150 * matrix


def test_ranking_shuffles_its_rows_once_and_equals_a_window(spark, monkeypatch):
    from dosefold.functions import prefix

    draws = np.random.default_rng(5)
    doses = np.concatenate([np.zeros(900), draws.random(700) * 60, np.full(500, 7.5), np.full(400, 60.0), draws.random(200) * 1e-3])
    rows = [(1, "BODY", int(v), float(d), float(v % 7 + 1)) for v, d in enumerate(draws.permutation(doses))]
    rows += [(p, "PTV", v, float(v * 3 % 11), 2.0) for p in (1, 2) for v in range(40)]
    df = spark.createDataFrame(rows, "patient_id long, structure string, voxel_id long, dose_gy double, weight double")
    keys, want = ["patient_id", "structure"], {}
    for p, s in {r[:2] for r in rows}:
        below = 0.0
        group = sorted((r for r in rows if r[:2] == (p, s)), key=lambda r: (r[3], r[2]))
        for r in group:
            want[r[:3]] = (below, sum(g[4] for g in group), group[-1][3])
            below += r[4]
    for large, chunk in ((10**6, 65536), (300, 128), (50, 64)):
        monkeypatch.setattr(prefix, "GROUP_ROWS", large)
        monkeypatch.setattr(prefix, "VOXEL_CHUNK", chunk)
        ranked = prefix.ordered_by_dose(df, keys)
        found = ranked.collect()
        assert len(found) == len(rows)
        assert {(r.patient_id, r.structure, r.voxel_id): (r.below, r.total, r.top) for r in found} == want
    plan = optimized(prefix.ordered_by_dose(df, keys))
    joins = [line for line in plan.splitlines() if " Join " in line or line.startswith("Join ")]
    assert joins and all("strategy=broadcast" in line for line in joins)


def test_matrix_is_dealt_by_the_rows_of_the_table(spark, monkeypatch):
    from dosefold.sources import star_schema

    monkeypatch.setattr(star_schema, "TASK_ROWS", 200)
    tables = star_schema.StarSchema(spark, "/root/testdata/sf0.001")
    rows = tables.table("lineitem").count()
    for df in (tables.influence, tables.own_beamlet):
        assert df.rdd.getNumPartitions() == -(-rows // 200)
    pairs = tables.influence.select("patient_id", "beamlet_id").distinct()
    assert sorted(pairs.collect()) == sorted(tables.own_beamlet.collect())
    sums = tables.table("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("a"))
    assert tables.influence.count() == sums.count()
    assert tables.influence.agg(F.sum("a")).first() == sums.agg(F.sum("a")).first()


def test_scores_make_the_gradient_once(spark):
    from dosefold.operators import objectives as ob

    grad = spark.createDataFrame([(p, "A", b, float(b - 3 * p)) for p in (1, 2) for b in range(5)] + [(3, "A", 0, 0.0)], "patient_id long, plan_id string, beamlet_id long, gradient double")
    scored = ob.scaled_scores(grad)
    found = {(r.patient_id, r.beamlet_id): r.score for r in scored.collect()}
    assert found == {**{(p, b): (b - 3 * p) / {1: 3, 2: 6}[p] for p in (1, 2) for b in range(5)}, (3, 0): None}
    assert "Join" not in optimized(scored)


def test_files_of_solutions_do_not_grow_with_the_patients(spark, tmp_path):
    rows = [(p, plan, b, float(p + b)) for p in range(120) for plan in "AB" for b in range(3)]
    io.save_solution(spark.createDataFrame(rows, "patient_id long, plan_id string, beamlet_id long, intensity double"), str(tmp_path / "s"))
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert 2 <= len(files) <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = io.load_solution(spark, str(tmp_path / "s"), "A", 7)
    assert sorted((r.patient_id, r.plan_id, r.beamlet_id, r.intensity) for r in one.collect()) == [r for r in rows if r[0] == 7 and r[1] == "A"]
    assert io.load_solution(spark, str(tmp_path / "s")).count() == len(rows)
