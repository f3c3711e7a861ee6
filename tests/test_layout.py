"""Plans that must not shuffle their large side."""

import re

import pytest
from pyspark.sql import functions as F

from dosefold.functions.salted import salted_join
from dosefold.operators import geometry as ge
from dosefold.operators import matrix as im
from dosefold.operators import objectives as ob
from dosefold.sources import metadata as io

ALONE = re.compile(r"hashpartitioning\(patient_id#\d+L, \d+\)")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def level(line):
    return len(line) - len(line.lstrip(" :+-|"))


def above(plan, mark):
    """The nodes over the scan that `mark` tells, nearest first."""
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if mark in line)
    depth, out = level(lines[at]), []
    for line in reversed(lines[:at]):
        if level(line) < depth:
            depth = level(line)
            out.append(line)
    return out


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def matrix(spark):
    rows = [(p, v, b, 1.0 + v * b) for p in (1, 2) for v in range(40) for b in range(9)]
    return spark.createDataFrame(rows, "patient_id long, voxel_id long, beamlet_id long, a double")


def test_products_with_a_stored_matrix_do_not_shuffle_it(spark, tmp_path, no_broadcast):
    plain = matrix(spark)
    stored = io.save_matrix_by_voxel(plain, str(tmp_path / "matrix"), 4)
    fluence = spark.createDataFrame([(p, b, float(b)) for p in "AB" for b in range(9)], "plan_id string, beamlet_id long, intensity double")
    dose = im.dose_from_fluence(stored, F.broadcast(fluence))
    assert not [line for line in above(plan_of(dose), "FileScan") if "Exchange" in line], plan_of(dose)
    assert sorted(map(tuple, dose.collect())) == sorted(map(tuple, im.dose_from_fluence(plain, fluence).collect()))
    residual = spark.createDataFrame([(p, "A", v, 0.5 * v) for p in (1, 2) for v in range(40)], "patient_id long, plan_id string, voxel_id long, residual double")
    found = ob.gradient(stored, residual)
    nodes = above(plan_of(found), "FileScan")
    join = next(i for i, line in enumerate(nodes) if "Join" in line)
    assert not [line for line in nodes[:join] if "Exchange" in line], plan_of(found)
    want = {tuple(r)[:3]: r.gradient for r in ob.gradient(plain, residual).collect()}
    assert {tuple(r)[:3]: pytest.approx(r.gradient) for r in found.collect()} == want


def test_patient_scalars_do_not_shuffle_by_patient_alone(spark, no_broadcast):
    a = matrix(spark)
    voxels = a.select("patient_id", "voxel_id").distinct()
    beams = spark.createDataFrame(
        [(p, b, 30.0 * b, 0.0, 0.0, 0.0, 0.0, 0.0) for p in (1, 2) for b in range(3)],
        "patient_id long, beam_id long, gantry_angle double, collimator_angle double, couch_angle double, iso_x double, iso_y double, iso_z double")
    placed = voxels.selectExpr("patient_id", "voxel_id", "voxel_id * 1D AS vx", "0D AS vy", "1D AS vz")
    framed = ge.beam_frame(placed, ge.with_rotation(beams))
    assert not ALONE.search(plan_of(framed)) and framed.count() == 2 * 40 * 3
    for found in (im.sparsify_threshold(a, 10.0), im.open_field_dose(a, voxels, 60.0)):
        lines = plan_of(found).splitlines()
        # only the few partial maxima and minima of the patients are dealt by patient
        for i, line in enumerate(lines):
            if ALONE.search(line):
                assert "partial_m" in lines[i + 1], plan_of(found)
    kept = im.sparsify_threshold(a, 50.0).groupBy("patient_id").count().collect()
    top = {p: max(1.0 + v * b for v in range(40) for b in range(9)) for p in (1, 2)}
    assert {r.patient_id: r["count"] for r in kept} == {p: sum(1.0 + v * b >= 0.5 * top[p] for v in range(40) for b in range(9)) for p in (1, 2)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, how):
    large = spark.createDataFrame([(k, i) for k in (1, 1, 1, 2, 3, None) for i in range(30)], "k long, i long")
    small = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (9, "d")], "k long, name string")
    got = salted_join(large, small, ["k"], ["i"], how)
    assert sorted(map(str, got.collect())) == sorted(map(str, large.join(small, "k", how).collect()))
