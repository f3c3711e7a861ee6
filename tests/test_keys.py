"""Several patients and plans in one call give what each gives alone; and the rules about limits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosefold.functions import headers as hd
from dosefold.functions.numeric import scan_code
from dosefold.operators import arcs as ac
from dosefold.operators import evaluation as ev
from dosefold.operators import matrix as im
from dosefold.operators import structures as st

KEYS = "patient_id long, plan_id string, "


def keyed(spark, schema, rows):
    """`rows(patient, plan)` for two patients and plans, as one table with keys."""
    data = [(p, q, *r) for p in (1, 2) for q in ("A", "B") for r in rows(p, q)]
    return spark.createDataFrame(data, KEYS + schema)


def test_arc_operators_keep_patients_and_plans_apart(spark):
    scale = lambda p, q: p + (3 if q == "B" else 0)
    points = keyed(spark, "arc_id long, position long, beam_id long, angle_weight double", lambda p, q: [(a, i, 2 * a + i, 1.0 + i * p) for a in (1, 2) for i in (0, 1)])
    units = keyed(spark, "beam_id long, mu double", lambda p, q: [(b, float(b * scale(p, q))) for b in range(2, 6)])
    leaves = keyed(spark, "beam_id long, row long, left long, right long", lambda p, q: [(b, r, r * p, 9 + b + scale(p, q)) for b in range(2, 6) for r in (0, 1, 2)])
    calls = {
        "units": lambda x, u, l: ac.mu_similarity(x, u),
        "meterset": lambda x, u, l: ac.meterset(x, u),
        "balance": lambda x, u, l: ac.arc_mu_balance(x, u),
        "regular": lambda x, u, l: ac.aperture_regularity(l),
        "similar": lambda x, u, l: ac.aperture_similarity(l, x.drop("angle_weight")),
    }
    for name, call in calls.items():
        whole = sorted(map(str, call(points, units, leaves).collect()))
        parts = []
        for p in (1, 2):
            for q in ("A", "B"):
                own = [t.filter((F.col("patient_id") == p) & (F.col("plan_id") == q)) for t in (points, units, leaves)]
                parts += map(str, call(*own).collect())
        assert whole == sorted(parts), name
    with pytest.raises(ValueError):
        ac.mu_similarity(points, units.drop("plan_id"))


def test_arc_dose_uses_own_weights(spark):
    influence = spark.createDataFrame([(1, 0, 7, 1.0), (2, 0, 7, 1.0)], "patient_id long, voxel_id long, beamlet_id long, a double")
    points = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "patient_id long, beam_id long, angle_weight double")
    weights = spark.createDataFrame([(1, 7, 0, 2.0), (2, 7, 0, 5.0)], "patient_id long, beamlet_id long, beam_id long, weight double")
    delta = spark.createDataFrame([(1, 0, 1.0), (2, 0, 1.0)], "patient_id long, voxel_id long, delta_gy double")
    got = {r.patient_id: r.dose_gy for r in ac.arc_dose(influence, weights, points, delta, alpha=0.5).collect()}
    assert got == {1: 3.0, 2: 7.5}
    plan = ac.arc_mu_balance(points.withColumn("arc_id", F.lit(1)), points.select("patient_id", "beam_id", F.lit(1.0).alias("mu")))
    assert "SinglePartition" not in plan._jdf.queryExecution().executedPlan().toString()


def grid_headers(spark, spacings, size):
    three = lambda v: tuple(map(float, v))
    schema = "patient_id long, origin struct<x:double,y:double,z:double>, spacing struct<x:double,y:double,z:double>, size struct<x:int,y:int,z:int>"
    return spark.createDataFrame([(p, three((p, -p, 2 * p)), three(s), size) for p, s in spacings.items()], schema)


@pytest.mark.parametrize("margin", [2.5, 40.0])
def test_margins_follow_each_patient_s_grid(spark, margin):
    draw, size = random.Random(3), (14, 12, 6)
    spacings = {1: (1.0, 1.0, 3.0), 2: (2.5, 2.5, 2.5), 3: (0.5, 0.5, 5.0)}
    cells = [(p, draw.randrange(14), draw.randrange(12), draw.randrange(6)) for p in spacings for _ in range(6)]
    cells += [(p, x, y, z) for p in spacings for x in range(2, 12) for y in range(2, 11) for z in range(0, 5)]
    mask = spark.createDataFrame(cells, "patient_id long, ix long, iy long, iz long").distinct()
    headers = grid_headers(spark, spacings, size)
    grown, shrunk = hd.expand(mask, margin, headers), hd.shrink(mask, margin, headers)
    for p, s in spacings.items():
        own = mask.filter(F.col("patient_id") == p)
        alone = lambda df: sorted(map(tuple, df.filter(F.col("patient_id") == p).select("ix", "iy", "iz").collect()))
        assert alone(grown) == alone(st.expand(own, margin, s, size))
        assert alone(shrunk) == alone(st.shrink(own, margin, s, size))


def test_endless_margin_is_the_grid_of_patients_with_a_mask(spark):
    structures = spark.createDataFrame([(1, "A", 3, 3, 1), (1, "B", 0, 0, 0), (2, "B", 1, 1, 1)], "patient_id long, structure string, ix long, iy long, iz long")
    df = st.evaluate_expression(structures, "A + inf - A", (1.0, 1.0, 3.0), (9, 9, 3))
    rows = df.collect()
    assert len(rows) == 9 * 9 * 3 - 1 and {r.patient_id for r in rows} == {1}
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") < 10
    assert st.evaluate_expression(structures, "A - inf", (1.0, 1.0, 3.0), (9, 9, 3)).count() == 0


def test_definitions_use_earlier_ones_and_second_tries(spark):
    cells = [(p, s, x, 4, 1) for p in (1, 2) for s, n in (("A", 2), ("BODY", 9)) for x in range(n)] + [(2, "ONLY", 5, 4, 1)]
    structures = spark.createDataFrame(cells, "patient_id long, structure string, ix long, iy long, iz long")
    made = st.optimization_structures(structures, [("R1", "A + 1"), ("R2", "R1 - A"), ("X", "ONLY"), ("X", "A"), ("R3", "R9 + 1")], (1.0, 1.0, 3.0), (9, 9, 3))
    got = sorted((r.structure, r.patient_id, r.ix) for r in made.collect())
    assert [(p, x) for s, p, x in got if s == "R2"] == [(1, 2), (2, 2)]
    assert [(p, x) for s, p, x in got if s == "X"] == [(1, 0), (1, 1), (2, 5)]


def test_regions_of_a_long_snake_settle(spark):
    cells, x, y = [], 0, 0
    for turn in range(40):
        row = range(12) if turn % 2 == 0 else range(11, -1, -1)
        cells += [(1, "S", i, 2 * turn, 0) for i in row]
        cells.append((1, "S", 11 if turn % 2 == 0 else 0, 2 * turn + 1, 0))
    cells += [(1, "S", 30, 0, 0), (1, "S", 30, 1, 0), (2, "S", 0, 0, 0)]
    got = st.connected_regions(spark.createDataFrame(cells, "patient_id long, structure string, ix long, iy long, iz long")).collect()
    assert len(got) == len(cells)
    assert {(r.patient_id, r.region) for r in got if r.ix == 30 or r.patient_id == 2} == {(1, 2), (2, 1)}
    assert {r.region for r in got if r.patient_id == 1 and r.ix < 12} == {1}


def test_scan_code_refuses_other_indices(spark):
    df = spark.createDataFrame([(2**20,)], "i long")
    with pytest.raises(Exception, match="grid index"):
        df.select(scan_code(F.col("i"), F.col("i"))).collect()


def test_draws_are_even_and_independent(spark):
    df = spark.range(4000).select(*[im.mixed_uniform(F.col("id"), F.lit(d), seed=5).alias(f"d{d}") for d in (1, 2, 3)])
    x = np.array(df.collect())
    assert np.abs(x.mean(0) - 0.5).max() < 0.02 and np.abs(x.var(0) - 1 / 12).max() < 0.005
    assert np.abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.05
    assert len(np.unique(np.round(np.diff(x, axis=1), 6))) > 7000  # no common step


def test_randomised_sparsity_is_unbiased(spark):
    influence = spark.createDataFrame([(1, 0, b, 0.1 + 0.05 * b) for b in range(6)], "patient_id long, voxel_id long, beamlet_id long, a double")
    total = np.zeros(6)
    for seed in range(40):
        for r in im.sparsify_randomised(influence, 0.4, seed).collect():
            total[r.beamlet_id] += r.a
    assert np.abs(total / 40 - [0.1 + 0.05 * b for b in range(6)]).max() < 0.12
    assert total.sum() / 40 == pytest.approx(1.35)


def test_empty_structures_have_zero_statistics(spark):
    sd = spark.createDataFrame([("PTV", 1, "A", 0, 5.0, 1.0), ("PTV", 1, "B", 0, 7.0, 1.0)], "structure string, patient_id long, plan_id string, voxel_id long, dose_gy double, weight double")
    structures = spark.createDataFrame([(1, "PTV", 1.0), (1, "NONE", None)], "patient_id long, structure string, frac_in_box double")
    got = {(r.structure, r.plan_id): (r.max_dose_gy, r.mean_dose_gy) for r in ev.dose_statistics(sd, structures).collect()}
    assert got == {("PTV", "A"): (5.0, 5.0), ("PTV", "B"): (7.0, 7.0), ("NONE", "A"): (0.0, 0.0), ("NONE", "B"): (0.0, 0.0)}
