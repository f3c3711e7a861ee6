"""The settled descent against the same steps in numpy, and against many plain steps."""

import numpy as np
import pytest

from dosefold.operators import objectives as ob
from dosefold.plans.objectives import OBJECTIVES
from dosefold.sources.star_schema import StarSchema

FOLDER = "/root/testdata/sf0.001"
SCALE, SMOOTH = 0.0003, {"right": 0.002, "down": 0.001}


class Plain:
    """Objective and gradient of one patient's beamlets, from collected tables."""

    def __init__(self, influence, opt_voxels, pairs, objectives):
        self.objectives = objectives
        self.beamlets = sorted({r.beamlet_id for r in influence})
        voxels = sorted({r.voxel_id for r in influence} | {r.voxel_id for r in opt_voxels})
        at = {b: k for k, b in enumerate(self.beamlets)}
        row = {v: k for k, v in enumerate(voxels)}
        self.a = np.zeros((len(voxels), len(self.beamlets)))
        for r in influence:
            self.a[row[r.voxel_id], at[r.beamlet_id]] += r.a * SCALE
        self.masks = {}
        for r in opt_voxels:
            self.masks.setdefault(r.structure, []).append(row[r.voxel_id])
        self.pairs = [(at[p.beamlet_id], at[p.other], SMOOTH[p.direction]) for p in pairs if p.beamlet_id in at and p.other in at]

    def value(self, x, dose=None):
        dose = self.a @ x if dose is None else dose
        total = sum(w * (x[i] - x[j]) ** 2 for i, j, w in self.pairs)
        for _, kind, name, weight, target in self.objectives:
            d = dose[self.masks.get(name, [])]
            e = np.maximum(d - target, 0) if kind == "quadratic-overdose" else np.maximum(target - d, 0) if kind == "quadratic-underdose" else d
            total += weight * (e * e).mean() if len(d) else 0
        return total

    def gradient(self, x):
        dose, g = self.a @ x, np.zeros(len(self.a))
        for _, kind, name, weight, target in self.objectives:
            rows = self.masks.get(name, [])
            d = dose[rows]
            e = np.maximum(d - target, 0) if kind == "quadratic-overdose" else np.minimum(d - target, 0) if kind == "quadratic-underdose" else d
            np.add.at(g, rows, 2 * weight / max(len(d), 1) * e)
        g = self.a.T @ g
        for i, j, w in self.pairs:
            g[i] += 2 * w * (x[i] - x[j])
            g[j] -= 2 * w * (x[i] - x[j])
        return g

    def settled(self, x, step, tolerance=1e-3):
        g, a, b, k, s, y = self.gradient(x), step, 0.0, 0, 0 * x, 0 * x
        was = self.value(x)
        while True:
            k += 1
            if s @ y > 0:
                a = (s @ s) / (s @ y) if k % 2 else (s @ y) / (y @ y)
            b = max((np.where((x <= 0) & (g > 0), 0, g) @ y) / (s @ y), 0) if s @ y > 0 else 0.0
            d = np.maximum(x - a * (g - b * np.where(x > 0, s, 0)), 0) - x
            reach = min([8.0, *(-x[d < 0] / d[d < 0])])
            tries = [*ob.WITHIN, *(1 + (max(reach, 1) - 1) * t for t in ob.BEYOND)]
            best, t = min((self.value(x + t * d), t) for t in tries)
            gain = 1 - best / was if was > 0 else 0.0
            new = np.maximum(x + t * d, 0)
            if gain <= tolerance and not (t == 0 and b > 0):
                return new, best, k if t > 0 else k - 1
            s, y = new - x, self.gradient(new) - g
            x, g, was = new, self.gradient(new), best


@pytest.fixture(scope="module")
def given(spark):
    t = StarSchema(spark, FOLDER)
    start = t.influence.select("patient_id", "beamlet_id").distinct().join(t.fluence, "beamlet_id")
    pairs = ob.neighbour_pairs(t.unit_cell, ["beam_id"])
    plain = Plain(t.influence.collect(), t.opt_voxel.collect(), pairs.collect(), OBJECTIVES)
    starts = {p: {r.beamlet_id: r.intensity for r in start.where(f"plan_id = '{p}'").collect()} for p in "AB"}
    return t, plain, starts


def test_settled_descent_repeats_the_numpy_loop(spark, given):
    from dosefold.plans import load_all

    _, plain, starts = given
    found = load_all()[0]["fluence_descent_settled"](spark, FOLDER).collect()
    for plan in "AB":
        x = np.array([starts[plan][b] for b in plain.beamlets])
        want, objective, rounds = plain.settled(x, 0.8)
        got = {r.beamlet_id: r for r in found if r.plan_id == plan}
        assert len(got) == len(plain.beamlets) and rounds <= 25
        assert {r.iteration for r in got.values()} == {rounds}
        assert np.abs([got[b].intensity for b in plain.beamlets] - want).max() < 0.01
        assert abs(got[plain.beamlets[0]].objective - objective) < 0.01
        for _ in range(206):  # many more plain steps end no lower
            x = np.maximum(x - 0.8 * plain.gradient(x), 0)
        assert objective <= plain.value(x)


def test_settled_plans_leave_the_loop(spark):
    """A plan at its minimum stays as it is while the other goes on; a patient without penalties settles at once."""
    influence = spark.createDataFrame([(p, v, b, 1.0 + (v == b)) for p in (1, 2) for v in range(4) for b in range(3)], "patient_id long, voxel_id long, beamlet_id long, a double")
    voxels = spark.createDataFrame([(p, v) for p in (1, 2) for v in range(4)], "patient_id long, voxel_id long")
    opt = spark.createDataFrame([(1, "T", v) for v in range(4)], "patient_id long, structure string, voxel_id long")
    start = spark.createDataFrame([(1, "low", b, 0.0) for b in range(3)] + [(1, "high", b, 9.0) for b in range(3)] + [(2, "high", b, 1.0) for b in range(3)], "patient_id long, plan_id string, beamlet_id long, intensity double")
    goal = spark.createDataFrame([(1, "quadratic-overdose", "T", 1.0, 5.0)], "objective_id long, type string, structure string, weight_factor double, target double")
    pairs = spark.createDataFrame([(0, 1, "right"), (1, 2, "right")], "beamlet_id long, other long, direction string")
    found = ob.settled_descent(start, influence, voxels, opt, goal, pairs, (0.1, 0.1), 0.1, tolerance=1e-9).collect()
    by_plan = {(r.patient_id, r.plan_id): [] for r in found}
    for r in found:
        by_plan[r.patient_id, r.plan_id].append(r)
    assert {k: len(v) for k, v in by_plan.items()} == {(1, "low"): 3, (1, "high"): 3, (2, "high"): 3}
    assert {(r.intensity, r.objective, r.iteration) for r in by_plan[1, "low"]} == {(0.0, 0.0, 0)}
    assert {(r.intensity, r.iteration) for r in by_plan[2, "high"]} == {(1.0, 0)}
    assert all(r.iteration >= 1 and 0 <= r.objective < 1e-6 for r in by_plan[1, "high"])
