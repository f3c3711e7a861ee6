"""Mask algebra against step-by-step and brute-force NumPy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dosefold.functions.nearest import nearest_site
from dosefold.operators import structures as st

SIZE = (9, 8, 5)
CELLS = "patient_id long, ix long, iy long, iz long"


def frame(spark, array, patient=1):
    return spark.createDataFrame([(patient, int(x), int(y), int(z)) for x, y, z in np.argwhere(array)], CELLS)


def cells(df):
    return {(r.ix, r.iy, r.iz) for r in df.collect()}


def as_set(array):
    return {tuple(int(v) for v in c) for c in np.argwhere(array)}


def step(array, offsets, grow):
    out = np.zeros_like(array) if grow else np.ones_like(array)
    padded = np.pad(array, 1)
    for dx, dy, dz in offsets:
        moved = padded[1 + dx : 1 + dx + array.shape[0], 1 + dy : 1 + dy + array.shape[1], 1 + dz : 1 + dz + array.shape[2]]
        out = out | moved if grow else out & moved
    return out


BALL = [o for o in itertools.product((-1, 0, 1), repeat=3) if sum(map(abs, o)) <= 2]
FLAT = [o for o in BALL if o[2] == 0]


def by_steps(array, margin, res, grow):
    k, m = st.margin_steps(margin, res)
    for _ in range(k):
        array = step(array, BALL, grow)
    for _ in range(m):
        array = step(array, FLAT, grow)
    return array


@pytest.fixture(scope="module")
def mask():
    rng = np.random.default_rng(7)
    return rng.random(SIZE) < 0.08


@pytest.mark.parametrize("margin,res", [(1.0, (1, 1, 1)), (2.0, (1, 1, 1)), (3.0, (1, 1, 1)), (3.0, (0.98, 0.98, 3.0)), (6.0, (1.0, 1.0, 3.0))])
def test_expand_equals_stepwise_dilation(spark, mask, margin, res):
    got = cells(st.expand(frame(spark, mask), margin, res, SIZE))
    assert got == as_set(by_steps(mask, margin, res, True))


@pytest.mark.parametrize("margin,res", [(1.0, (1, 1, 1)), (2.0, (1, 1, 1)), (3.0, (0.98, 0.98, 3.0))])
def test_shrink_equals_stepwise_erosion_with_empty_border(spark, mask, margin, res):
    solid = ~mask
    got = cells(st.shrink(frame(spark, solid), margin, res))
    assert got == as_set(by_steps(solid, margin, res, False))


def test_long_margins_run_in_bounded_passes(spark, mask):
    from dosefold.functions import runs as rl

    grown = rl.to_runs(frame(spark, mask), ["patient_id"])
    want = mask
    for k in rl.passes(2 + rl.MAX_PASS):
        grown = rl.dilate(grown, ["patient_id"], rl.ball(k), SIZE)
    for _ in range(2 + rl.MAX_PASS):
        want = step(want, BALL, True)
    assert cells(rl.to_voxels(grown, ["patient_id"])) == as_set(want)


def test_margin_zero_and_negative(spark, mask):
    df = frame(spark, mask)
    assert cells(st.expand(df, 0, (1, 1, 1), SIZE)) == as_set(mask)
    with pytest.raises(ValueError):
        st.expand(df, -1, (1, 1, 1), SIZE)


def test_expression_reads_left_to_right(spark):
    names = {"A": [(0, 0, 0), (1, 0, 0)], "B-1": [(1, 0, 0)], "C": [(2, 0, 0), (0, 0, 0)]}
    table = spark.createDataFrame([(n, 1, *c) for n, cs in names.items() for c in cs], "structure string, " + CELLS)
    run = lambda text: cells(st.evaluate_expression(table, text, (1, 1, 1), SIZE))
    assert run("A - B-1 | C") == {(0, 0, 0), (2, 0, 0)}
    assert run("A | C & B-1") == {(1, 0, 0)}
    assert run("A | (C & B-1)") == {(0, 0, 0), (1, 0, 0)}
    with pytest.raises(ValueError):
        run("A ? C")


def test_regions_and_boundary(spark):
    rng = np.random.default_rng(3)
    array = rng.random(SIZE) < 0.35
    table = frame(spark, array).withColumn("structure", F.lit("T"))
    seen, label = {}, 0
    for start in sorted(as_set(array), key=lambda c: (c[2], c[1], c[0])):
        if start in seen:
            continue
        label += 1
        todo = [start]
        while todo:
            c = todo.pop()
            if c in seen or not all(0 <= v < n for v, n in zip(c, SIZE)) or not array[c]:
                continue
            seen[c] = label
            todo += [tuple(c[i] + (s if i == a else 0) for i in range(3)) for a in range(3) for s in (-1, 1)]
    got = {(r.ix, r.iy, r.iz): r.region for r in st.connected_regions(table).collect()}
    assert got == seen
    faces = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
    assert cells(st.boundary_voxels(table)) == as_set(array & ~step(array, faces, False))


def test_nearest_site_is_exact_with_smallest_id_on_ties(spark):
    rng = np.random.default_rng(5)
    sites = [(1, int(x), int(y), int(z), int(i)) for i, (x, y, z) in enumerate(np.argwhere(rng.random(SIZE) < 0.05))]
    query = frame(spark, np.ones(SIZE, bool))
    sited = spark.createDataFrame(sites, CELLS + ", site_id long")
    spacing = (1.0, 1.0, 2.0)
    for r in nearest_site(query, sited, spacing, ["patient_id"]).collect():
        best = min(
            ((((r.ix - x) * 1.0) ** 2 + ((r.iy - y) * 1.0) ** 2) + ((r.iz - z) * 2.0) ** 2, i) for _, x, y, z, i in sites
        )
        assert (r.dist2, r.site_id) == best


def test_nearest_site_without_sites_is_null(spark):
    query = frame(spark, np.ones((2, 2, 1), bool), patient=2)
    sites = spark.createDataFrame([(1, 0, 0, 0, 4)], CELLS + ", site_id long")
    assert all(r.site_id is None for r in nearest_site(query, sites, (1.0, 1.0, 1.0), ["patient_id"]).collect())
