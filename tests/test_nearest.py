"""The lower envelope against every site of a line, and the nearest search on grids of its own per patient."""

import time

import numpy as np
import pyarrow as pa

from dosefold.functions.envelope import along_lines, lowest
from dosefold.functions.nearest import nearest_site

CELLS = "patient_id long, ix long, iy long, iz long"


def plain(at, h, ids, n, low, high, step):
    for i in range(len(n)):
        for place in range(low[i], high[i] + 1):
            yield min((h[i, k] + ((place - at[i, k]) * step[i]) * ((place - at[i, k]) * step[i]), ids[i, k]) for k in range(n[i]))


def test_envelope_against_every_site():
    draws = np.random.default_rng(1)
    for trial in range(60):
        lines, width = 40, int(draws.integers(1, 30))
        n = draws.integers(1, width + 1, lines)
        at = np.sort(np.stack([draws.choice(width * 2, width, replace=False) for _ in range(lines)]), 1)
        for k in range(lines):
            at[k, : n[k]] = np.sort(at[k, : n[k]])
        whole = trial % 3
        # squared distances of whole steps, of which many meet at one place; or any heights
        h = (draws.integers(0, 6, at.shape) ** 2).astype(float) if whole else draws.random(at.shape) * 100
        if whole == 2:  # every parabola of a line through one point
            h = 900.0 - (at - 15) ** 2.0
        step = draws.choice([1.0, 2.0, 0.5], lines) if whole == 1 else np.ones(lines) if whole else draws.random(lines) + 0.3
        ids = draws.permutation(lines * width).reshape(at.shape)
        low = draws.integers(-5, 5, lines)
        high = low + draws.integers(0, 70, lines)
        height, who = lowest(at.astype(float), h, ids, n, low, high, step)
        inside = np.arange(height.shape[1]) <= (high - low)[:, None]
        assert list(zip(height[inside].tolist(), who[inside].tolist())) == list(plain(at, h, ids, n, low, high, step))


def test_lines_of_a_batch_in_parts(monkeypatch):
    draws = np.random.default_rng(2)
    rows = [[{"at": int(a), "h": float(draws.integers(0, 30)), "id": int(draws.integers(0, 99))} for a in draws.permutation(20)[: draws.integers(1, 20)]] for _ in range(50)]
    kind = pa.list_(pa.struct([("at", pa.int64()), ("h", pa.float64()), ("id", pa.int64())]))
    batch = pa.RecordBatch.from_pydict({"k": pa.array(range(50)), "line": pa.array(rows, kind), "low": pa.array([0] * 50), "high": pa.array([9 + i for i in range(50)]), "step": pa.array([1.0] * 50)})
    whole = [r for b in along_lines(iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr("dosefold.functions.envelope.CELLS", 200)
    parts = [r for b in along_lines(iter([batch.slice(0, 7), batch.slice(7)])) for r in b.to_pylist()]
    assert parts == whole and [len(r["near"]) for r in whole] == [10 + i for i in range(50)]


def test_spacing_of_each_patient(spark):
    draws = np.random.default_rng(7)
    size = (6, 5, 7)
    spacing = {1: (1.0, 2.0, 4.0), 2: (2.5, 0.5, 1.0), 3: (1.0, 1.0, 1.0)}
    sites = [(p, int(x), int(y), int(z), int(i)) for p in (1, 2, 4) for i, (x, y, z) in enumerate(np.argwhere(draws.random(size) < 0.1))]
    query = [(p, x + 1, y - 2, z) for p in spacing for x in range(6) for y in range(5) for z in range(7)]
    headers = spark.createDataFrame([(p, s) for p, s in spacing.items()], "patient_id long, spacing struct<x:double,y:double,z:double>")
    got = nearest_site(spark.createDataFrame(query, CELLS), spark.createDataFrame(sites, CELLS + ", site_id long"), headers, ["patient_id"]).collect()
    assert len(got) == len(query)
    for r in got:
        s = spacing[r.patient_id]
        found = [(((r.ix - x) * s[0]) ** 2 + ((r.iy - y) * s[1]) ** 2 + ((r.iz - z) * s[2]) ** 2, i) for p, x, y, z, i in sites if p == r.patient_id]
        assert (r.dist2, r.site_id) == min(found, default=(None, None))


def test_large_grid_in_bounded_time(spark):
    """128 x 128 x 32 cells, a site in every second cell of one face: lines of full length."""
    cells = spark.range(128 * 128 * 32).selectExpr("1L AS patient_id", "id % 128 AS ix", "id div 128 % 128 AS iy", "id div 16384 AS iz")
    sites = cells.where("iz = 0 AND (ix + iy) % 2 = 0").selectExpr("*", "ix * 1000 + iy AS site_id")
    start = time.time()
    far = nearest_site(cells, sites, (1.0, 1.0, 2.5), ["patient_id"]).selectExpr("max(dist2) AS far", "count(site_id) AS n").first()
    assert far.far == (31 * 2.5) ** 2 + 1 and far.n == 128 * 128 * 32
    assert time.time() - start < 60
