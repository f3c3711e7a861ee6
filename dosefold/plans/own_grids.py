"""Queries over patients with grids of their own: origin, spacing and size from a header row per patient."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import geometry as ge
from dosefold.operators import grids as vx
from dosefold.operators import prediction as ml
from dosefold.operators import structures as st
from dosefold.plans import geometry as pg
from dosefold.plans import grids as pv
from dosefold.plans import prediction as pm
from dosefold.plans.criteria import NEAR_SQL
from dosefold.plans.evaluation import S6
from dosefold.plans.matrix import DOWN
from dosefold.plans.registry import ORACLES, changed, query
from dosefold.plans.structures import BLOCK_CT_SQL, HEADER_SQL, V, block_ct, headers

S4 = pv.S4
CELL = st.CELL
AXES = ("x", "y", "z")
GRID_SQL = f"{HEADER_SQL}, o_g AS (SELECT *, 25 - patient_id % 3 AS nx, 20 - patient_id % 2 AS ny, 3 AS nz FROM o_h)"
#: Grids around the isocentre; g and h are origin and spacing, as s and d are source and direction of a ray.
RAY_GRID_SQL = """o_rg AS (SELECT DISTINCT patient_id, -30.3::double - patient_id % 2 AS gx, -24.1::double + patient_id % 3 AS gy, -2.9::double AS gz,
 2.5::double + patient_id % 3 * 0.25::double AS hx, 2.5::double AS hy, 3.0::double + patient_id % 2 AS hz FROM v_voxel)"""


def three(x, y, z, kind="double"):
    return F.struct(*[v.cast(kind).alias(a) for v, a in zip((x, y, z), AXES)])


def own_grids(t):
    """The header table with sizes that differ, dose spacings of 3 x 2 x 1 cells and maps of predicted grids."""
    p = F.col("patient_id")
    own = headers(t).withColumn("size", three(25 - p % 3, 20 - p % 2, F.lit(3), "int"))
    s = [F.col("spacing")[a] for a in AXES]
    return own.withColumn("dose_spacing", three(3 * s[0], 2 * s[1], s[2])).withColumn(
        "ratio", three(0.8 + p % 3 * 0.05, F.lit(1.0), F.lit(1.0))).withColumn("shift", three(1.3 - p % 2 * 0.2, F.lit(0.4), F.lit(0.0)))


def ray_grids(t):
    p = F.col("patient_id")
    return t.voxel.select("patient_id").distinct().select(
        p, three(-30.3 - p % 2, -24.1 + p % 3, F.lit(-2.9)).alias("origin"), three(2.5 + p % 3 * 0.25, F.lit(2.5), 3.0 + p % 2).alias("spacing"),
        three(F.lit(25), F.lit(20), F.lit(3), "int").alias("size"),
    )


def on_own_grid(t, cells):
    """Cells inside each patient's size."""
    size = own_grids(t).select("patient_id", "size")
    return cells.join(F.broadcast(size), "patient_id").filter("ix < size.x AND iy < size.y AND iz < size.z").drop("size")


def placed(t, x, y, z):
    """Points of cells with HU below 1000 at index positions of the patient's own grid."""
    at = t.voxel.filter("hu < 1000").join(F.broadcast(headers(t)), "patient_id")
    return at.select("patient_id", F.col("voxel_id").alias("point_id"), *[
        (v * F.col("spacing")[a] + F.col("origin")[a]).alias(f"{a}_mm") for v, a in zip((x, y, z), AXES)])


@query("voxel_map_build_headers", GRID_SQL + """,
o_pt2 AS (SELECT patient_id, max(voxel_id) AS pid, ix - ix % 2 AS ix, iy - iy % 3 AS iy, iz FROM v_voxel JOIN o_g USING (patient_id) WHERE hu < 1000 AND ix - ix % 2 < nx AND iy - iy % 3 < ny GROUP BY 1, 3, 4, 5),
o_bx AS (SELECT patient_id, min(ix) AS x1, max(ix) AS x2, min(iy) AS y1, max(iy) AS y2, min(iz) AS z1, max(iz) AS z2 FROM o_pt2 GROUP BY 1),
o_q AS (SELECT v.patient_id, v.ix, v.iy, v.iz FROM v_voxel v JOIN o_bx b USING (patient_id) WHERE v.hu > -600 AND v.ix BETWEEN x1 AND x2 AND v.iy BETWEEN y1 AND y2 AND v.iz BETWEEN z1 AND z2)
SELECT patient_id, ix, iy, iz, pid AS voxel_id FROM (SELECT q.*, p.pid, row_number() OVER (PARTITION BY q.patient_id, q.ix, q.iy, q.iz
  ORDER BY (q.ix - p.ix) * (q.ix - p.ix) + (q.iy - p.iy) * (q.iy - p.iy) + (q.iz - p.iz) * (q.iz - p.iz), p.pid) AS k FROM o_q q JOIN o_pt2 p ON p.patient_id = q.patient_id) WHERE k = 1""")
def voxel_map_build_headers(t):
    ix, iy, iz = (F.col(c) for c in CELL[1:])
    points = placed(t, ix - ix % 2 + 0.3, iy - iy % 3 - 0.2, iz + 0.1)
    return vx.build_voxel_map(points, t.voxel.filter("hu > -600"), headers=own_grids(t))


@query("voxel_map_uniform_headers", f"""{GRID_SQL} SELECT patient_id, p.ix + a.a AS ix, p.iy + b.b AS iy, p.iz, max(p.voxel_id) AS voxel_id FROM v_voxel p JOIN o_g USING (patient_id)
CROSS JOIN (VALUES (0), (1), (2)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) WHERE p.hu < 1000 AND p.ix + a.a < nx AND p.iy + b.b < ny GROUP BY 1, 2, 3, 4""")
def voxel_map_uniform_headers(t):
    return vx.uniform_voxel_map(placed(t, F.col("ix") + 1.1, F.col("iy") + 0.6, F.col("iz") + 0.1), headers=own_grids(t))


@query("voxel_downsample_map_headers", f"""{GRID_SQL}, o_cl AS (SELECT v.patient_id, v.voxel_id, v.iz // {DOWN[2]} AS kz, v.iy // {DOWN[1]} AS ky, v.ix // {DOWN[0]} AS kx FROM v_voxel v JOIN o_box b USING (patient_id, voxel_id) JOIN o_g USING (patient_id)
 WHERE v.ix < nx - nx % {DOWN[0]} AND v.iy < ny - ny % {DOWN[1]} AND v.iz < nz - nz % {DOWN[2]}),
o_ct2 AS (SELECT *, count(*) AS n FROM o_cl GROUP BY ALL)
SELECT patient_id, voxel_id, dense_rank() OVER (PARTITION BY patient_id ORDER BY kz, ky, kx) - 1 AS block_id, {S6.format('n / sum(n) OVER (PARTITION BY patient_id, kz, ky, kx)')} AS share FROM o_ct2""")
def voxel_downsample_map_headers(t):
    ct = t.ct_voxel.select(*CELL, F.col("dose_voxel").alias("voxel_id"))
    return vx.downsample_map(ct, DOWN, headers=own_grids(t)).withColumn("share", snap(F.col("share")))


OWN_BOX_SQL = GRID_SQL + ", " + changed(
    pv.BOX_SQL,
    ("SELECT patient_id, avg(ix) * 0.98::double - 5 AS cx, avg(iy) * 0.98::double + 3 AS cy FROM v_voxel GROUP BY 1", "SELECT patient_id, avg(ix) * max(sx) + max(ox) AS cx, avg(iy) * max(sy) + max(oy) AS cy FROM v_voxel JOIN o_g USING (patient_id) GROUP BY 1"),
    ("13.1::double", "7.3::double"), ("1.3::double", "1.317::double"), ("1.7::double", "1.713::double"), ("1.9::double", "1.911::double"),
    ("(x_mm + 5) / 0.98::double AS fx, (y_mm - 3) / 0.98::double AS fy, (z_mm - 10) / 3.0::double AS fz FROM o_tg", "(x_mm - ox) / sx AS fx, (y_mm - oy) / sy AS fy, (z_mm - oz) / sz AS fz FROM o_tg JOIN o_g USING (patient_id)"),
)


def own_box(t):
    return vx.reference_box(t.voxel, 7.3, None, None, (1.317, 1.713, 1.911), (12, 9, 4), headers=own_grids(t))


def own_targets(t):
    return vx.fractional_index(own_box(t), headers=own_grids(t))


@query("reference_box_headers", f"{OWN_BOX_SQL} SELECT patient_id, jx, jy, jz, {S4.format('x_mm')} AS x_mm, {S4.format('y_mm')} AS y_mm, {S4.format('z_mm')} AS z_mm FROM o_tg")
def reference_box_headers(t):
    return own_box(t).select("patient_id", "jx", "jy", "jz", *[snap(F.col(c), 4).alias(c) for c in ("x_mm", "y_mm", "z_mm")])


@query("resample_linear_headers", f"""{OWN_BOX_SQL} SELECT c.patient_id, c.jx, c.jy, c.jz, {S4.format('CASE WHEN count(v.hu) = count(*) THEN sum(c.w * v.hu) ELSE -7 END')} AS value
FROM o_co c LEFT JOIN v_voxel v USING (patient_id, ix, iy, iz) WHERE c.w > 0 GROUP BY 1, 2, 3, 4""")
def resample_linear_headers(t):
    source = t.voxel.select(*CELL, F.col("hu").cast("double").alias("value"))
    return vx.resample_linear(own_targets(t), source, pv.J, "value", -7.0).withColumn("value", snap(F.col("value"), 4))


@query("resample_masked_headers", f"""{OWN_BOX_SQL}, o_m AS (SELECT c.patient_id, c.jx, c.jy, c.jz, CASE WHEN count(v.hu) = count(*) THEN sum(CASE WHEN v.hu > 0 THEN c.w * v.hu ELSE 0 END) ELSE 0 END AS a,
  CASE WHEN count(v.hu) = count(*) THEN sum(CASE WHEN v.hu > 0 THEN c.w ELSE 0 END) ELSE 0 END AS b FROM o_co c LEFT JOIN v_voxel v USING (patient_id, ix, iy, iz) WHERE c.w > 0 GROUP BY 1, 2, 3, 4)
SELECT patient_id, jx, jy, jz, {S4.format('CASE WHEN b > 0.001 THEN a / (b + 0.000001::double) ELSE -7 END')} AS value, {S6.format('b')} AS valid_weight FROM o_m""")
def resample_masked_headers(t):
    source = t.voxel.select(*CELL, F.col("hu").cast("double").alias("value"), (F.col("hu") > 0).cast("double").alias("valid"))
    r = vx.resample_masked(own_targets(t), source, pv.J, "value", "valid", -7.0)
    return r.withColumn("value", snap(F.col("value"), 4)).withColumn("valid_weight", snap(F.col("valid_weight")))


@query("downsample_masked_headers", f"""{GRID_SQL},
o_v AS (SELECT v.* FROM v_voxel v JOIN o_g USING (patient_id) WHERE v.ix < nx AND v.iy < ny AND v.iz < nz),
o_t AS (SELECT o_g.*, x.range AS jx, y.range AS jy, z.range AS jz, x.range * ((nx - 1) / 11.0::double) AS fx, y.range * ((ny - 1) / 6.0::double) AS fy, z.range * ((nz - 1) / 1.0::double) AS fz FROM o_g CROSS JOIN range(12) x CROSS JOIN range(7) y CROSS JOIN range(2) z),
o_in AS (SELECT t.*, ceil(nx / 12.0) AS wx, ceil(ny / 7.0) AS wy, ceil(nz / 2.0) AS wz FROM o_t t JOIN o_v v ON v.patient_id = t.patient_id AND v.ix = floor(fx + 0.5)::bigint AND v.iy = floor(fy + 0.5)::bigint AND v.iz = floor(fz + 0.5)::bigint AND v.hu > 0),
o_lin AS (SELECT t.patient_id, t.jx, t.jy, t.jz, sum(w * v.hu) AS lin, count(v.hu) = count(*) AS whole FROM (SELECT t.*, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
   (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
   FROM o_in t CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c)) t LEFT JOIN o_v v USING (patient_id, ix, iy, iz) WHERE w > 0 GROUP BY 1, 2, 3, 4),
o_low AS (SELECT t.patient_id, t.jx, t.jy, t.jz, min(v.hu) AS low FROM o_in t JOIN o_v v ON v.patient_id = t.patient_id AND v.hu > 0
  AND v.ix BETWEEN floor(fx + 0.5) - floor(wx / 2) AND floor(fx + 0.5) - floor(wx / 2) + wx - 1 AND v.iy BETWEEN floor(fy + 0.5) - floor(wy / 2) AND floor(fy + 0.5) - floor(wy / 2) + wy - 1 AND v.iz BETWEEN floor(fz + 0.5) - floor(wz / 2) AND floor(fz + 0.5) - floor(wz / 2) + wz - 1 GROUP BY 1, 2, 3, 4)
SELECT t.patient_id, t.jx, t.jy, t.jz, {S4.format('coalesce(greatest(CASE WHEN l.whole THEN l.lin WHEN l.jx IS NOT NULL THEN 0 END, m.low), 0)')} AS value FROM o_t t LEFT JOIN o_lin l USING (patient_id, jx, jy, jz) LEFT JOIN o_low m USING (patient_id, jx, jy, jz)""")
def downsample_masked_headers(t):
    source = on_own_grid(t, t.voxel.select(*CELL, F.col("hu").cast("double").alias("value")))
    r = vx.downsample_masked(source, source.filter("value > 0"), "value", None, (12, 7, 2), headers=own_grids(t))
    return r.withColumn("value", snap(F.col("value"), 4))


OWN_MARCH_SQL = RAY_GRID_SQL + ", " + changed(
    pg.MARCH_SQL,
    ("+ 30.3::double) / 2.5::double", "- gx) / hx"), ("+ 24.1::double) / 2.5::double", "- gy) / hy"), ("+ 2.9::double) / 3.0::double", "- gz) / hz"),
    ("AS n FROM o_ray) CROSS JOIN", "AS n FROM o_ray) JOIN o_rg USING (patient_id) CROSS JOIN"),
)


@query("ray_march_headers", f"{OWN_MARCH_SQL} SELECT * FROM o_hit")
def ray_march_headers(t):
    own = ray_grids(t)
    return ge.ray_march(pg.near_rays(t, headers=own), pg.body(t), headers=own)


def _patch_sql():
    whole = ORACLES["ray_patch_grid"]
    return OWN_MARCH_SQL + ", " + changed(
        whole[whole.index("o_u AS ("):],
        ("+ 30.3::double) / 2.5::double", "- gx) / hx"), ("+ 24.1::double) / 2.5::double", "- gy) / hy"), ("+ 2.9::double) / 3.0::double", "- gz) / hz"),
        ("::bigint AS iz FROM o_c)", "::bigint AS iz FROM o_c JOIN o_rg USING (patient_id))"),
    )


@query("ray_patch_grid_headers", _patch_sql())
def ray_patch_grid_headers(t):
    return pg.patches(t, headers=ray_grids(t))


@query("radiological_depth_headers", f"""{HEADER_SQL} SELECT patient_id, ix, iy, iz, {S6.format("CASE WHEN hu > -500 THEN sz * sum(CASE WHEN hu > -500 THEN least(greatest(hu + 1000, 0), 3000) / 1000.0::double ELSE 0 END) OVER (PARTITION BY patient_id, ix, iy ORDER BY iz DESC) ELSE 0 END")} AS depth_mm FROM v_voxel JOIN o_h USING (patient_id)""")
def radiological_depth_headers(t):
    r = ge.radiological_depth(t.voxel, t.voxel.filter("hu > -500"), headers=own_grids(t))
    return r.withColumn("depth_mm", snap(F.col("depth_mm")))


def _own_near(sql):
    return changed(sql, ("((b.ix - p.ix) * 0.98::double)", "((b.ix - p.ix) * sx)"), ("((b.iy - p.iy) * 0.98::double)", "((b.iy - p.iy) * sy)"), ("((b.iz - p.iz) * 3.0::double)", "((b.iz - p.iz) * sz)"),
                   ("FROM v_voxel b LEFT JOIN", "FROM v_voxel b JOIN o_h ON o_h.patient_id = b.patient_id LEFT JOIN"))


@query("nearest_structure_distance_headers", f"{HEADER_SQL}, {_own_near(NEAR_SQL)} SELECT patient_id, voxel_id, {S4.format('sqrt(d2)')} AS distance_mm FROM o_near")
def nearest_structure_distance_headers(t):
    target = t.structure_voxel.filter("structure = 'PTV'")
    outside = t.voxel.join(target.select("patient_id", "voxel_id"), ["patient_id", "voxel_id"], "left_anti")
    found = ge.structure_distance(outside.select("patient_id", "voxel_id", "ix", "iy", "iz"), target, headers(t))
    return found.select("patient_id", "voxel_id", snap(F.col("distance_mm"), 4).alias("distance_mm"))


@query("interior_ramp_headers", HEADER_SQL + ", " + f"""
o_m AS (SELECT * FROM v_structure_voxel WHERE structure = 'BOX'),
o_bd AS (SELECT s.patient_id, s.ix, s.iy, s.iz FROM o_m s LEFT JOIN o_m n ON n.patient_id = s.patient_id AND abs(n.ix - s.ix) + abs(n.iy - s.iy) + abs(n.iz - s.iz) = 1 GROUP BY 1, 2, 3, 4 HAVING count(n.ix) < 6),
o_d AS (SELECT s.patient_id, s.voxel_id, min(sqrt(pow((s.ix - b.ix) * sx, 2) + pow((s.iy - b.iy) * sy, 2) + pow((s.iz - b.iz) * sz, 2))) AS d FROM o_m s JOIN o_bd b USING (patient_id) JOIN o_h USING (patient_id) GROUP BY 1, 2),
o_e AS (SELECT patient_id, min(d) AS d1, max(d) AS d2 FROM o_d GROUP BY 1)
SELECT d.patient_id, d.voxel_id, {S4.format('60 / exp((ln(72.0::double) - ln(60.0::double)) / (d2 - d1) * d1) * exp((ln(72.0::double) - ln(60.0::double)) / (d2 - d1) * d.d)')} AS ramp_gy FROM o_d d JOIN o_e USING (patient_id)""")
def interior_ramp_headers(t):
    mask = t.structure_voxel.filter("structure = 'BOX'")
    edge = st.boundary_voxels(mask).join(mask.select(*CELL, "voxel_id"), CELL)
    r = ge.interior_ramp(mask.select(*CELL, "voxel_id"), edge, headers(t), 60.0, 72.0)
    return r.select("patient_id", "voxel_id", snap(F.col("ramp_gy"), 4).alias("ramp_gy"))


@query("predicted_matrix_headers", f"""{GRID_SQL}, o_r AS (SELECT patient_id, 0.8::double + patient_id % 3 * 0.05::double AS rx, 1.3::double - patient_id % 2 * 0.2::double AS tx, nx, ny FROM o_g), {BLOCK_CT_SQL},
o_p0 AS (SELECT i.patient_id, i.beamlet_id, v.ix, v.iy, v.iz, i.a_int * 0.1::double * 0.07::double * CASE WHEN i.a_int > 3 THEN 1 ELSE 0 END AS v FROM v_influence i JOIN v_voxel v USING (patient_id, voxel_id)),
o_p1 AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY patient_id, beamlet_id) AS top FROM o_p0) WHERE v >= 0.2::double * top AND v <> 0),
o_sc AS (SELECT patient_id, beamlet_id, x.range AS ix, y.range AS iy, p.iz, sum(v * (1 - abs(x.range * rx + tx - p.ix)) * (1 - abs(y.range + 0.4::double - p.iy))) AS v FROM o_p1 p JOIN o_r USING (patient_id) JOIN range(25) x ON x.range < nx AND abs(x.range * rx + tx - p.ix) < 1 JOIN range(20) y ON y.range < ny AND abs(y.range + 0.4::double - p.iy) < 1 GROUP BY 1, 2, 3, 4, 5),
o_last AS (SELECT patient_id, voxel_id, max((iz * 1000 + iy) * 1000 + ix) AS code FROM o_ct WHERE voxel_id IS NOT NULL GROUP BY 1, 2)
SELECT s.patient_id, s.beamlet_id, l.voxel_id, {S6.format('s.v')} AS a FROM o_sc s JOIN o_last l ON l.patient_id = s.patient_id AND l.code = (s.iz * 1000 + s.iy) * 1000 + s.ix WHERE s.v <> 0""")
def predicted_matrix_headers(t):
    operator = ml.interpolation_operator(block_ct(t), None, None, None, headers=own_grids(t))
    return ml.predicted_matrix(pm.guessed(t), operator, unscale=0.07, tail=0.2).withColumn("a", snap(F.col("a")))


@query("augment_affine_headers", GRID_SQL + ", " + changed(
    pm.AFFINE_SQL, (", 0), 24) AS fx", ", 0), nx - 1) AS fx"), (", 0), 19) AS fy", ", 0), ny - 1) AS fy"), (", 0), 2) AS fz FROM v_voxel v)", ", 0), nz - 1) AS fz FROM v_voxel v JOIN o_g USING (patient_id) WHERE v.ix < nx AND v.iy < ny)"),
))
def augment_affine_headers(t):
    grid = on_own_grid(t, pm.plan_a_grid(t))
    r = ml.augment(grid, pm.fixed_maps(t), None, ["hu", "dose_gy"], ["target"], headers=own_grids(t))
    return r.select("patient_id", "jx", "jy", "jz", snap(F.col("hu"), 4).alias("hu"), snap(F.col("dose_gy"), 4).alias("dose_gy"), "target")


def _grown_sql(structure, margin, name):
    """The query of structure_expand_headers for another structure and margin, as a table."""
    whole = ORACLES["structure_expand_headers"]
    steps = whole[whole.index("o_n AS ("):]
    steps, last = steps.rsplit("\nSELECT DISTINCT", 1)
    text = changed(steps, ("2.6 / ", f"{margin} / "), ("'GTV'", f"'{structure}'"))
    for table in ("o_n", "o_k", "o_ball", "o_in"):
        text, last = text.replace(f"{table} ", f"{table}_{name} ").replace(f"{table})", f"{table}_{name})"), last.replace(f"{table} ", f"{table}_{name} ")
    return f"{text}, {name} AS (SELECT DISTINCT{last})"


@query("structure_expression_headers", f"""{HEADER_SQL}, {_grown_sql('GTV', 2.0, 'e0')},
e1 AS (SELECT * FROM e0 EXCEPT {V.format('PTV')}), e2 AS (SELECT * FROM e1 UNION {V.format('BOX')})
SELECT * FROM e2 INTERSECT ({V.format('CORD')} UNION {V.format('BOX')})""")
def structure_expression_headers(t):
    return st.evaluate_expression(t.structure_voxel, "GTV + 2 - PTV | BOX & (CORD + BOX)", headers=headers(t))


@query("optimization_structures_headers", f"""{HEADER_SQL}, {_grown_sql('BOX', 3.0, 'e0')}, {_grown_sql('GTV', 1.0, 'e1')}
SELECT 'RIND' AS structure, * FROM ((SELECT * FROM e0 EXCEPT {V.format('BOX')}) INTERSECT {V.format('BODY')})
UNION ALL SELECT 'NEAR_GTV' AS structure, * FROM (SELECT * FROM e1 INTERSECT {V.format('BODY')})""")
def optimization_structures_headers(t):
    definitions = [("RIND", "(BOX + 3) - BOX"), ("NEAR_GTV", "GTV + 1"), ("PTV", "GTV + 5"), ("BROKEN", "GTV + MISSING"), ("BAD", "GTV ?")]
    return st.optimization_structures(t.structure_voxel, definitions, headers=headers(t))
