"""Beam geometry queries: eight beams per patient, voxels on a grid around the isocentre."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import geometry as ge
from dosefold.operators import structures as st
from dosefold.plans.criteria import NEAR_SQL, target_distance
from dosefold.plans.evaluation import S6
from dosefold.plans.grids import S4
from dosefold.plans.registry import query
from dosefold.plans.structures import RES

ORIGIN, SPACING = (-30.3, -24.1, -2.9), (2.5, 2.5, 3.0)
RADIUS = 3.1
ROT = """cos(c) * cos(g) * cos(t) + sin(c) * sin(t) AS r00, -cos(c) * sin(g) AS r01, sin(c) * cos(t) - cos(c) * cos(g) * sin(t) AS r02,
 sin(g) * cos(t) AS r10, cos(g) AS r11, -sin(g) * sin(t) AS r12, cos(c) * sin(t) - sin(c) * cos(g) * cos(t) AS r20, sin(c) * sin(g) AS r21, cos(c) * cos(t) + sin(c) * cos(g) * sin(t) AS r22"""
BEAM_SQL = f"""o_b8 AS (SELECT p.patient_id, b.range AS beam_id, radians(b.range * 45) AS g, radians(b.range % 2 * 20) AS c, radians(b.range * 10) AS t, p.patient_id % 3 * 1.7::double AS iso_x, 0.0::double AS iso_y, 0.0::double AS iso_z
 FROM (SELECT DISTINCT patient_id FROM v_voxel) p CROSS JOIN range(8) b), o_rot AS (SELECT *, {ROT} FROM o_b8)"""
FRAME_SQL = f"""{BEAM_SQL}, o_vox AS (SELECT patient_id, voxel_id, ix, iy, iz, hu, ix * 2.5::double - 30.3::double AS vx, iy * 2.5::double - 24.1::double AS vy, iz * 3.0::double - 2.9::double AS vz FROM v_voxel),
o_fr AS (SELECT v.patient_id, v.voxel_id, v.hu, b.beam_id, (vx - iso_x) * r00 + vy * r10 + vz * r20 AS xp, (vx - iso_x) * r01 + vy * r11 + vz * r21 AS yp, (vx - iso_x) * r02 + vy * r12 + vz * r22 AS zp FROM o_vox v JOIN o_rot b USING (patient_id))"""
D1 = "(xp * x_mm + (yp + 1000) * 1000 + zp * y_mm) / sqrt(x_mm * x_mm + 1000000 + y_mm * y_mm)"
R2 = "xp * xp + (yp + 1000) * (yp + 1000) + zp * zp"


def beams(t):
    base = t.voxel.select("patient_id").distinct().withColumn("beam_id", F.explode(F.array(*[F.lit(b).cast("long") for b in range(8)])))
    return ge.with_rotation(base.select(
        "patient_id", "beam_id", (F.col("beam_id") * 45).alias("gantry_angle"), (F.col("beam_id") % 2 * 20).alias("couch_angle"),
        (F.col("beam_id") * 10).alias("collimator_angle"), (F.col("patient_id") % 3 * 1.7).alias("iso_x"), F.lit(0.0).alias("iso_y"), F.lit(0.0).alias("iso_z"),
    ))


def voxels(t):
    return t.voxel.select(
        "patient_id", "voxel_id", "hu", "ix", "iy", "iz", *[(F.col(i) * s + o).alias(v) for i, v, s, o in zip(("ix", "iy", "iz"), ("vx", "vy", "vz"), SPACING, ORIGIN)]
    )


def framed(t):
    return ge.beam_frame(voxels(t), beams(t))


def lattice(t):
    return t.beamlet.select("beam_id", "beamlet_id", "x_mm", "y_mm")


@query("beam_rotation", f"""o_a AS (SELECT beam_id, radians(gantry_angle) AS g, radians(beam_id % 3 * 10) AS c, radians(collimator_angle) AS t FROM v_beam), o_r AS (SELECT beam_id, {ROT} FROM o_a)
SELECT beam_id, {', '.join(S4.format(m) + ' AS ' + m for m in ge.MATRIX)} FROM o_r""")
def beam_rotation(t):
    b = t.beam.select("beam_id", "gantry_angle", (F.col("beam_id") % 3 * 10).alias("couch_angle"), "collimator_angle")
    return ge.with_rotation(b).select("beam_id", *[snap(F.col(m), 4).alias(m) for m in ge.MATRIX])


@query("source_and_beamlet_points", f"""{BEAM_SQL} SELECT patient_id, beam_id, beamlet_id, {', '.join(S4.format(f'iso_{a} - 1000 * r{i}1') + f' AS source_{a}' for i, a in enumerate('xyz'))},
 {', '.join(S4.format(f'iso_{a} + x_mm * r{i}0 + y_mm * r{i}2') + f' AS target_{a}' for i, a in enumerate('xyz'))} FROM o_rot JOIN v_beamlet USING (beam_id)""")
def source_and_beamlet_points(t):
    r = ge.source_and_beamlet_points(beams(t), lattice(t))
    return r.select("patient_id", "beam_id", "beamlet_id", *[snap(F.col(f"{p}_{a}"), 4).alias(f"{p}_{a}") for p in ("source", "target") for a in "xyz"])


@query("bev_projection", f"{FRAME_SQL} SELECT patient_id, voxel_id, beam_id, {S4.format('xp * (1000 / (1000 + yp))')} AS u_mm, {S4.format('zp * (1000 / (1000 + yp))')} AS v_mm, {S4.format('yp')} AS depth_mm FROM o_fr")
def bev_projection(t):
    r = ge.bev_projection(framed(t))
    return r.select("patient_id", "voxel_id", "beam_id", *[snap(F.col(c), 4).alias(c) for c in ("u_mm", "v_mm", "depth_mm")])


def entry_pairs(t):
    """Matrix entries with the voxel in the beam frame and the beamlet position."""
    columns = t.influence.join(lattice(t), "beamlet_id")
    return columns.join(framed(t), ["patient_id", "beam_id", "voxel_id"])


PAIR_SQL = f"{FRAME_SQL}, o_pair AS (SELECT f.patient_id, f.beam_id, f.voxel_id, f.hu, b.beamlet_id, {D1} AS d1, {R2} AS r2 FROM v_influence i JOIN v_beamlet b USING (beamlet_id) JOIN o_fr f ON f.patient_id = i.patient_id AND f.voxel_id = i.voxel_id AND f.beam_id = b.beam_id)"


@query("ray_distances", f"{PAIR_SQL} SELECT patient_id, beam_id, voxel_id, beamlet_id, {S4.format('d1')} AS d1_mm, {S4.format('sqrt(greatest(r2 - d1 * d1, 0))')} AS d2_mm FROM o_pair")
def ray_distances(t):
    r = ge.ray_distances(entry_pairs(t))
    return r.select("patient_id", "beam_id", "voxel_id", "beamlet_id", snap(F.col("d1_mm"), 4).alias("d1_mm"), snap(F.col("d2_mm"), 4).alias("d2_mm"))


NEAR_PAIR_SQL = f"""o_np AS (SELECT * FROM (SELECT f.patient_id, f.beam_id, f.voxel_id, f.hu, b.beamlet_id, {D1} AS d1, {R2} AS r2 FROM o_fr f JOIN v_beamlet b USING (beam_id)) WHERE sqrt(greatest(r2 - d1 * d1, 0)) <= 3.1)"""


@query("near_ray_pairs", f"{FRAME_SQL}, {NEAR_PAIR_SQL} SELECT patient_id, beam_id, voxel_id, beamlet_id, {S4.format('d1')} AS d1_mm, {S4.format('sqrt(greatest(r2 - d1 * d1, 0))')} AS d2_mm FROM o_np")
def near_ray_pairs(t):
    r = ge.near_ray_pairs(framed(t), lattice(t), RADIUS)
    return r.select("patient_id", "beam_id", "voxel_id", "beamlet_id", snap(F.col("d1_mm"), 4).alias("d1_mm"), snap(F.col("d2_mm"), 4).alias("d2_mm"))


@query("body_entry", f"""{PAIR_SQL}, {NEAR_PAIR_SQL}, o_e AS (SELECT patient_id, beam_id, beamlet_id, min(d1) AS entry FROM o_np WHERE hu > 0 GROUP BY 1, 2, 3)
SELECT p.patient_id, p.beam_id, p.voxel_id, p.beamlet_id, {S4.format('entry')} AS entry_mm, {S4.format('CASE WHEN entry IS NULL THEN d1 WHEN hu > 0 THEN entry ELSE 0 END')} AS outside_mm,
 {S4.format('CASE WHEN entry IS NULL THEN 0 ELSE greatest(d1 - entry, 0) END')} AS inside_mm FROM o_pair p LEFT JOIN o_e e USING (patient_id, beam_id, beamlet_id)""")
def body_entry(t):
    pairs = ge.ray_distances(entry_pairs(t)).withColumn("in_body", F.col("hu") > 0)
    near = ge.near_ray_pairs(framed(t).filter("hu > 0"), lattice(t), RADIUS)
    r = ge.body_entry(pairs, near)
    return r.select("patient_id", "beam_id", "voxel_id", "beamlet_id", *[snap(F.col(c), 4).alias(c) for c in ("entry_mm", "outside_mm", "inside_mm")])


MARCH_SQL = f"""{BEAM_SQL}, o_ray AS (SELECT patient_id, beam_id, beamlet_id, iso_x - 1000 * r01 AS sx, -1000 * r11 AS sy, -1000 * r21 AS sz, x_mm * r00 + y_mm * r02 + 1000 * r01 AS dx, x_mm * r10 + y_mm * r12 + 1000 * r11 AS dy, x_mm * r20 + y_mm * r22 + 1000 * r21 AS dz FROM o_rot JOIN v_beamlet USING (beam_id)),
o_smp AS (SELECT patient_id, beam_id, beamlet_id, k.range * 2.0::double AS t, round_even((sx + k.range * 2 * dx / n + 30.3::double) / 2.5::double, 0) AS ix, round_even((sy + k.range * 2 * dy / n + 24.1::double) / 2.5::double, 0) AS iy, round_even((sz + k.range * 2 * dz / n + 2.9::double) / 3.0::double, 0) AS iz
  FROM (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM o_ray) CROSS JOIN range(450, 550) k),
o_hit AS (SELECT s.patient_id, s.beam_id, s.beamlet_id, min(t) AS entry_mm, max(t) AS exit_mm FROM o_smp s JOIN v_voxel v ON v.patient_id = s.patient_id AND v.ix = s.ix::bigint AND v.iy = s.iy::bigint AND v.iz = s.iz::bigint AND v.hu > 0 GROUP BY 1, 2, 3)"""


def body(t):
    return t.voxel.filter("hu > 0")


def windows(t, **grid):
    return ge.beam_windows(beams(t), body(t), **grid)


def near_rays(t, **grid):
    return ge.points_in_windows(windows(t, **grid), lattice(t))


def far_rays(t, **grid):
    """The other rays, which meet no cell of the body."""
    return ge.source_and_beamlet_points(windows(t, **grid), lattice(t)).filter(~ge.in_window())


PATCH = ((60.0, 11.0, 9.0), (4, 2, 2), 970.0)


def patches(t, **grid):
    shot = near_rays(t, **grid)
    entry = ge.ray_march(shot, body(t), **grid).drop("exit_mm")
    near = shot.join(entry, ["patient_id", "beam_id", "beamlet_id"], "left")
    place = {"origin": None, "spacing": None, **grid}
    r = ge.ray_patch(near, body(t), place.pop("origin"), place.pop("spacing"), *PATCH, **place, missed=far_rays(t, **grid))
    return r.select("patient_id", "beam_id", "beamlet_id", *[F.col(p).cast("long").alias(p) for p in ("px", "py", "pz")],
                    "d1_mm", *[snap(F.col(c), 4).alias(c) for c in ("d2_mm", "outside_mm", "inside_mm")])


@query("ray_march", f"{MARCH_SQL} SELECT * FROM o_hit")
def ray_march(t):
    """The SQL samples 900 to 1100 mm, which holds every cell of this grid for rays through the isocentre plane."""
    return ge.ray_march(near_rays(t, origin=ORIGIN, spacing=SPACING), body(t), ORIGIN, SPACING)


@query("radiological_depth", f"""SELECT patient_id, ix, iy, iz, {S6.format("CASE WHEN hu > -500 THEN 3.0::double * sum(CASE WHEN hu > -500 THEN least(greatest(hu + 1000, 0), 3000) / 1000.0::double ELSE 0 END) OVER (PARTITION BY patient_id, ix, iy ORDER BY iz DESC) ELSE 0 END")} AS depth_mm FROM v_voxel""")
def radiological_depth(t):
    r = ge.radiological_depth(t.voxel, t.voxel.filter("hu > -500"), 3.0)
    return r.withColumn("depth_mm", snap(F.col("depth_mm")))


DIRECTION = (0.37, -0.21, 0.83)
TURN = ge.axis_rotation(DIRECTION)


def _turn_sql(name, source, rotation):
    q = [f"({r[0]!r}::double * x + {r[1]!r}::double * y + {r[2]!r}::double * z + 1) * {h}" for r, h in zip(rotation, ("12.0::double", "9.5::double", "1.0::double"))]
    return f"""{name}_f AS (SELECT patient_id, ix AS jx, iy AS jy, iz AS jz, {q[0]} AS fx, {q[1]} AS fy, {q[2]} AS fz FROM (SELECT *, ix * (2.0::double / 24) - 1 AS x, iy * (2.0::double / 19) - 1 AS y, iz * 1.0::double - 1 AS z FROM {source})),
{name}_c AS (SELECT patient_id, jx, jy, jz, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
 (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
 FROM {name}_f CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c))"""


@query("radiological_depth_along", f"""o_rho AS (SELECT patient_id, ix, iy, iz, CASE WHEN hu > -500 THEN least(greatest(hu + 1000, 0), 3000) / 1000.0::double ELSE 0 END AS rho FROM v_voxel),
{_turn_sql('o_t', 'v_voxel', TURN)}, o_turned AS (SELECT c.patient_id, jx, jy, jz, sum(w * coalesce(r.rho, 0)) AS rho FROM o_t_c c LEFT JOIN o_rho r USING (patient_id, ix, iy, iz) GROUP BY 1, 2, 3, 4),
o_cum AS (SELECT patient_id, jx AS ix, jy AS iy, jz AS iz, 3 * sum(rho) OVER (PARTITION BY patient_id, jx, jy ORDER BY jz DESC) AS d FROM o_turned),
o_body AS (SELECT * FROM v_voxel WHERE hu > -500), {_turn_sql('o_h', 'o_body', list(zip(*TURN)))}
SELECT c.patient_id, jx AS ix, jy AS iy, jz AS iz, {S4.format('sum(w * coalesce(s.d, 0))')} AS depth_mm FROM o_h_c c LEFT JOIN o_cum s USING (patient_id, ix, iy, iz) GROUP BY 1, 2, 3, 4""")
def radiological_depth_along(t):
    r = ge.radiological_depth_along(t.voxel, t.voxel.filter("hu > -500"), DIRECTION, (25, 20, 3), 3.0)
    return r.withColumn("depth_mm", snap(F.col("depth_mm"), 4))


@query("beamlet_grid_from_structure", f"""{FRAME_SQL}, o_e AS (SELECT patient_id, beam_id, greatest(min(xp * (1000 / (1000 + yp))) - 5, -28) AS x1, least(max(xp * (1000 / (1000 + yp))) + 5, 26) AS x2, greatest(min(zp * (1000 / (1000 + yp))) - 5, -20) AS y1, least(max(zp * (1000 / (1000 + yp))) + 5, 33) AS y2
  FROM o_fr JOIN v_structure_voxel s USING (patient_id, voxel_id) WHERE s.structure = 'GTV' GROUP BY 1, 2),
o_n AS (SELECT *, ceil((x2 - x1 - 2.5::double + 1e-9) / 2.5::double)::bigint AS nx, ceil((y2 - y1 - 5 + 1e-9) / 5)::bigint AS ny FROM o_e)
SELECT patient_id, beam_id, r AS row, c AS col, {S4.format('x1 + (c + 0.5) * 2.5::double')} AS x_mm, {S4.format('y1 + (r + 0.5) * 5.0::double')} AS y_mm FROM (SELECT *, unnest(range(0, nx)) AS c FROM (SELECT *, unnest(range(0, ny)) AS r FROM o_n))""")
def beamlet_grid_from_structure(t):
    target = t.structure_voxel.filter("structure = 'GTV'").select("patient_id", "voxel_id")
    projected = ge.bev_projection(framed(t)).join(target, ["patient_id", "voxel_id"], "left_semi")
    r = ge.grid_from_projection(projected, 2.5, 5.0, 5.0, {"xmin": -28.0, "xmax": 26.0, "ymin": -20.0, "ymax": 33.0})
    return r.select("patient_id", "beam_id", "row", "col", snap(F.col("x_mm"), 4).alias("x_mm"), snap(F.col("y_mm"), 4).alias("y_mm"))


# Leaf edges in mm of a 60-pair collimator.
LEAF_EDGES = [float(y) for y in [*range(-200, -100, 10), *range(-100, 100, 5), *range(100, 201, 10)]]


@query("beamlet_rows_from_leaves", """
o_j AS (SELECT beam_id, -(beam_id % 5) * 10 - 12.3::double AS xmin, beam_id % 7 * 6 + 9.1::double AS xmax, -(beam_id % 6) * 15 - 20.0::double AS ymin, beam_id % 4 * 25 + 33.0::double AS ymax FROM v_beam),
o_r AS (SELECT j.*, r.range AS row, -200 + r.range * 10 + 5.0::double AS y_mm, 10.0::double AS height_mm, -(r.range % 3) * 5 - 3.0::double AS l, r.range % 4 * 5 + 2.0::double AS r FROM o_j j CROSS JOIN range(40) r WHERE -200 + r.range * 10 + 10 > ymin - 1e-9 AND -200 + r.range * 10 < ymax + 1e-9),
o_c AS (SELECT *, floor(xmin / 2.5::double) * 2.5::double + unnest(range(0, (ceil(-xmin / 2.5::double) + ceil(xmax / 2.5::double))::bigint)) * 2.5::double + 1.25::double AS x_mm FROM o_r)
SELECT beam_id, row, y_mm, height_mm, x_mm FROM o_c WHERE x_mm + 1.25 > greatest(xmin, l) AND x_mm - 1.25 < least(xmax, r)""")
def beamlet_rows_from_leaves(t):
    k = F.col("beam_id")
    b = t.beam.select(
        "beam_id", F.array(*[F.lit(e) for e in LEAF_EDGES]).alias("leaf_y_mm"), (-(k % 5) * 10 - 12.3).alias("xmin"), (k % 7 * 6 + 9.1).alias("xmax"),
        (-(k % 6) * 15 - 20.0).alias("ymin"), (k % 4 * 25 + 33.0).alias("ymax"),
    )
    opened = ge.leaf_rows(b, 7.5).withColumn("left_mm", -(F.col("row") % 3) * 5 - 3.0).withColumn("right_mm", F.col("row") % 4 * 5 + 2.0)
    r = ge.beamlets_from_leaves(opened, 2.5)
    return r.select("beam_id", F.col("row").cast("long").alias("row"), "y_mm", "height_mm", "x_mm")


@query("nearest_structure_distance", f"{NEAR_SQL} SELECT patient_id, voxel_id, {S4.format('sqrt(d2)')} AS distance_mm FROM o_near")
def nearest_structure_distance(t):
    return target_distance(t).select("patient_id", "voxel_id", snap(F.col("distance_mm"), 4).alias("distance_mm"))


@query("interior_ramp", f"""
o_m AS (SELECT * FROM v_structure_voxel WHERE structure = 'BOX'),
o_bd AS (SELECT s.patient_id, s.ix, s.iy, s.iz FROM o_m s LEFT JOIN o_m n ON n.patient_id = s.patient_id AND abs(n.ix - s.ix) + abs(n.iy - s.iy) + abs(n.iz - s.iz) = 1 GROUP BY 1, 2, 3, 4 HAVING count(n.ix) < 6),
o_d AS (SELECT s.patient_id, s.voxel_id, min(sqrt(pow((s.ix - b.ix) * 0.98::double, 2) + pow((s.iy - b.iy) * 0.98::double, 2) + pow((s.iz - b.iz) * 3.0::double, 2))) AS d FROM o_m s JOIN o_bd b USING (patient_id) GROUP BY 1, 2),
o_e AS (SELECT patient_id, min(d) AS d1, max(d) AS d2 FROM o_d GROUP BY 1)
SELECT d.patient_id, d.voxel_id, {S4.format('60 / exp((ln(72.0::double) - ln(60.0::double)) / (d2 - d1) * d1) * exp((ln(72.0::double) - ln(60.0::double)) / (d2 - d1) * d.d)')} AS ramp_gy FROM o_d d JOIN o_e USING (patient_id)""")
def interior_ramp(t):
    mask = t.structure_voxel.filter("structure = 'BOX'")
    edge = st.boundary_voxels(mask).join(mask.select("patient_id", "ix", "iy", "iz", "voxel_id"), st.CELL)
    r = ge.interior_ramp(mask.select("patient_id", "ix", "iy", "iz", "voxel_id"), edge, RES, 60.0, 72.0)
    return r.select("patient_id", "voxel_id", snap(F.col("ramp_gy"), 4).alias("ramp_gy"))


@query("quantize_distance", f"""o_q AS (SELECT patient_id, voxel_id, round_even(least(greatest(vol_u / 10000.0::double, 0), 2000) * (65535.0::double / 2000), 0)::bigint AS code FROM v_voxel)
SELECT patient_id, voxel_id, code, {S6.format('code * (2000 / 65535.0::double)')} AS distance_mm FROM o_q""")
def quantize_distance(t):
    q = t.voxel.select("patient_id", "voxel_id", ge.quantize(F.col("vol_u") / 10000.0).alias("code"))
    return q.withColumn("distance_mm", snap(ge.dequantize(F.col("code"))))


@query("ray_patch_grid", f"""{MARCH_SQL},
o_u AS (SELECT r.*, dx / n AS u1, dy / n AS u2, dz / n AS u3 FROM (SELECT o.*, b.r00, b.r10, b.r20, b.r02, b.r12, b.r22, sqrt(dx * dx + dy * dy + dz * dz) AS n FROM o_ray o JOIN o_rot b USING (patient_id, beam_id)) r),
o_v AS (SELECT *, r00 - p * u1 AS a1, r10 - p * u2 AS a2, r20 - p * u3 AS a3 FROM (SELECT *, r00 * u1 + r10 * u2 + r20 * u3 AS p FROM o_u)),
o_w AS (SELECT *, a1 / an AS v1, a2 / an AS v2, a3 / an AS v3 FROM (SELECT *, sqrt(a1 * a1 + a2 * a2 + a3 * a3) + 1e-12 AS an FROM o_v)),
o_z AS (SELECT *, CASE WHEN w1 * r02 + w2 * r12 + w3 * r22 < 0 THEN -1 ELSE 1 END AS s FROM (SELECT *, u2 * v3 - u3 * v2 AS w1, u3 * v1 - u1 * v3 AS w2, u1 * v2 - u2 * v1 AS w3 FROM o_w)),
o_c AS (SELECT z.*, x.range AS px, y.range AS py, q.range AS pz, 970 + (x.range + 0.5) * 15 AS d1, -5.5::double + (y.range + 0.5) * 5.5::double AS b, -4.5::double + (q.range + 0.5) * 4.5::double AS c FROM o_z z CROSS JOIN range(4) x CROSS JOIN range(2) y CROSS JOIN range(2) q),
o_at AS (SELECT *, round_even((sx + d1 * u1 + s * b * v1 + s * c * w1 + 30.3::double) / 2.5::double, 0)::bigint AS ix, round_even((sy + d1 * u2 + s * b * v2 + s * c * w2 + 24.1::double) / 2.5::double, 0)::bigint AS iy, round_even((sz + d1 * u3 + s * b * v3 + s * c * w3 + 2.9::double) / 3.0::double, 0)::bigint AS iz FROM o_c)
SELECT a.patient_id, a.beam_id, a.beamlet_id, a.px::bigint AS px, a.py::bigint AS py, a.pz::bigint AS pz, a.d1::double AS d1_mm, {S4.format('sqrt(b * b + c * c)')} AS d2_mm, {S4.format('coalesce(least(d1, h.entry_mm), d1)::double')} AS outside_mm,
 {S4.format('CASE WHEN v.hu > 0 AND h.entry_mm IS NOT NULL THEN greatest(d1 - h.entry_mm, 0) ELSE 0 END')} AS inside_mm
FROM o_at a LEFT JOIN o_hit h USING (patient_id, beam_id, beamlet_id) LEFT JOIN v_voxel v USING (patient_id, ix, iy, iz)""")
def ray_patch_grid(t):
    return patches(t, origin=ORIGIN, spacing=SPACING)
