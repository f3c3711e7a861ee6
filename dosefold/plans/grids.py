"""Grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import grids as vx
from dosefold.operators import structures as st
from dosefold.plans.evaluation import RX, S6
from dosefold.plans.registry import changed, query
from dosefold.plans.structures import BLOCK_CT_SQL, ORIGIN, RES, SIZE, block_ct

S4 = "floor(({}) * 1e4 + 0.5) / 1e4"


@query("voxel_map_build", """
o_pt2 AS (SELECT patient_id, max(voxel_id) AS pid, ix - ix % 2 AS ix, iy - iy % 3 AS iy, iz FROM v_voxel WHERE hu < 1000 GROUP BY 1, 3, 4, 5),
o_bx AS (SELECT patient_id, min(ix) AS x1, max(ix) AS x2, min(iy) AS y1, max(iy) AS y2, min(iz) AS z1, max(iz) AS z2 FROM o_pt2 GROUP BY 1),
o_q AS (SELECT v.patient_id, v.ix, v.iy, v.iz FROM v_voxel v JOIN o_bx b USING (patient_id) WHERE v.hu > -600 AND v.ix BETWEEN x1 AND x2 AND v.iy BETWEEN y1 AND y2 AND v.iz BETWEEN z1 AND z2)
SELECT patient_id, ix, iy, iz, pid AS voxel_id FROM (SELECT q.*, p.pid, row_number() OVER (PARTITION BY q.patient_id, q.ix, q.iy, q.iz
  ORDER BY (q.ix - p.ix) * (q.ix - p.ix) + (q.iy - p.iy) * (q.iy - p.iy) + (q.iz - p.iz) * (q.iz - p.iz), p.pid) AS k FROM o_q q JOIN o_pt2 p ON p.patient_id = q.patient_id) WHERE k = 1""")
def voxel_map_build(t):
    points = t.voxel.filter("hu < 1000").select(
        "patient_id", F.col("voxel_id").alias("point_id"),
        ((F.col("ix") - F.col("ix") % 2) * 0.98 - 5.0 + 0.3).alias("x_mm"), ((F.col("iy") - F.col("iy") % 3) * 0.98 + 3.0 - 0.2).alias("y_mm"),
        (F.col("iz") * 3.0 + 10.0 + 0.4).alias("z_mm"),
    )
    return vx.build_voxel_map(points, t.voxel.filter("hu > -600"), ORIGIN, RES, SIZE)


@query("voxel_map_uniform", """SELECT p.patient_id, p.ix + a.a AS ix, p.iy + b.b AS iy, p.iz, max(p.voxel_id) AS voxel_id FROM v_voxel p CROSS JOIN (VALUES (0), (1), (2)) a(a) CROSS JOIN (VALUES (0), (1)) b(b)
WHERE p.hu < 1000 AND p.ix + a.a < 25 AND p.iy + b.b < 20 GROUP BY 1, 2, 3, 4""")
def voxel_map_uniform(t):
    points = t.voxel.filter("hu < 1000").select(
        "patient_id", F.col("voxel_id").alias("point_id"), (F.col("ix") * 0.98 - 5.0 + 0.98).alias("x_mm"),
        (F.col("iy") * 0.98 + 3.0 + 0.49).alias("y_mm"), (F.col("iz") * 3.0 + 10.0).alias("z_mm"),
    )
    return vx.uniform_voxel_map(points, ORIGIN, RES, (2.94, 1.96, 3.0), SIZE)


DOSE_BLOCK_SQL = f"{BLOCK_CT_SQL}, o_bd AS (SELECT c.patient_id, c.voxel_id, avg(d.dose_gy) AS dose_gy FROM o_ct c JOIN v_voxel v USING (patient_id, ix, iy, iz) JOIN o_dose d ON d.patient_id = c.patient_id AND d.voxel_id = v.voxel_id AND d.plan_id = 'A' WHERE c.voxel_id IS NOT NULL GROUP BY 1, 2)"


def cell_dose(t):
    """Plan A dose on CT cells, each cell its own value."""
    return t.voxel.join(t.dose.filter("plan_id = 'A'"), ["patient_id", "voxel_id"]).select("patient_id", "ix", "iy", "iz", "dose_gy")


@query("dose_to_grid", f"{DOSE_BLOCK_SQL} SELECT c.patient_id, c.ix, c.iy, c.iz, {S6.format('coalesce(b.dose_gy, 0)')} AS dose_gy FROM o_ct c LEFT JOIN o_bd b USING (patient_id, voxel_id)")
def dose_to_grid(t):
    ct = block_ct(t)
    block = ct.filter("voxel_id IS NOT NULL").join(cell_dose(t), ["patient_id", "ix", "iy", "iz"]).groupBy("patient_id", "voxel_id").agg(F.avg("dose_gy").alias("dose_gy"))
    return vx.dose_to_grid(ct, block).withColumn("dose_gy", snap(F.col("dose_gy")))


@query("grid_to_dose", f"""{BLOCK_CT_SQL} SELECT c.patient_id, c.voxel_id, arg_max(d.dose_gy, (c.iz * 1000 + c.iy) * 1000 + c.ix) AS dose_gy
FROM o_ct c JOIN v_voxel v USING (patient_id, ix, iy, iz) JOIN o_dose d ON d.patient_id = c.patient_id AND d.voxel_id = v.voxel_id AND d.plan_id = 'A' WHERE c.voxel_id IS NOT NULL GROUP BY 1, 2""")
def grid_to_dose(t):
    return vx.grid_to_dose(block_ct(t), cell_dose(t))


DOSE_BLOCK_PLANS_SQL = changed(DOSE_BLOCK_SQL, ("SELECT c.patient_id, c.voxel_id, avg", "SELECT c.patient_id, d.plan_id, c.voxel_id, avg"), (" AND d.plan_id = 'A'", ""), ("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)"))


def cell_dose_plans(t):
    """Dose of every plan on CT cells, each cell its own value."""
    return t.voxel.join(t.dose, ["patient_id", "voxel_id"]).select("patient_id", "plan_id", "ix", "iy", "iz", "dose_gy")


@query("dose_to_grid_plans", f"""{DOSE_BLOCK_PLANS_SQL}, o_pl AS (SELECT DISTINCT patient_id, plan_id FROM o_dose)
SELECT c.patient_id, p.plan_id, c.ix, c.iy, c.iz, {S6.format('coalesce(b.dose_gy, 0)')} AS dose_gy FROM o_ct c JOIN o_pl p USING (patient_id) LEFT JOIN o_bd b ON b.patient_id = c.patient_id AND b.plan_id = p.plan_id AND b.voxel_id = c.voxel_id""")
def dose_to_grid_plans(t):
    ct = block_ct(t)
    block = ct.filter("voxel_id IS NOT NULL").join(cell_dose_plans(t), ["patient_id", "ix", "iy", "iz"]).groupBy(
        "patient_id", "plan_id", "voxel_id").agg(F.avg("dose_gy").alias("dose_gy"))
    return vx.dose_to_grid(ct, block).withColumn("dose_gy", snap(F.col("dose_gy")))


@query("grid_to_dose_plans", f"""{BLOCK_CT_SQL} SELECT c.patient_id, d.plan_id, c.voxel_id, arg_max(d.dose_gy, (c.iz * 1000 + c.iy) * 1000 + c.ix) AS dose_gy
FROM o_ct c JOIN v_voxel v USING (patient_id, ix, iy, iz) JOIN o_dose d ON d.patient_id = c.patient_id AND d.voxel_id = v.voxel_id WHERE c.voxel_id IS NOT NULL GROUP BY 1, 2, 3""")
def grid_to_dose_plans(t):
    return vx.grid_to_dose(block_ct(t), cell_dose_plans(t))


@query("calc_box_crop", "SELECT patient_id, ix, iy, iz, hu FROM v_voxel WHERE ix >= 4 AND ix < 20 AND iy >= 2 AND iy < 15 AND iz BETWEEN 1 AND 2")
def calc_box_crop(t):
    r = vx.crop_box(t.voxel, (-1.2, 5.0, 13.2), (14.7, 17.5, 15.9), ORIGIN, RES)
    return r.select("patient_id", "ix", "iy", "iz", "hu")


@query("slice_window", """o_l AS (SELECT patient_id, min(iy) AS f, max(iy) AS l FROM v_structure_voxel WHERE structure = 'BOX' AND ix > 12 GROUP BY 1)
SELECT patient_id, greatest(0, greatest(0, f - (13 - (l - f + 1) - (13 - (l - f + 1)) // 2)) - greatest(0, (13 - (l - f + 1)) // 2 + greatest(0, (13 - (l - f + 1) - (13 - (l - f + 1)) // 2) - f) - (20 - l - 1)))::bigint AS z_start,
 least(19, l + (13 - (l - f + 1)) // 2 + greatest(0, (13 - (l - f + 1) - (13 - (l - f + 1)) // 2) - f))::bigint AS z_end,
 5::bigint AS y_start, 15::bigint AS y_end, 7::bigint AS x_start, 17::bigint AS x_end FROM o_l""")
def slice_window(t):
    """The y axis plays the slice axis here, so the window has room to move."""
    labels = t.structure_voxel.filter("structure = 'BOX' OR structure = 'CORD'").select(
        "patient_id", F.col("iy").alias("iz"), F.when((F.col("structure") == "BOX") & (F.col("ix") > 12), 3).otherwise(1).alias("label")
    )
    return vx.slice_window(labels, 20, (25, 20), window=13, half=5)


def iso_box(t):
    """Targets of a 1.3 mm box around the body centre with source indices."""
    cells = vx.reference_box(t.voxel, 13.1, ORIGIN, RES, (1.3, 1.7, 1.9), (12, 9, 4))
    return vx.fractional_index(cells, ORIGIN, RES)


BOX_SQL = """o_bc AS (SELECT patient_id, avg(ix) * 0.98::double - 5 AS cx, avg(iy) * 0.98::double + 3 AS cy FROM v_voxel GROUP BY 1),
o_tg AS (SELECT patient_id, x.range AS jx, y.range AS jy, z.range AS jz, cx - 1.3::double * 11 / 2 + x.range * 1.3::double AS x_mm, cy - 1.7::double * 8 / 2 + y.range * 1.7::double AS y_mm, 13.1::double - 1.9::double * 3 / 2 + z.range * 1.9::double AS z_mm
  FROM o_bc CROSS JOIN range(12) x CROSS JOIN range(9) y CROSS JOIN range(4) z),
o_fi AS (SELECT *, (x_mm + 5) / 0.98::double AS fx, (y_mm - 3) / 0.98::double AS fy, (z_mm - 10) / 3.0::double AS fz FROM o_tg),
o_co AS (SELECT t.*, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
   (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
  FROM o_fi t CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c))"""


@query("reference_box", f"{BOX_SQL} SELECT patient_id, jx, jy, jz, {S4.format('x_mm')} AS x_mm, {S4.format('y_mm')} AS y_mm, {S4.format('z_mm')} AS z_mm FROM o_tg")
def reference_box(t):
    r = vx.reference_box(t.voxel, 13.1, ORIGIN, RES, (1.3, 1.7, 1.9), (12, 9, 4))
    return r.select("patient_id", "jx", "jy", "jz", *[snap(F.col(c), 4).alias(c) for c in ("x_mm", "y_mm", "z_mm")])


J = ["patient_id", "jx", "jy", "jz"]


@query("resample_linear", f"""{BOX_SQL} SELECT c.patient_id, c.jx, c.jy, c.jz, {S4.format('CASE WHEN count(v.hu) = count(*) THEN sum(c.w * v.hu) ELSE -7 END')} AS value
FROM o_co c LEFT JOIN v_voxel v USING (patient_id, ix, iy, iz) WHERE c.w > 0 GROUP BY 1, 2, 3, 4""")
def resample_linear(t):
    source = t.voxel.select("patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("value"))
    return vx.resample_linear(iso_box(t), source, J, "value", -7.0).withColumn("value", snap(F.col("value"), 4))


@query("resample_nearest", f"""{BOX_SQL} SELECT t.patient_id, t.jx, t.jy, t.jz, coalesce(v.hu, -7)::double AS value FROM o_fi t
LEFT JOIN v_voxel v ON v.patient_id = t.patient_id AND v.ix = floor(t.fx + 0.5)::bigint AND v.iy = floor(t.fy + 0.5)::bigint AND v.iz = floor(t.fz + 0.5)::bigint""")
def resample_nearest(t):
    source = t.voxel.select("patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("value"))
    return vx.resample_nearest(iso_box(t), source, J, "value", -7.0)


@query("resample_masked", f"""{BOX_SQL}, o_m AS (SELECT c.patient_id, c.jx, c.jy, c.jz, CASE WHEN count(v.hu) = count(*) THEN sum(CASE WHEN v.hu > 0 THEN c.w * v.hu ELSE 0 END) ELSE 0 END AS a,
  CASE WHEN count(v.hu) = count(*) THEN sum(CASE WHEN v.hu > 0 THEN c.w ELSE 0 END) ELSE 0 END AS b FROM o_co c LEFT JOIN v_voxel v USING (patient_id, ix, iy, iz) WHERE c.w > 0 GROUP BY 1, 2, 3, 4)
SELECT patient_id, jx, jy, jz, {S4.format('CASE WHEN b > 0.001 THEN a / (b + 0.000001::double) ELSE -7 END')} AS value, {S4.format('b')} AS valid_weight FROM o_m""")
def resample_masked(t):
    source = t.voxel.select("patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("value"), (F.col("hu") > 0).cast("double").alias("valid"))
    r = vx.resample_masked(iso_box(t), source, J, "value", "valid", -7.0)
    return r.withColumn("value", snap(F.col("value"), 4)).withColumn("valid_weight", snap(F.col("valid_weight"), 4))


@query("paste_back", "SELECT v.patient_id, v.ix, v.iy, v.iz, coalesce(s.hu, 0)::double AS value FROM v_voxel v LEFT JOIN v_voxel s ON s.patient_id = v.patient_id AND s.ix = v.ix - 3 AND s.iy = v.iy - 2 AND s.iz = v.iz - 1 AND s.ix < 9 AND s.iy < 11")
def paste_back(t):
    cropped = t.voxel.filter("ix < 9 AND iy < 11").select("patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("value"))
    return vx.paste_back(t.voxel, cropped, (3, 2, 1), "value")


@query("axial_slice", """o_n AS (SELECT patient_id, voxel_id, string_agg(structure, ',' ORDER BY structure) AS structures FROM v_structure_voxel WHERE iz = 1 GROUP BY 1, 2)
SELECT v.patient_id, v.ix, v.iy, v.iz, d.plan_id, v.hu, d.dose_gy, CASE WHEN dose_gy >= 1.1::double * 60 THEN 1.1::double WHEN dose_gy >= 60 THEN 1.0::double WHEN dose_gy >= 0.9::double * 60 THEN 0.9::double WHEN dose_gy >= 0.7::double * 60 THEN 0.7::double
 WHEN dose_gy >= 30 THEN 0.5::double WHEN dose_gy >= 0.3::double * 60 THEN 0.3::double END AS level, n.structures FROM v_voxel v JOIN o_dose d USING (patient_id, voxel_id) JOIN o_n n USING (patient_id, voxel_id) WHERE v.iz = 1""")
def axial_slice(t):
    dose = t.voxel.select("patient_id", "voxel_id", "ix", "iy", "iz").join(t.dose, ["patient_id", "voxel_id"])
    return vx.axial_slice(t.voxel, dose, t.structure_voxel, 1, RX, [0.3, 0.5, 0.7, 0.9, 1.0, 1.1])


@query("hu_normalize", f"SELECT patient_id, voxel_id, {S6.format('(least(greatest(hu * 2, -1000), 3071) + 1000) / 4071.0::double')} AS ct_norm FROM v_voxel")
def hu_normalize(t):
    return t.voxel.select("patient_id", "voxel_id", snap(vx.hu_normalize(F.col("hu") * 2)).alias("ct_norm"))


KNOT_SQL = "o_k(x, y) AS (VALUES " + ", ".join(f"({x}::double, {y}::double)" for x, y in zip(vx.DENSITY_HU, vx.DENSITY_VALUE)) + "), o_kk AS (SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM o_k)"


@query("hu_to_density", f"""{KNOT_SQL} SELECT v.patient_id, v.voxel_id, {S6.format('least(1, greatest(0, (y1 + (h - x1) * ((y2 - y1) / (x2 - x1))) / 3.79::double))')} AS density
FROM (SELECT patient_id, voxel_id, hu * 3.0::double AS h FROM v_voxel) v JOIN o_kk k ON (v.h > k.x1 OR k.x1 = -3000) AND v.h <= k.x2""")
def hu_to_density(t):
    return t.voxel.select("patient_id", "voxel_id", snap(vx.hu_to_density(F.col("hu") * 3)).alias("density"))


@query("downsample_masked", f"""
o_t AS (SELECT patient_id, x.range AS jx, y.range AS jy, z.range AS jz, x.range * (24.0::double / 9) AS fx, y.range * (19.0::double / 6) AS fy, z.range * 2.0::double AS fz FROM (SELECT DISTINCT patient_id FROM v_voxel) CROSS JOIN range(10) x CROSS JOIN range(7) y CROSS JOIN range(2) z),
o_in AS (SELECT t.* FROM o_t t JOIN v_voxel v ON v.patient_id = t.patient_id AND v.ix = floor(fx + 0.5)::bigint AND v.iy = floor(fy + 0.5)::bigint AND v.iz = floor(fz + 0.5)::bigint AND v.hu > 0),
o_lin AS (SELECT t.patient_id, t.jx, t.jy, t.jz, sum(w * v.hu) AS lin FROM (SELECT t.*, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
   (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
   FROM o_in t CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c)) t JOIN v_voxel v USING (patient_id, ix, iy, iz) WHERE w > 0 GROUP BY 1, 2, 3, 4),
o_low AS (SELECT t.patient_id, t.jx, t.jy, t.jz, min(v.hu) AS low FROM o_in t JOIN v_voxel v ON v.patient_id = t.patient_id AND v.hu > 0
  AND v.ix BETWEEN floor(fx + 0.5) - 1 AND floor(fx + 0.5) + 1 AND v.iy BETWEEN floor(fy + 0.5) - 1 AND floor(fy + 0.5) + 1 AND v.iz BETWEEN floor(fz + 0.5) - 1 AND floor(fz + 0.5) GROUP BY 1, 2, 3, 4)
SELECT t.patient_id, t.jx, t.jy, t.jz, {S4.format('coalesce(greatest(l.lin, m.low), 0)')} AS value FROM o_t t LEFT JOIN o_lin l USING (patient_id, jx, jy, jz) LEFT JOIN o_low m USING (patient_id, jx, jy, jz)""")
def downsample_masked(t):
    source = t.voxel.select("patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("value"))
    r = vx.downsample_masked(source, t.voxel.filter("hu > 0"), "value", SIZE, (10, 7, 2))
    return r.withColumn("value", snap(F.col("value"), 4))
