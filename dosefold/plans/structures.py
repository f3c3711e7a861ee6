"""Structure algebra queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions import headers as hd
from dosefold.functions.numeric import snap
from dosefold.operators import criteria
from dosefold.operators import evaluation as ev
from dosefold.operators import grids
from dosefold.operators import structures as st
from dosefold.plans import criteria as cr
from dosefold.plans.evaluation import RX, S6
from dosefold.plans.registry import changed, query

RES = (0.98, 0.98, 3.0)
SIZE = (25, 20, 3)
VOX_MM3 = 0.98 * 0.98 * 3.0
V = "SELECT patient_id, ix, iy, iz FROM v_structure_voxel WHERE structure = '{}'"


def m(t, name):
    return st.mask_of(t.structure_voxel, name)


@query("structure_union", f"{V.format('PTV')} UNION {V.format('BOX')}")
def structure_union(t):
    return st.union(m(t, "PTV"), m(t, "BOX"))


@query("structure_intersect", f"{V.format('PTV')} INTERSECT {V.format('BOX')}")
def structure_intersect(t):
    return st.intersect(m(t, "PTV"), m(t, "BOX"))


@query("structure_subtract", f"{V.format('PTV')} EXCEPT {V.format('BOX')}")
def structure_subtract(t):
    return st.subtract(m(t, "PTV"), m(t, "BOX"))


def grow_sql(source, k, m_flat, name):
    """Offsets with max norm <= k and L1 <= 2k, then an in-plane square."""
    return f"""{name}_a AS (SELECT DISTINCT s.patient_id, s.ix + x.d AS ix, s.iy + y.d AS iy, s.iz + z.d AS iz FROM ({source}) s
  CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) x CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) y
  CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) z
  WHERE abs(x.d) + abs(y.d) + abs(z.d) <= {2 * k} AND s.ix + x.d BETWEEN 0 AND 24 AND s.iy + y.d BETWEEN 0 AND 19 AND s.iz + z.d BETWEEN 0 AND 2),
{name} AS (SELECT DISTINCT s.patient_id, s.ix + x.d AS ix, s.iy + y.d AS iy, s.iz FROM {name}_a s
  CROSS JOIN (SELECT range - {m_flat} AS d FROM range({2 * m_flat + 1})) x CROSS JOIN (SELECT range - {m_flat} AS d FROM range({2 * m_flat + 1})) y
  WHERE s.ix + x.d BETWEEN 0 AND 24 AND s.iy + y.d BETWEEN 0 AND 19)"""


def shrink_sql(source, k, m_flat, name):
    """A cell survives when all its offsets are members."""
    n = sum(1 for x in range(-k, k + 1) for y in range(-k, k + 1) for z in range(-k, k + 1) if abs(x) + abs(y) + abs(z) <= 2 * k)
    return f"""{name}_a AS (SELECT s.patient_id, s.ix - x.d AS ix, s.iy - y.d AS iy, s.iz - z.d AS iz FROM ({source}) s
  CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) x CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) y
  CROSS JOIN (SELECT range - {k} AS d FROM range({2 * k + 1})) z WHERE abs(x.d) + abs(y.d) + abs(z.d) <= {2 * k}
  GROUP BY 1, 2, 3, 4 HAVING count(*) = {n}),
{name} AS (SELECT s.patient_id, s.ix - x.d AS ix, s.iy - y.d AS iy, s.iz FROM {name}_a s
  CROSS JOIN (SELECT range - {m_flat} AS d FROM range({2 * m_flat + 1})) x CROSS JOIN (SELECT range - {m_flat} AS d FROM range({2 * m_flat + 1})) y
  GROUP BY 1, 2, 3, 4 HAVING count(*) = {(2 * m_flat + 1) ** 2})"""


@query("structure_expand", grow_sql(V.format("GTV"), 1, 2, "g") + " SELECT * FROM g")
def structure_expand(t):
    return st.expand(m(t, "GTV"), 3.0, RES, SIZE)


@query("structure_expand_wide", grow_sql(V.format("BOX"), 2, 0, "g") + " SELECT * FROM g")
def structure_expand_wide(t):
    return st.expand(m(t, "BOX"), 2.0, (0.98, 0.98, 1.0), SIZE)


@query("structure_shrink", shrink_sql(V.format("BODY"), 1, 2, "g") + " SELECT * FROM g")
def structure_shrink(t):
    return st.shrink(m(t, "BODY"), 3.0, RES)


@query("structure_shrink_box", shrink_sql(V.format("BOX"), 1, 0, "g") + " SELECT * FROM g")
def structure_shrink_box(t):
    return st.shrink(m(t, "BOX"), 1.0, RES)


@query("structure_expression", grow_sql(V.format("GTV"), 1, 1, "g") + f""",
e1 AS (SELECT * FROM g EXCEPT {V.format('PTV')}), e2 AS (SELECT * FROM e1 UNION {V.format('BOX')})
SELECT * FROM e2 INTERSECT ({V.format('CORD')} UNION {V.format('BOX')})""")
def structure_expression(t):
    return st.evaluate_expression(t.structure_voxel, "GTV + 2 - PTV | BOX & (CORD + BOX)", RES, SIZE)


@query("optimization_structures", grow_sql(V.format("BOX"), 1, 2, "g") + "," + grow_sql(V.format("GTV"), 1, 0, "h") + f"""
SELECT 'RIND' AS structure, * FROM ((SELECT * FROM g EXCEPT {V.format('BOX')}) INTERSECT {V.format('BODY')})
UNION ALL SELECT 'NEAR_GTV' AS structure, * FROM (SELECT * FROM h INTERSECT {V.format('BODY')})""")
def optimization_structures(t):
    definitions = [("RIND", "(BOX + 3) - BOX"), ("NEAR_GTV", "GTV + 1"), ("PTV", "GTV + 5"), ("BROKEN", "GTV + MISSING"), ("BAD", "GTV ?")]
    return st.optimization_structures(t.structure_voxel, definitions, RES, SIZE)


@query("structure_infinite", f"SELECT p.patient_id, x.ix, y.iy, z.iz FROM (SELECT DISTINCT patient_id FROM v_structure_voxel WHERE structure = 'PTV') p, (SELECT unnest(range(25)) AS ix) x, (SELECT unnest(range(20)) AS iy) y, (SELECT unnest(range(3)) AS iz) z EXCEPT {V.format('PTV')}")
def structure_infinite(t):
    return st.evaluate_expression(t.structure_voxel, "PTV + inf - PTV", RES, SIZE)


@query("optimization_structure_chain", grow_sql(V.format("PTV"), 1, 2, "g") + f""",
r1 AS ((SELECT * FROM g EXCEPT {V.format('PTV')}) INTERSECT {V.format('BODY')}), r2 AS ((SELECT * FROM r1 EXCEPT {V.format('BOX')}) INTERSECT {V.format('BODY')})
SELECT 'RIND_1' AS structure, * FROM r1 UNION ALL SELECT 'RIND_2' AS structure, * FROM r2""")
def optimization_structure_chain(t):
    definitions = [("RIND_1", "(PTV + 3) - PTV"), ("RIND_2", "RIND_1 - BOX"), ("RIND_2", "GTV + 1"), ("RIND_3", "RIND_4 + 1")]
    return st.optimization_structures(t.structure_voxel, definitions, RES, SIZE)


BLOCK = "v.iz * 130 + v.iy // 2 * 13 + v.ix // 2"


def block_ct(t):
    """CT cells with a coarser dose voxel id, NULL outside the calculation box."""
    block = F.col("iz") * 130 + F.floor(F.col("iy") / 2) * 13 + F.floor(F.col("ix") / 2)
    return t.ct_voxel.select("patient_id", "ix", "iy", "iz", "hu", F.when(F.col("dose_voxel").isNotNull(), block).alias("voxel_id"))


BLOCK_CT_SQL = f"o_ct AS (SELECT v.patient_id, v.ix, v.iy, v.iz, CASE WHEN b.voxel_id IS NOT NULL THEN {BLOCK} END AS voxel_id FROM v_voxel v LEFT JOIN o_box b USING (patient_id, voxel_id))"


@query("structure_volume", f"SELECT patient_id, structure, {S6.format('n * 2.8812 / 1000')} AS volume_cc, {S6.format('frac')} AS frac_in_box FROM o_struct")
def structure_volume(t):
    r = st.structure_volume(t.structure_voxel, block_ct(t), VOX_MM3)
    return r.select("patient_id", "structure", snap(F.col("volume_cc")).alias("volume_cc"), snap(F.col("frac_in_box")).alias("frac_in_box"))


OPT_SQL = f"""{BLOCK_CT_SQL} SELECT s.patient_id, s.structure, c.voxel_id, {S6.format('count(*) * 2.8812 / 1000')} AS volume_cc
FROM v_structure_voxel s JOIN o_ct c USING (patient_id, ix, iy, iz) WHERE c.voxel_id {{}} GROUP BY 1, 2, 3"""


@query("structure_opt_voxels", OPT_SQL.format("> 0"))
def structure_opt_voxels(t):
    return st.structure_opt_voxels(t.structure_voxel, block_ct(t), VOX_MM3).withColumn("volume_cc", snap(F.col("volume_cc")))


@query("structure_opt_voxels_with_zero", OPT_SQL.format(">= 0"))
def structure_opt_voxels_with_zero(t):
    return st.structure_opt_voxels(t.structure_voxel, block_ct(t), VOX_MM3, include_zero=True).withColumn("volume_cc", snap(F.col("volume_cc")))


@query("structure_drop", "SELECT patient_id, structure, ix, iy, iz FROM v_structure_voxel WHERE structure NOT IN ('BODY', 'BOX')")
def structure_drop(t):
    return st.drop_structures(t.structure_voxel, ["BODY", "BOX"]).select("patient_id", "structure", "ix", "iy", "iz")


@query("structure_alias", """o_names AS (SELECT DISTINCT patient_id, structure FROM v_structure_voxel)
SELECT p.patient_id, q.requested, n.structure AS actual FROM (SELECT DISTINCT patient_id FROM v_voxel) p
CROSS JOIN (VALUES ('ptv', 'PTV'), ('SpinalCord', 'CORD'), ('Lung_l', 'LUNG_L'), ('Liver', 'LIVER')) q(requested, resolved)
LEFT JOIN o_names n ON n.patient_id = p.patient_id AND n.structure = q.resolved""")
def structure_alias(t):
    asked = F.array(*[F.lit(n) for n in ("ptv", "SpinalCord", "Lung_l", "Liver")])
    requests = t.voxel.select("patient_id").distinct().withColumn("requested", F.explode(asked))
    return st.resolve_names(requests, t.structure_voxel, {"SPINALCORD": "CORD"}).select("patient_id", "requested", "actual")


@query("derived_structures", f"""SELECT 'TOTAL LUNG - GTV' AS structure, * FROM (({V.format('LUNG_L')} UNION {V.format('LUNG_R')}) EXCEPT {V.format('GTV')})
UNION ALL SELECT 'HEART_REST' AS structure, * FROM ({V.format('HEART')})
UNION ALL SELECT 'BOX_REST' AS structure, * FROM (({V.format('BOX')} UNION {V.format('CORD')}) EXCEPT {V.format('PTV')})""")
def derived_structures(t):
    s = t.structure_voxel
    made = [
        ("TOTAL LUNG - GTV", st.derived_structure(s, "LUNGS_NOT_GTV", ["LUNG_L", "LUNG_R"], "GTV")),
        ("HEART_REST", st.derived_structure(s, "HEART", ["BOX"])),
        ("BOX_REST", st.derived_structure(s, "ABSENT", ["BOX", "CORD"], "PTV")),
    ]
    parts = [d.select(F.lit(n).alias("structure"), *st.CELL) for n, d in made]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("label_map", """o_l(structure, label, priority) AS (VALUES ('CORD', 1, 0), ('BOX', 2, 1), ('HEART', 3, 2), ('LUNG_L', 4, 3))
SELECT s.patient_id, s.ix, s.iy, s.iz, cast(coalesce(arg_max(l.label, l.priority), 0) as bigint) AS label,
 cast(max(CASE WHEN s.structure = 'PTV' THEN 1 ELSE 0 END) as bigint) AS target
FROM v_structure_voxel s LEFT JOIN o_l l USING (structure) WHERE l.label IS NOT NULL OR s.structure = 'PTV' GROUP BY 1, 2, 3, 4""")
def label_map(t):
    return st.label_map(t.structure_voxel, [("CORD", 1), ("BOX", 2), ("HEART", 3), ("LUNG_L", 4)])


ORIGIN = (-5.0, 3.0, 10.0)
CENTER_SQL = f"""SELECT patient_id, voxel_id, {S6.format('(min(ix) + max(ix)) / 2.0::double * 0.98::double - 5')} AS x_mm,
{S6.format('(min(iy) + max(iy)) / 2.0::double * 0.98::double + 3')} AS y_mm, {S6.format('(min(iz) + max(iz)) / 2.0::double * 3.0::double + 10')} AS z_mm
FROM o_ct WHERE voxel_id IS NOT NULL GROUP BY 1, 2"""


def centers(t):
    c = grids.voxel_centers(block_ct(t), ORIGIN, RES)
    return c.select("patient_id", "voxel_id", *[snap(F.col(a)).alias(a) for a in ("x_mm", "y_mm", "z_mm")])


@query("voxel_membership", f"""{BLOCK_CT_SQL}, o_c AS ({CENTER_SQL}),
o_m AS (SELECT c.patient_id, c.voxel_id, string_agg(DISTINCT s.structure, ',' ORDER BY s.structure) AS structures
  FROM o_ct c JOIN v_structure_voxel s USING (patient_id, ix, iy, iz) WHERE c.voxel_id IS NOT NULL GROUP BY 1, 2)
SELECT * FROM o_c LEFT JOIN o_m USING (patient_id, voxel_id)""")
def voxel_membership(t):
    return st.voxel_membership(t.structure_voxel, block_ct(t), centers(t))


@query("voxel_centers", f"{BLOCK_CT_SQL} {CENTER_SQL}")
def voxel_centers(t):
    return centers(t)


@query("boundary_voxels", """SELECT s.structure, s.patient_id, s.ix, s.iy, s.iz FROM v_structure_voxel s
LEFT JOIN v_structure_voxel n ON n.patient_id = s.patient_id AND n.structure = s.structure
 AND n.ix BETWEEN s.ix - 1 AND s.ix + 1 AND n.iy BETWEEN s.iy - 1 AND s.iy + 1 AND n.iz BETWEEN s.iz - 1 AND s.iz + 1
 AND abs(n.ix - s.ix) + abs(n.iy - s.iy) + abs(n.iz - s.iz) = 1
GROUP BY 1, 2, 3, 4, 5 HAVING count(n.ix) < 6""")
def boundary_voxels(t):
    return st.boundary_voxels(t.structure_voxel)


@query("connected_regions", """o_g AS (SELECT patient_id, structure, ix, iy, iz, ix - row_number() OVER (PARTITION BY patient_id, structure, iz, iy ORDER BY ix) AS island FROM v_structure_voxel),
o_run AS (SELECT patient_id, structure, iz, iy, min(ix) AS x1, max(ix) AS x2, (iz * 1000 + iy) * 1000 + min(ix) AS code FROM o_g GROUP BY patient_id, structure, iz, iy, island),
o_adj AS (SELECT a.patient_id, a.structure, a.code AS a, b.code AS b FROM o_run a JOIN o_run b ON a.patient_id = b.patient_id AND a.structure = b.structure
  AND abs(a.iy - b.iy) + abs(a.iz - b.iz) = 1 AND a.x1 <= b.x2 AND a.x2 >= b.x1),
o_reach(patient_id, structure, a, b) AS (SELECT patient_id, structure, code, code FROM o_run
  UNION SELECT r.patient_id, r.structure, r.a, j.b FROM o_reach r JOIN o_adj j ON j.patient_id = r.patient_id AND j.structure = r.structure AND j.a = r.b),
o_low AS (SELECT patient_id, structure, a, min(b) AS low FROM o_reach GROUP BY 1, 2, 3),
o_num AS (SELECT patient_id, structure, a, dense_rank() OVER (PARTITION BY patient_id, structure ORDER BY low) AS region FROM o_low)
SELECT m.patient_id, m.structure, n.region, unnest(range(m.x1, m.x2 + 1)) AS ix, m.iy, m.iz FROM o_run m JOIN o_num n ON n.patient_id = m.patient_id AND n.structure = m.structure AND n.a = m.code""", recursive=True)
def connected_regions(t):
    return st.connected_regions(t.structure_voxel)


# --- patients with grids of their own ---------------------------------------

HEADER_SQL = """o_h AS (SELECT DISTINCT patient_id, patient_id * 10.0::double AS ox, 0.5::double - patient_id AS oy, 3.0::double AS oz,
 0.75::double + patient_id % 3 * 0.5 AS sx, 0.5::double + patient_id % 2 AS sy, 2.0::double + patient_id % 4 AS sz FROM v_voxel)"""


def headers(t):
    """Patients with different origins and spacings over the same indices."""
    p = F.col("patient_id")
    three = lambda x, y, z: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))
    size = F.struct(*[F.lit(n).alias(a) for n, a in zip(SIZE, ("x", "y", "z"))])
    return t.voxel.select("patient_id").distinct().select(
        p, three(p * 10, 0.5 - p, F.lit(3.0)).alias("origin"), three(0.75 + p % 3 * 0.5, 0.5 + p % 2, 2.0 + p % 4).alias("spacing"), size.alias("size")
    )


@query("structure_volume_headers", f"{HEADER_SQL} SELECT s.patient_id, s.structure, {S6.format('s.n * h.sx * h.sy * h.sz / 1000')} AS volume_cc, {S6.format('s.frac')} AS frac_in_box FROM o_struct s JOIN o_h h USING (patient_id)")
def structure_volume_headers(t):
    r = hd.structure_volume(t.structure_voxel, block_ct(t), headers(t))
    return r.select("patient_id", "structure", *[snap(F.col(c)).alias(c) for c in ("volume_cc", "frac_in_box")])


@query("voxel_centers_headers", f"""{BLOCK_CT_SQL}, {HEADER_SQL}, o_e AS (SELECT patient_id, voxel_id, (min(ix) + max(ix)) / 2.0 AS mx, (min(iy) + max(iy)) / 2.0 AS my, (min(iz) + max(iz)) / 2.0 AS mz FROM o_ct WHERE voxel_id IS NOT NULL GROUP BY 1, 2)
SELECT patient_id, voxel_id, {S6.format('mx * sx + ox')} AS x_mm, {S6.format('my * sy + oy')} AS y_mm, {S6.format('mz * sz + oz')} AS z_mm FROM o_e JOIN o_h USING (patient_id)""")
def voxel_centers_headers(t):
    c = hd.voxel_centers(block_ct(t), headers(t))
    return c.select("patient_id", "voxel_id", *[snap(F.col(a)).alias(a) for a in ("x_mm", "y_mm", "z_mm")])


@query("calc_box_crop_headers", f"""{HEADER_SQL} SELECT v.patient_id, v.ix, v.iy, v.iz, v.hu FROM v_voxel v JOIN o_h h USING (patient_id)
WHERE v.ix >= floor(3.1 / h.sx + 0.5) AND v.ix < floor(11.3 / h.sx + 0.5) AND v.iy >= floor(2.2 / h.sy + 0.5) AND v.iy < floor(9.7 / h.sy + 0.5) AND v.iz BETWEEN floor(1.9 / h.sz + 0.5) AND floor(4.1 / h.sz + 0.5)""")
def calc_box_crop_headers(t):
    own = headers(t)
    point = lambda x, y, z: F.struct(*[(F.col("origin")[a] + v).alias(a) for a, v in (("x", x), ("y", y), ("z", z))])
    boxes = own.select("patient_id", point(3.1, 2.2, 1.9).alias("start_mm"), point(11.3, 9.7, 4.1).alias("end_mm"))
    return hd.crop_box(t.voxel, boxes, own).select("patient_id", "ix", "iy", "iz", "hu")


@query("structure_expand_headers", f"""{HEADER_SQL}, o_n AS (SELECT patient_id, greatest(round_even(2.6 / sx, 0), 1) AS nx, greatest(round_even(2.6 / sz, 0), 1) AS nz FROM o_h),
o_k AS (SELECT patient_id, greatest(round_even(nx / greatest(floor(nx / nz), 1), 0), 1)::bigint AS k, ((greatest(floor(nx / nz), 1) - 1) * greatest(round_even(nx / greatest(floor(nx / nz), 1), 0), 1))::bigint AS m FROM o_n),
o_ball AS (SELECT DISTINCT s.patient_id, s.ix + x.d AS ix, s.iy + y.d AS iy, s.iz + z.d AS iz FROM v_structure_voxel s JOIN o_k USING (patient_id), (SELECT unnest(range(-8, 9)) AS d) x, (SELECT unnest(range(-8, 9)) AS d) y, (SELECT unnest(range(-8, 9)) AS d) z
  WHERE s.structure = 'GTV' AND abs(x.d) <= k AND abs(y.d) <= k AND abs(z.d) <= k AND abs(x.d) + abs(y.d) + abs(z.d) <= 2 * k),
o_in AS (SELECT * FROM o_ball WHERE ix BETWEEN 0 AND 24 AND iy BETWEEN 0 AND 19 AND iz BETWEEN 0 AND 2)
SELECT DISTINCT b.patient_id, b.ix + x.d AS ix, b.iy + y.d AS iy, b.iz FROM o_in b JOIN o_k USING (patient_id), (SELECT unnest(range(-8, 9)) AS d) x, (SELECT unnest(range(-8, 9)) AS d) y
WHERE abs(x.d) <= m AND abs(y.d) <= m AND b.ix + x.d BETWEEN 0 AND 24 AND b.iy + y.d BETWEEN 0 AND 19""")
def structure_expand_headers(t):
    return hd.expand(m(t, "GTV"), 2.6, headers(t))


CELLS_SQL = f"""{BLOCK_CT_SQL}, o_in AS (SELECT DISTINCT patient_id, ix, iy, iz FROM v_structure_voxel WHERE structure = 'PTV'),
o_sh AS (SELECT c.patient_id, c.voxel_id, count(*) AS n, count(i.ix) AS n_in FROM o_ct c LEFT JOIN o_in i USING (patient_id, ix, iy, iz) WHERE c.voxel_id IS NOT NULL GROUP BY 1, 2),
o_c AS (SELECT d.patient_id, d.plan_id, sum(CASE WHEN d.dose_gy >= 20 THEN s.n ELSE 0 END)::bigint AS iso, sum(CASE WHEN d.dose_gy >= 20 THEN s.n_in ELSE 0 END)::bigint AS hit FROM o_dose d JOIN o_sh s USING (patient_id, voxel_id) GROUP BY 1, 2),
o_n AS (SELECT patient_id, count(*) AS n FROM o_in GROUP BY 1)
SELECT patient_id, plan_id, {S6.format('CASE WHEN o_n.n * iso > 0 THEN hit * hit / (o_n.n * iso)::double END')} AS conformity_index FROM o_c JOIN o_n USING (patient_id)"""


@query("conformity_index_cells", CELLS_SQL)
def conformity_index_cells(t):
    """Several CT cells share a dose voxel."""
    r = ev.conformity_on_cells(block_ct(t), t.dose, m(t, "PTV"), 20.0)
    return r.withColumn("conformity_index", snap(F.col("conformity_index")))


@query("conformation_number_cells", changed(CELLS_SQL, ("'PTV'", "'GTV'"), ("dose_gy >= 20", "dose_gy >= 30"), ("AS conformity_index", "AS conformation_number")))
def conformation_number_cells(t):
    r = ev.conformity_on_cells(block_ct(t), t.dose, m(t, "GTV"), 30.0, "conformation_number")
    return r.withColumn("conformation_number", snap(F.col("conformation_number")))


def score_cells_sql():
    """The scorecard of score_metric with the conformation number of CT cells."""
    start, end = cr.SCORE_SQL.index("o_cn AS ("), cr.SCORE_SQL.index("o_metric AS (")
    cells = changed(CELLS_SQL[: CELLS_SQL.rindex("\nSELECT")], ("dose_gy >= 20", "dose_gy >= 30"))
    return cr.SCORE_SQL[:start] + cells + ", o_cn AS (SELECT o_c.patient_id, plan_id, iso AS v_ri, o_n.n AS tv, hit AS tv_ri FROM o_c JOIN o_n USING (patient_id)),\n" + cr.SCORE_SQL[end:]


@query("score_metric_cells", f"{score_cells_sql()} SELECT patient_id, plan_id, item_id, requested, metric, {S6.format('metric_value')} AS metric_value, status FROM o_scored")
def score_metric_cells(t):
    r = criteria.score_metrics(cr.score_items(t), t.structure_dose, t.dose, t.structure_voxel, t.structure, RX, ["A", "B"], ct=block_ct(t))
    return r.select("patient_id", "plan_id", "item_id", "requested", "metric", snap(F.col("metric_value")).alias("metric_value"), "status")
