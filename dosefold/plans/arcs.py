"""Arc queries: two arcs of four control points over the beamlet table."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import rows, snap
from dosefold.functions.salted import salted_join
from dosefold.operators import arcs as ac
from dosefold.plans.evaluation import S6
from dosefold.plans.registry import query

POINT_SQL = "o_pt0 AS (SELECT beam_id, beam_id // 4 + 1 AS arc_id, beam_id % 4 AS position FROM (SELECT DISTINCT beam_id FROM v_beamlet))"
MU_SQL = "o_mu AS (SELECT beam_id, CASE WHEN beam_id = 5 THEN 0.0::double ELSE (min(local_id) + beam_id) % 7 + 1.0::double END AS mu FROM v_beamlet GROUP BY beam_id)"
LEAF_SQL = "o_leaf AS (SELECT b.beam_id, b.row_idx AS row, min(b.col_idx) - 1 AS l, max(b.col_idx) + 1 AS r FROM v_beamlet b JOIN v_fluence f ON f.beamlet_id = b.beamlet_id AND f.plan_id = 'A' WHERE f.intensity >= 20 GROUP BY 1, 2)"
OPEN_SQL = f"""{MU_SQL}, o_open AS (SELECT b.beam_id, b.row_idx AS row, b.col_idx AS col, b.beamlet_id, f.intensity * m.mu / 32 AS weight, m.mu, CASE WHEN m.mu > 0 THEN least(1.0, f.intensity * m.mu / 32 / m.mu) ELSE 0 END AS open
 FROM v_beamlet b JOIN v_fluence f ON f.beamlet_id = b.beamlet_id AND f.plan_id = 'A' JOIN o_mu m ON m.beam_id = b.beam_id)"""


def points(t):
    return ac.arc_points(rows(t.spark, "arc_id long, beam_ids array<int>", [(1, [0, 1, 2, 3]), (2, [4, 5, 6, 7])]))


def units(t):
    first = t.beamlet.groupBy("beam_id").agg(F.min("local_id").alias("k"))
    return first.select("beam_id", F.when(F.col("beam_id") == 5, 0.0).otherwise(((F.col("k") + F.col("beam_id")) % 7 + 1).cast("double")).alias("mu"))


def leaves(t):
    """Leaf rows around the beamlets with at least 20 units of intensity."""
    open_cells = t.unit_cell.join(t.fluence.filter("plan_id = 'A' AND intensity >= 20").drop("plan_id"), "beamlet_id")
    return ac.open_leaf_positions(open_cells)


def weights(t):
    w = t.unit_cell.join(t.fluence.filter("plan_id = 'A'").drop("plan_id"), "beamlet_id").join(units(t), "beam_id")
    return w.select("beam_id", "row", "col", "beamlet_id", (F.col("intensity") * F.col("mu") / 32).alias("weight"))


def gantry(t):
    return t.beamlet.select("beam_id").distinct().withColumn("gantry_angle", (F.col("beam_id") * 70) % 360)


@query("arc_table", f"""{POINT_SQL}, o_b AS (SELECT p.arc_id, p.position, b.beam_id, min(beamlet_id) AS start_beamlet, max(beamlet_id) AS end_beamlet, count(DISTINCT row_idx) AS num_rows, min(x_mm) AS min_x_mm, max(x_mm) AS max_x_mm FROM v_beamlet b JOIN o_pt0 p USING (beam_id) GROUP BY 1, 2, 3)
SELECT *, count(*) OVER w AS num_beams, first_value(start_beamlet) OVER o AS arc_start_beamlet, last_value(end_beamlet) OVER o AS arc_end_beamlet, cast(sum(num_rows) OVER w as bigint) AS total_rows, min(min_x_mm) OVER w AS arc_min_x_mm, max(max_x_mm) OVER w AS arc_max_x_mm
FROM o_b WINDOW w AS (PARTITION BY arc_id), o AS (PARTITION BY arc_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def arc_table(t):
    return ac.arc_table(points(t), t.unit_cell, t.beamlet)


EDGE_SQL = "o_e AS (SELECT row_number() OVER (ORDER BY y) AS pair, y AS low, lead(y) OVER (ORDER BY y) AS high FROM (SELECT -200.0::double + range * 10 AS y FROM range(10) UNION ALL SELECT -100.0::double + range * 5 FROM range(40) UNION ALL SELECT 100.0::double + range * 10 FROM range(11)))"
MATCH_SQL = f"""{EDGE_SQL}, o_row AS (SELECT DISTINCT beam_id, row_idx AS row, row_idx * 10 - 95.0::double AS y_mm FROM v_beamlet), o_match AS (SELECT r.beam_id, r.row, e.pair AS leaf_pair, e.high - e.low AS thickness_mm FROM o_row r JOIN o_e e ON e.low >= r.y_mm - 5 AND e.high <= r.y_mm + 5)"""


def matches(t):
    r = t.unit_cell.select("beam_id", "row").distinct().select("beam_id", "row", (F.col("row") * 10 - 95.0).alias("y_mm"), F.lit(10.0).alias("height_mm"))
    return ac.leaf_row_match(r)


@query("leaf_row_match", f"{MATCH_SQL} SELECT * FROM o_match")
def leaf_row_match(t):
    return matches(t).select("beam_id", "row", "leaf_pair", "thickness_mm")


@query("leaf_row_offsets", f"""{MATCH_SQL}, {POINT_SQL}, o_s AS (SELECT p.arc_id, m.beam_id, max(leaf_pair) FILTER (WHERE m.row < 3 + m.beam_id) AS s, min(leaf_pair) FILTER (WHERE m.row < 3 + m.beam_id) AS e FROM o_match m JOIN o_pt0 p USING (beam_id) GROUP BY 1, 2),
o_a AS (SELECT *, max(s) OVER (PARTITION BY arc_id) AS top FROM o_s), o_x AS (SELECT beam_id, min(x_mm) + beam_id * 2.5::double AS x FROM v_beamlet GROUP BY 1)
SELECT a.arc_id, a.beam_id, a.s AS start_leaf_pair, a.e AS end_leaf_pair, (x.x - min(x.x) OVER (PARTITION BY a.arc_id)) / 2.5::double AS offset_x,
 (SELECT coalesce(ceil(sum(least(1.0::double, (high - low) / 10))), 0)::bigint FROM o_e WHERE pair > a.s AND pair <= a.top) AS offset_y FROM o_a a JOIN o_x x USING (beam_id)""")
def leaf_row_offsets(t):
    shifted = t.beamlet.withColumn("x_mm", F.col("x_mm") + F.col("beam_id") * 2.5)
    return ac.arc_offsets(points(t), matches(t).filter("row < 3 + beam_id"), shifted, 2.5, 10.0)


@query("open_leaf_positions", 'SELECT beam_id, row_idx AS row, min(col_idx) - 1 AS "left", max(col_idx) + 1 AS "right" FROM v_beamlet GROUP BY 1, 2')
def open_leaf_positions(t):
    return ac.open_leaf_positions(t.unit_cell)


U = "('0x' || substr(md5('7|' || beam_id || '|' || row || '|' || {}), 1, 13))::bigint / 4503599627370496.0::double"


@query("random_leaf_positions", f"""o_l AS (SELECT beam_id, row_idx AS row, min(col_idx) - 1 AS l, max(col_idx) + 1 AS r FROM v_beamlet GROUP BY 1, 2),
o_p AS (SELECT *, l + floor({U.format(1)} * greatest(r - 1 - l, 1))::bigint AS nl FROM o_l)
SELECT beam_id, row, nl AS "left", nl + 2 + floor({U.format(2)} * greatest(r - 1 - nl, 1))::bigint AS "right" FROM o_p""")
def random_leaf_positions(t):
    return ac.open_leaf_positions(t.unit_cell, seed=7)


def ranges(t, forward):
    widths = t.unit_cell.groupBy("beam_id").agg((F.max("col") + 1).alias("num_cols"))
    return ac.split_rows(leaves(t), ac.open_leaf_positions(t.unit_cell), widths, forward, 3)


FORWARD_SQL = f"""{LEAF_SQL}, o_f0 AS (SELECT *, least(l + 3, r - 1) AS nl, greatest(r - 3, l + 1) AS nr FROM o_leaf),
o_f1 AS (SELECT beam_id, row, l, r, nl - ceil(greatest(nl - nr + 1, 0) / 2.0)::bigint AS nl, nr + floor(greatest(nl - nr + 1, 0) / 2.0)::bigint AS nr FROM o_f0),
o_cls AS (SELECT b.beam_id, b.row_idx AS row, b.col_idx AS col, b.beamlet_id, CASE WHEN b.col_idx BETWEEN f.l + 1 AND f.nl THEN 'left' WHEN b.col_idx BETWEEN f.nr AND f.r - 1 THEN 'right'
  WHEN b.col_idx BETWEEN CASE WHEN f.l + 1 <= f.nl THEN f.nl + 1 ELSE f.l + 1 END AND CASE WHEN f.nr <= f.r - 1 THEN f.nr - 1 ELSE f.r - 1 END THEN 'interior' END AS kind
  FROM v_beamlet b JOIN o_f1 f ON f.beam_id = b.beam_id AND f.row = b.row_idx)"""


@query("interior_boundary_split", f"{FORWARD_SQL} SELECT * FROM o_cls WHERE kind IS NOT NULL")
def interior_boundary_split(t):
    return ac.classify_cells(t.unit_cell, ranges(t, True))


@query("interior_boundary_split_backward", f"""{LEAF_SQL}, o_v AS (SELECT beam_id, row_idx AS row, min(col_idx) - 1 AS vl, max(col_idx) + 1 AS vr FROM v_beamlet GROUP BY 1, 2),
o_w AS (SELECT beam_id, max(col_idx) + 1 AS nc FROM v_beamlet GROUP BY 1),
o_b AS (SELECT l.*, greatest(greatest(l.l - 3, -1), v.vl) AS fl, least(least(l.r + 3, w.nc), v.vr) AS fr FROM o_leaf l JOIN o_v v USING (beam_id, row) JOIN o_w w USING (beam_id)),
o_c AS (SELECT b.beam_id, b.row_idx AS row, b.col_idx AS col, b.beamlet_id, CASE WHEN b.col_idx BETWEEN fl + 1 AND l THEN 'left' WHEN b.col_idx BETWEEN r AND fr - 1 THEN 'right' WHEN b.col_idx BETWEEN l + 1 AND r - 1 THEN 'interior' END AS kind
  FROM v_beamlet b JOIN o_b f ON f.beam_id = b.beam_id AND f.row = b.row_idx) SELECT * FROM o_c WHERE kind IS NOT NULL""")
def interior_boundary_split_backward(t):
    return ac.classify_cells(t.unit_cell, ranges(t, False))


@query("beamlet_openness", f"{OPEN_SQL} SELECT beam_id, beamlet_id, {S6.format('open')} AS open FROM o_open")
def beamlet_openness(t):
    return ac.openness(weights(t), units(t)).select("beam_id", "beamlet_id", snap(F.col("open")).alias("open"))


PACK_SQL = f"""{OPEN_SQL}, {FORWARD_SQL}, o_oc AS (SELECT o.*, c.kind, count(*) FILTER (WHERE o.open > 0 AND o.open < 1) OVER rw AS nf,
  max(CASE WHEN o.open > 0 AND o.open < 1 THEN o.col END) OVER rw - min(CASE WHEN o.open > 0 AND o.open < 1 THEN o.col END) OVER rw AS gap,
  sum(o.open) OVER (PARTITION BY o.beam_id, o.row, c.kind) AS s,
  CASE WHEN c.kind = 'left' THEN max(o.col) OVER (PARTITION BY o.beam_id, o.row, c.kind) - o.col ELSE o.col - min(o.col) OVER (PARTITION BY o.beam_id, o.row, c.kind) END AS k
  FROM o_open o LEFT JOIN o_cls c ON c.beamlet_id = o.beamlet_id WINDOW rw AS (PARTITION BY o.beam_id, o.row))"""


@query("openness_to_leaf", f"""{PACK_SQL} SELECT beam_id, beamlet_id, {S6.format("CASE WHEN nf <= 1 OR (nf = 2 AND gap > 1) OR kind IS NULL OR kind = 'interior' THEN open ELSE greatest(least(s - k, 1), 0) END")} AS actual FROM o_oc""")
def openness_to_leaf(t):
    r = ac.pack_openness(ac.openness(weights(t), units(t)), ac.classify_cells(t.unit_cell, ranges(t, True)))
    return r.select("beam_id", "beamlet_id", snap(F.col("actual")).alias("actual"))


@query("leaf_reference_update", f"""{PACK_SQL}, o_sum AS (SELECT beam_id, row, max(CASE WHEN kind = 'left' THEN col END) AS lc, sum(CASE WHEN kind = 'left' THEN open END) AS ls, min(CASE WHEN kind = 'right' THEN col END) AS rc, sum(CASE WHEN kind = 'right' THEN open END) AS rs FROM o_oc GROUP BY 1, 2)
SELECT l.beam_id, l.row, coalesce(lc - floor(ls)::bigint, l.l) AS left_backward, coalesce(lc - ceil(ls)::bigint, l.l) AS left_forward, coalesce(rc + floor(rs)::bigint, l.r) AS right_backward, coalesce(rc + ceil(rs)::bigint, l.r) AS right_forward FROM o_leaf l LEFT JOIN o_sum s USING (beam_id, row)""")
def leaf_reference_update(t):
    return ac.reference_leaves(ac.openness(weights(t), units(t)), ac.classify_cells(t.unit_cell, ranges(t, True)), leaves(t))


POS_SQL = f"""{MU_SQL}, {LEAF_SQL}, o_pos AS (SELECT l.beam_id, l.row, round_even((l.l + 1.37::double) * m.mu / (m.mu + 1e-12) * 1e4, 0) / 1e4 AS left_pos, round_even((l.r + 1.37::double) * m.mu / (m.mu + 1e-12) * 1e4, 0) / 1e4 AS right_pos FROM o_leaf l JOIN o_mu m USING (beam_id))"""


def positions(t):
    scaled = leaves(t).join(units(t), "beam_id").select(
        "beam_id", "row", ((F.col("left") + 1.37) * F.col("mu")).alias("left_mu"), ((F.col("right") + 1.37) * F.col("mu")).alias("right_mu")
    )
    return ac.continuous_leaves(scaled, units(t))


@query("leaf_position_continuous", f"{POS_SQL} SELECT beam_id, row, left_pos, right_pos, {S6.format('sum(right_pos - left_pos) OVER (PARTITION BY beam_id)')} AS area FROM o_pos")
def leaf_position_continuous(t):
    return positions(t).withColumn("area", snap(F.col("area")))


ANGLE_SQL = f"""{POINT_SQL}, o_ga AS (SELECT *, beam_id * 70 % 360 AS gantry_angle FROM o_pt0), o_aw0 AS (SELECT *, abs(coalesce(lead(gantry_angle) OVER w, gantry_angle) - coalesce(lag(gantry_angle) OVER w, gantry_angle)) AS gap FROM o_ga WINDOW w AS (PARTITION BY arc_id ORDER BY position)),
o_aw AS (SELECT arc_id, position, beam_id, gantry_angle, least(gap, 360 - gap) / 2.0::double AS angle_weight FROM o_aw0)"""


def weighted_points(t):
    return ac.angle_weights(points(t), gantry(t))


@query("mu_angle_weight", f"{ANGLE_SQL} SELECT * FROM o_aw")
def mu_angle_weight(t):
    return weighted_points(t)


@query("arc_dose", f"""{ANGLE_SQL}, {OPEN_SQL}, o_main AS (SELECT i.patient_id, i.voxel_id, sum(i.a_int * o.weight * a.angle_weight) AS d FROM v_influence i JOIN o_open o USING (beamlet_id) JOIN o_aw a ON a.beam_id = o.beam_id GROUP BY 1, 2),
o_mean AS (SELECT sum(weight) / count(*) AS m FROM o_open)
SELECT v.patient_id, v.voxel_id, floor((coalesce(d.d, 0) + 0.3141::double * m.m * v.hu / 100) * 1e4 + 0.5) / 1e4 AS dose_gy FROM v_voxel v CROSS JOIN o_mean m LEFT JOIN o_main d USING (patient_id, voxel_id)""")
def arc_dose(t):
    delta = t.voxel.select("patient_id", "voxel_id", (F.col("hu") / 100).alias("delta_gy"))
    r = ac.arc_dose(t.influence, weights(t), weighted_points(t), delta, alpha=0.3141)
    return r.withColumn("dose_gy", snap(F.col("dose_gy"), 4))


@query("aperture_regularity", f"{LEAF_SQL} SELECT a.beam_id, coalesce(sum((b.l - a.l) * (b.l - a.l) + (b.r - a.r) * (b.r - a.r)), 0)::bigint AS regularity FROM o_leaf a LEFT JOIN o_leaf b ON b.beam_id = a.beam_id AND b.row = a.row + 1 GROUP BY 1")
def aperture_regularity(t):
    return ac.aperture_regularity(leaves(t))


@query("aperture_similarity", f"""{LEAF_SQL}, {POINT_SQL}, o_lp AS (SELECT l.*, p.arc_id, p.position FROM o_leaf l JOIN o_pt0 p USING (beam_id))
SELECT a.arc_id, coalesce(sum((b.l - a.l) * (b.l - a.l) + (b.r - a.r) * (b.r - a.r)), 0)::bigint AS similarity, count(b.l) AS pairs FROM o_lp a LEFT JOIN o_lp b ON b.arc_id = a.arc_id AND b.row = a.row AND b.position = a.position + 1 GROUP BY 1""")
def aperture_similarity(t):
    return ac.aperture_similarity(leaves(t), points(t))


@query("mu_similarity", f"{POINT_SQL}, {MU_SQL}, o_pm AS (SELECT * FROM o_pt0 JOIN o_mu USING (beam_id)) SELECT a.arc_id, sum(abs(b.mu - a.mu)) AS sum_abs, sum(pow(b.mu - a.mu, 2)) AS sum_squared FROM o_pm a JOIN o_pm b ON b.arc_id = a.arc_id AND b.position = a.position + 1 GROUP BY 1")
def mu_similarity(t):
    return ac.mu_similarity(points(t), units(t))


@query("arc_mu_balance", f"{ANGLE_SQL}, {MU_SQL}, o_s AS (SELECT arc_id, sum(mu * angle_weight) AS s FROM o_aw JOIN o_mu USING (beam_id) GROUP BY 1) SELECT pow(max(CASE arc_id WHEN 2 THEN s END) - max(CASE arc_id WHEN 1 THEN s END), 2) / 2 AS balance FROM o_s")
def arc_mu_balance(t):
    return ac.arc_mu_balance(weighted_points(t), units(t))


@query("meterset_cumulative", f"{POINT_SQL}, {MU_SQL} SELECT arc_id, position, beam_id, round_even(sum(mu) OVER (PARTITION BY arc_id ORDER BY position) / sum(mu) OVER (PARTITION BY arc_id) * 1e4, 0) / 1e4 AS meterset FROM o_pt0 JOIN o_mu USING (beam_id)")
def meterset_cumulative(t):
    return ac.meterset(points(t), units(t)).select("arc_id", "position", "beam_id", "meterset")


@query("fluence_levels", "SELECT f.plan_id, b.beam_id, b.beamlet_id, round_even(f.intensity::double / max(f.intensity) OVER (PARTITION BY f.plan_id, b.beam_id) * 40, 0)::bigint AS level FROM v_fluence f JOIN v_beamlet b USING (beamlet_id)")
def fluence_levels(t):
    r = ac.fluence_levels(t.fluence.join(t.beamlet.select("beam_id", "beamlet_id"), "beamlet_id"))
    return r.select("plan_id", "beam_id", "beamlet_id", "level")


ITER_SQL = "o_it AS (SELECT o_custkey::bigint AS run_id, o_orderkey::bigint AS iteration, round(o_totalprice * 100)::bigint::double AS objective FROM orders)"


def iterations(t):
    """Objective logs: one run per customer, one iteration per order."""
    return t.table("orders").select(
        F.col("o_custkey").cast("long").alias("run_id"), F.col("o_orderkey").cast("long").alias("iteration"),
        F.round(F.col("o_totalprice") * 100).cast("long").cast("double").alias("objective"),
    )


@query("best_iteration", f"""{ITER_SQL}, o_b AS (SELECT *, min(objective) OVER (PARTITION BY run_id ORDER BY iteration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM o_it)
SELECT run_id, iteration, best IS NULL OR objective < best AS accepted, {S6.format('CASE WHEN objective < best THEN (best - objective) / best * 100 END')} AS gain_perc FROM o_b""")
def best_iteration(t):
    r = ac.accepted_iterations(iterations(t), ["run_id"])
    return r.select("run_id", "iteration", "accepted", snap(F.col("gain_perc")).alias("gain_perc"))


@query("best_iteration_report", f"{ITER_SQL} SELECT run_id, arg_min(iteration, objective * 1000000 + iteration % 1000000) AS best_iteration, min(objective) AS best_objective FROM o_it GROUP BY 1")
def best_iteration_report(t):
    return ac.best_iterations(iterations(t), ["run_id"])


@query("delivery_leaf_mm", f"""{POS_SQL}, {MATCH_SQL}, {POINT_SQL},
o_mx AS (SELECT beam_id, min(x_mm) AS x0 FROM v_beamlet GROUP BY 1),
o_bank AS (SELECT p.beam_id, m.leaf_pair, CASE WHEN (right_pos - left_pos) * 2.5::double < 0.5 THEN 0.5::double ELSE x0 + left_pos * 2.5::double - 1.25::double END AS b, CASE WHEN (right_pos - left_pos) * 2.5::double < 0.5 THEN 0.0::double ELSE x0 + right_pos * 2.5::double + 1.25::double END AS a
  FROM o_pos p JOIN o_match m ON m.beam_id = p.beam_id AND m.row = p.row JOIN o_mx x ON x.beam_id = p.beam_id),
o_cp AS (SELECT *, CASE WHEN position = 0 THEN 0 ELSE mu * 100 END AS mu100 FROM o_pt0 JOIN o_mu USING (beam_id)),
o_ms AS (SELECT *, sum(mu100) OVER (PARTITION BY arc_id ORDER BY position) / nullif(sum(mu100) OVER (PARTITION BY arc_id), 0) AS meterset FROM o_cp)
SELECT c.arc_id, c.position, c.beam_id, l.range AS leaf_pair, {S6.format('coalesce(k.b, 0.5)')} AS bank_b_mm, {S6.format('coalesce(k.a, 0.5)')} AS bank_a_mm, c.mu100::double AS mu100, {S6.format('c.meterset')} AS meterset
FROM o_ms c CROSS JOIN range(1, 61) l LEFT JOIN o_bank k ON k.beam_id = c.beam_id AND k.leaf_pair = l.range""")
def delivery_leaf_mm(t):
    reach = t.beamlet.groupBy("beam_id").agg(F.min("x_mm").alias("min_x_mm"))
    r = ac.delivery_leaves(points(t), positions(t).drop("area"), matches(t), units(t), reach)
    return r.select("arc_id", "position", "beam_id", "leaf_pair", "mu100", *[snap(F.col(c)).alias(c) for c in ("bank_b_mm", "bank_a_mm", "meterset")])


# --- both plans of every patient -------------------------------------------

KEYED = ["patient_id", "plan_id"]
KEYED_SQL = f"""{POINT_SQL}, {MU_SQL}, o_pp AS (SELECT p.patient_id, f.plan_id FROM (SELECT DISTINCT patient_id FROM v_voxel) p CROSS JOIN (SELECT DISTINCT plan_id FROM v_fluence) f),
o_kpt AS (SELECT * FROM o_pp CROSS JOIN o_pt0),
o_kmu AS (SELECT k.patient_id, k.plan_id, m.beam_id, CASE WHEN k.plan_id = 'A' THEN m.mu ELSE m.mu * 2 + k.patient_id % 3 END AS mu FROM o_pp k CROSS JOIN o_mu m),
o_kaw AS (SELECT patient_id, plan_id, arc_id, position, beam_id, CASE WHEN position IN (0, 3) THEN 5.0::double ELSE 10.0::double END AS angle_weight FROM o_kpt),
o_kw AS (SELECT k.patient_id, k.plan_id, b.beam_id, b.beamlet_id, f.intensity * m.mu / 32 AS weight FROM o_pp k JOIN v_fluence f ON f.plan_id = k.plan_id JOIN v_beamlet b ON b.beamlet_id = f.beamlet_id JOIN o_kmu m ON m.patient_id = k.patient_id AND m.plan_id = k.plan_id AND m.beam_id = b.beam_id)"""


def keyed(t):
    """Patients and plans; a plan's units differ by patient, so that mixing them would show."""
    patients = t.voxel.select("patient_id").distinct()
    return patients.join(t.fluence.select("plan_id").distinct(), F.lit(True))


def keyed_points(t):
    near = points(t).withColumn("angle_weight", F.when(F.col("position").isin(0, 3), 5.0).otherwise(10.0))
    return keyed(t).join(near, F.lit(True))


def keyed_units(t):
    mu = F.when(F.col("plan_id") == "A", F.col("mu")).otherwise(F.col("mu") * 2 + F.col("patient_id") % 3)
    return keyed(t).join(units(t), F.lit(True)).select(*KEYED, "beam_id", mu.alias("mu"))


def plan_cells(t):
    """Beamlets of each plan; its patients share them."""
    return t.unit_cell.join(t.fluence, "beamlet_id").select("plan_id", "beam_id", "beamlet_id", "intensity")


def keyed_weights(t):
    """With the units of the beam, of which there are few: the beamlets are dealt to many tasks."""
    met = salted_join(plan_cells(t), keyed_units(t), ["plan_id", "beam_id"], ["beamlet_id"])
    return met.select(*KEYED, "beam_id", "beamlet_id", "mu", (F.col("intensity") * F.col("mu") / 32).alias("weight"))


@query("arc_dose_plans", f"""{KEYED_SQL}, o_d AS (SELECT w.patient_id, w.plan_id, i.voxel_id, sum(i.a_int * w.weight * a.angle_weight) AS d FROM v_influence i
  JOIN o_kw w ON w.patient_id = i.patient_id AND w.beamlet_id = i.beamlet_id JOIN o_kaw a ON a.patient_id = w.patient_id AND a.plan_id = w.plan_id AND a.beam_id = w.beam_id GROUP BY 1, 2, 3),
o_m AS (SELECT patient_id, plan_id, sum(weight) / count(*) AS m FROM o_kw GROUP BY 1, 2)
SELECT v.patient_id, m.plan_id, v.voxel_id, floor((coalesce(d.d, 0) + 0.25::double * m.m * v.hu / 100) * 1e4 + 0.5) / 1e4 AS dose_gy
FROM v_voxel v JOIN o_m m ON m.patient_id = v.patient_id LEFT JOIN o_d d ON d.patient_id = v.patient_id AND d.plan_id = m.plan_id AND d.voxel_id = v.voxel_id""")
def arc_dose_plans(t):
    delta = t.voxel.select("patient_id", "voxel_id", (F.col("hu") / 100).alias("delta_gy"))
    weights = plan_cells(t).select("plan_id", "beam_id", "beamlet_id", (F.col("intensity") / 32).alias("weight"))
    r = ac.arc_dose(t.influence, weights, keyed_points(t), delta, alpha=0.25, factors=keyed_units(t).withColumnRenamed("mu", "factor"))
    return r.withColumn("dose_gy", snap(F.col("dose_gy"), 4))


@query("mu_similarity_plans", f"""{KEYED_SQL}, o_n AS (SELECT k.*, u.mu, lead(u.mu) OVER (PARTITION BY k.patient_id, k.plan_id, k.arc_id ORDER BY k.position) - u.mu AS d FROM o_kpt k JOIN o_kmu u USING (patient_id, plan_id, beam_id))
SELECT patient_id, plan_id, arc_id, sum(abs(d)) AS sum_abs, sum(d * d) AS sum_squared FROM o_n GROUP BY 1, 2, 3""")
def mu_similarity_plans(t):
    return ac.mu_similarity(keyed_points(t), keyed_units(t))


@query("arc_mu_balance_plans", f"""{KEYED_SQL}, o_s AS (SELECT patient_id, plan_id, arc_id, sum(mu * angle_weight) AS s FROM o_kaw JOIN o_kmu USING (patient_id, plan_id, beam_id) GROUP BY 1, 2, 3)
SELECT patient_id, plan_id, pow(max(CASE arc_id WHEN 2 THEN s END) - max(CASE arc_id WHEN 1 THEN s END), 2) / 2 AS balance FROM o_s GROUP BY 1, 2""")
def arc_mu_balance_plans(t):
    return ac.arc_mu_balance(keyed_points(t), keyed_units(t))


@query("meterset_plans", f"""{KEYED_SQL} SELECT patient_id, plan_id, arc_id, position, beam_id, round_even(sum(mu) OVER (PARTITION BY patient_id, plan_id, arc_id ORDER BY position) / sum(mu) OVER (PARTITION BY patient_id, plan_id, arc_id) * 1e4, 0) / 1e4 AS meterset FROM o_kpt JOIN o_kmu USING (patient_id, plan_id, beam_id)""")
def meterset_plans(t):
    return ac.meterset(keyed_points(t), keyed_units(t)).select(*KEYED, "arc_id", "position", "beam_id", "meterset")


OWN_SQL = """o_kc AS (SELECT DISTINCT i.patient_id, f.plan_id, b.beam_id, b.row_idx AS row, b.col_idx AS col, b.beamlet_id, f.intensity FROM v_influence i JOIN v_beamlet b ON b.beamlet_id = i.beamlet_id JOIN v_fluence f ON f.beamlet_id = i.beamlet_id),
o_kl AS (SELECT patient_id, plan_id, beam_id, row, min(col) - 1 AS l, max(col) + 1 AS r FROM o_kc WHERE intensity >= 20 GROUP BY 1, 2, 3, 4)"""
STEP_SUM = "coalesce(sum((b.l - a.l) * (b.l - a.l) + (b.r - a.r) * (b.r - a.r)), 0)::bigint"


def own_cells(t):
    """The beamlets that a patient's matrix has, with the intensity of each plan."""
    own = t.own_beamlet
    return own.join(t.fluence, "beamlet_id").join(t.unit_cell, "beamlet_id").select(*KEYED, "beam_id", "row", "col", "beamlet_id", "intensity")


def own_leaves(t):
    return ac.open_leaf_positions(own_cells(t).filter("intensity >= 20"))


@query("open_leaf_positions_plans", f'{OWN_SQL} SELECT patient_id, plan_id, beam_id, row, l AS "left", r AS "right" FROM o_kl')
def open_leaf_positions_plans(t):
    return own_leaves(t)


@query("interior_boundary_split_plans", f"""{OWN_SQL}, o_f0 AS (SELECT *, least(l + 3, r - 1) AS nl, greatest(r - 3, l + 1) AS nr FROM o_kl),
o_f1 AS (SELECT patient_id, plan_id, beam_id, row, l, r, nl - ceil(greatest(nl - nr + 1, 0) / 2.0)::bigint AS nl, nr + floor(greatest(nl - nr + 1, 0) / 2.0)::bigint AS nr FROM o_f0),
o_cls AS (SELECT c.patient_id, c.plan_id, c.beam_id, c.row, c.col, c.beamlet_id, CASE WHEN c.col BETWEEN f.l + 1 AND f.nl THEN 'left' WHEN c.col BETWEEN f.nr AND f.r - 1 THEN 'right'
  WHEN c.col BETWEEN CASE WHEN f.l + 1 <= f.nl THEN f.nl + 1 ELSE f.l + 1 END AND CASE WHEN f.nr <= f.r - 1 THEN f.nr - 1 ELSE f.r - 1 END THEN 'interior' END AS kind
  FROM o_kc c JOIN o_f1 f USING (patient_id, plan_id, beam_id, row)) SELECT * FROM o_cls WHERE kind IS NOT NULL""")
def interior_boundary_split_plans(t):
    cells = own_cells(t).drop("intensity")
    widths = cells.groupBy(*KEYED, "beam_id").agg((F.max("col") + 1).alias("num_cols"))
    return ac.classify_cells(cells, ac.split_rows(own_leaves(t), ac.open_leaf_positions(cells), widths, True, 3))


@query("beamlet_openness_plans", f"{KEYED_SQL} SELECT patient_id, plan_id, beam_id, w.beamlet_id, {S6.format('CASE WHEN m.mu > 0 THEN least(1.0, w.weight / m.mu) ELSE 0 END')} AS open FROM o_kw w JOIN o_kmu m USING (patient_id, plan_id, beam_id)")
def beamlet_openness_plans(t):
    return ac.openness(keyed_weights(t)).select(*KEYED, "beam_id", "beamlet_id", snap(F.col("open")).alias("open"))


@query("leaf_position_continuous_plans", f"""{KEYED_SQL}, {OWN_SQL}, o_kp AS (SELECT patient_id, plan_id, beam_id, l.row, round_even((l.l + 1.37::double) * m.mu / (m.mu + 1e-12) * 1e4, 0) / 1e4 AS left_pos, round_even((l.r + 1.37::double) * m.mu / (m.mu + 1e-12) * 1e4, 0) / 1e4 AS right_pos
  FROM o_kl l JOIN o_kmu m USING (patient_id, plan_id, beam_id))
SELECT patient_id, plan_id, beam_id, row, left_pos, right_pos, {S6.format('sum(right_pos - left_pos) OVER (PARTITION BY patient_id, plan_id, beam_id)')} AS area FROM o_kp""")
def leaf_position_continuous_plans(t):
    scaled = own_leaves(t).join(keyed_units(t), [*KEYED, "beam_id"]).select(
        *KEYED, "beam_id", "row", ((F.col("left") + 1.37) * F.col("mu")).alias("left_mu"), ((F.col("right") + 1.37) * F.col("mu")).alias("right_mu"))
    return ac.continuous_leaves(scaled, keyed_units(t)).withColumn("area", snap(F.col("area")))


@query("aperture_regularity_plans", f"{OWN_SQL} SELECT a.patient_id, a.plan_id, a.beam_id, {STEP_SUM} AS regularity FROM o_kl a LEFT JOIN o_kl b ON b.patient_id = a.patient_id AND b.plan_id = a.plan_id AND b.beam_id = a.beam_id AND b.row = a.row + 1 GROUP BY 1, 2, 3")
def aperture_regularity_plans(t):
    return ac.aperture_regularity(own_leaves(t))


@query("aperture_similarity_plans", f"""{KEYED_SQL}, {OWN_SQL}, o_lp AS (SELECT l.*, p.arc_id, p.position FROM o_kl l JOIN o_kpt p USING (patient_id, plan_id, beam_id))
SELECT a.patient_id, a.plan_id, a.arc_id, {STEP_SUM} AS similarity, count(b.l) AS pairs FROM o_lp a LEFT JOIN o_lp b ON b.patient_id = a.patient_id AND b.plan_id = a.plan_id AND b.arc_id = a.arc_id AND b.row = a.row AND b.position = a.position + 1 GROUP BY 1, 2, 3""")
def aperture_similarity_plans(t):
    return ac.aperture_similarity(own_leaves(t), keyed_points(t))
