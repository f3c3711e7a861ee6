"""Objective queries on per-fraction dose."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import rows, snap
from dosefold.operators import evaluation as ev
from dosefold.operators import objectives as ob
from dosefold.plans.criteria import NEAR_SQL, target_distance
from dosefold.plans.evaluation import S6, TAIL_SQL, tails
from dosefold.plans.registry import query

OBJECTIVES = [
    (1, "quadratic-overdose", "PTV", 100.0, 2.0), (2, "quadratic-underdose", "PTV", 200.0, 2.0), (3, "quadratic", "CORD", 10.0, 0.0),
    (4, "quadratic", "HEART", 20.0, 0.0), (5, "quadratic-overdose", "BOX", 5.0, 0.7), (6, "quadratic", "LIVER", 9.0, 0.0),
]
SCHEMA = "objective_id long, type string, structure string, weight_factor double, target double"
FD = "o_fd AS (SELECT *, dose_gy / 30 AS d FROM o_sd)"
OBJ = FD + ", o_obj(objective_id, type, structure, wf, target) AS (VALUES " + ", ".join(
    f"({i}::bigint, '{k}', '{s}', {w}::double, {d}::double)" for i, k, s, w, d in OBJECTIVES) + ")"
PEN = "CASE o.type WHEN 'quadratic-overdose' THEN pow(greatest({d} - o.target, 0), 2) WHEN 'quadratic-underdose' THEN pow(greatest(o.target - {d}, 0), 2) ELSE {d} * {d} END"
SLOPE = "CASE o.type WHEN 'quadratic-overdose' THEN greatest({d} - o.target, 0) WHEN 'quadratic-underdose' THEN least({d} - o.target, 0) ELSE {d} END"


def objectives(t):
    return F.broadcast(rows(t.spark, SCHEMA, OBJECTIVES))


def fraction_dose(t):
    return t.structure_dose.withColumn("dose", F.col("dose_gy") / 30)


def value_query(name, kind, volume_weighted):
    mean = "sum(f.vol_u * ({p})) / sum(f.vol_u)" if volume_weighted else "sum({p}) / count(*)"
    sql = f"""{OBJ} SELECT f.patient_id, f.plan_id, o.objective_id, f.structure, {S6.format('max(o.wf) * ' + mean.format(p=PEN.format(d='f.d')))} AS value
FROM o_fd f JOIN o_obj o USING (structure) WHERE o.type = '{kind}' GROUP BY 1, 2, 3, 4"""

    @query(name, sql)
    def run(t):
        terms = ob.objective_terms(fraction_dose(t), objectives(t).filter(F.col("type") == kind), volume_weighted)
        return terms.select("patient_id", "plan_id", "objective_id", "structure", snap(F.col("value")).alias("value"))


for _key, _kind in (("overdose", "quadratic-overdose"), ("underdose", "quadratic-underdose"), ("quadratic", "quadratic")):
    value_query(f"objective_{_key}", _kind, False)
    value_query(f"objective_{_key}_by_volume", _kind, True)


@query("objective_quadratic_weighted", f"""{FD} SELECT patient_id, plan_id, structure, {S6.format('sum((voxel_id % 5 + 1) * d * d) / count(*) * 3')} AS value FROM o_fd GROUP BY 1, 2, 3""")
def objective_quadratic_weighted(t):
    weights = t.opt_voxel.select("patient_id", "structure", "voxel_id", (F.col("voxel_id") % 5 + 1).alias("voxel_weight"))
    return ob.weighted_quadratic(fraction_dose(t), weights, 3.0).withColumn("value", snap(F.col("value")))


def plan_grid(t):
    return t.unit_cell.join(t.fluence, "beamlet_id")


@query("objective_smoothness", f"""
o_g AS (SELECT f.plan_id, b.beam_id, b.row_idx, b.col_idx, f.intensity::double AS x FROM v_beamlet b JOIN v_fluence f USING (beamlet_id)),
o_n AS (SELECT sum(r) AS rows, sum(c) AS cols FROM (SELECT max(row_idx) + 1 AS r, max(col_idx) + 1 AS c FROM v_beamlet GROUP BY beam_id)),
o_x AS (SELECT a.plan_id, sum(pow(a.x - b.x, 2)) AS s FROM o_g a JOIN o_g b ON a.plan_id = b.plan_id AND a.beam_id = b.beam_id AND a.row_idx = b.row_idx AND b.col_idx = a.col_idx + 1 GROUP BY 1),
o_y AS (SELECT a.plan_id, sum(pow(a.x - b.x, 2)) AS s FROM o_g a JOIN o_g b ON a.plan_id = b.plan_id AND a.beam_id = b.beam_id AND b.row_idx = a.row_idx + 1 AND b.col_idx = a.col_idx GROUP BY 1)
SELECT x.plan_id, {S6.format('0.6::double / cols * x.s + 0.4::double / rows * y.s')} AS value FROM o_x x JOIN o_y y USING (plan_id) CROSS JOIN o_n""")
def objective_smoothness(t):
    return ob.smoothness(plan_grid(t), ["beam_id"], ["plan_id"]).withColumn("value", snap(F.col("value")))


@query("objective_mimicking", f"""o_m AS (SELECT d.patient_id, d.plan_id, d.dose_gy / 30 - p.pred_cgy / 100.0::double / 30 AS e, x.vid IS NOT NULL AS inside
 FROM o_dose d JOIN v_predicted p USING (patient_id, voxel_id) LEFT JOIN (SELECT patient_id AS pid, voxel_id AS vid FROM v_structure_voxel WHERE structure = 'PTV') x ON x.pid = d.patient_id AND x.vid = d.voxel_id)
SELECT patient_id, plan_id, {S6.format('avg(e * e) FILTER (WHERE inside)')} AS target_value, {S6.format('avg(pow(greatest(e, 0), 2)) FILTER (WHERE NOT inside)')} AS organ_value FROM o_m GROUP BY 1, 2""")
def objective_mimicking(t):
    dose = t.dose.select("patient_id", "plan_id", "voxel_id", (F.col("dose_gy") / 30).alias("dose"))
    r = ob.mimicking(dose, predicted(t), t.voxel, t.structure_voxel.filter("structure = 'PTV'"))
    return r.select("patient_id", "plan_id", snap(F.col("target_value")).alias("target_value"), snap(F.col("organ_value")).alias("organ_value"))


def predicted(t):
    return t.predicted.select("patient_id", "voxel_id", (F.col("pred_cgy") / 100.0 / 30).alias("predicted"))


W_STEP = "CASE WHEN sqrt(d2) <= 1.5 THEN 1.0::double WHEN sqrt(d2) <= 4 THEN 3.0::double WHEN sqrt(d2) <= 50 THEN 7.0::double END"
L_STEP = "CASE WHEN sqrt(d2) <= 1.5 THEN 1.8::double WHEN sqrt(d2) <= 4 THEN 1.0::double WHEN sqrt(d2) <= 50 THEN 0.5::double END"


@query("objective_distance_falloff", f"""{NEAR_SQL} SELECT d.patient_id, d.plan_id,
 {S6.format(f'sum(({W_STEP}) * greatest(d.dose_gy / 30 - ({L_STEP}), 0)) / count(*) * 2')} AS linear_value,
 {S6.format(f'sum(({W_STEP}) * (d.dose_gy / 30) * (d.dose_gy / 30)) / count(*) * 2')} AS quadratic_value FROM o_dose d JOIN o_near n USING (patient_id, voxel_id) GROUP BY 1, 2""")
def objective_distance_falloff(t):
    dose = t.dose.select("patient_id", "plan_id", "voxel_id", (F.col("dose_gy") / 30).alias("dose"))
    near = target_distance(t)
    weights, limits = [(1.5, 1.0), (4.0, 3.0), (50.0, 7.0)], [(1.5, 1.8), (4.0, 1.0), (50.0, 0.5)]
    linear = ob.distance_falloff(dose, near, limits, weights, 2.0, "linear").withColumnRenamed("value", "linear_value")
    square = ob.distance_falloff(dose, near, limits, weights, 2.0, "quadratic").withColumnRenamed("value", "quadratic_value")
    r = linear.join(square, ["patient_id", "plan_id"])
    return r.select("patient_id", "plan_id", snap(F.col("linear_value")).alias("linear_value"), snap(F.col("quadratic_value")).alias("quadratic_value"))


TERMS = f"""o_t AS (SELECT f.patient_id, f.plan_id, o.objective_id, o.type, max(o.wf) * sum({PEN.format(d='f.d')}) / count(*) AS value FROM o_fd f JOIN o_obj o USING (structure) GROUP BY 1, 2, 3, 4)"""


@query("objective_total", f"""{OBJ}, {TERMS} SELECT patient_id, plan_id, type AS term, round_even(sum(value), 4) AS value FROM o_t GROUP BY 1, 2, 3
UNION ALL SELECT patient_id, plan_id, NULL, round_even(sum(value), 4) FROM o_t GROUP BY 1, 2""")
def objective_total(t):
    return ob.objective_total(ob.objective_terms(fraction_dose(t), objectives(t)))


GRAD = f"""o_n AS (SELECT patient_id, plan_id, structure, count(*) AS n FROM o_fd GROUP BY 1, 2, 3),
o_r AS (SELECT f.patient_id, f.plan_id, f.voxel_id, sum(2 * o.wf / n.n * ({SLOPE.format(d='f.d')})) AS r FROM o_fd f JOIN o_obj o USING (structure) JOIN o_n n USING (patient_id, plan_id, structure) GROUP BY 1, 2, 3),
o_grad AS (SELECT r.patient_id, r.plan_id, i.beamlet_id, sum(i.a_int * r.r) AS g FROM v_influence i JOIN o_r r USING (patient_id, voxel_id) GROUP BY 1, 2, 3),
o_score AS (SELECT *, g / max(abs(g)) OVER (PARTITION BY patient_id, plan_id) AS score FROM o_grad)"""


def scores(t):
    return ob.scaled_scores(ob.gradient(t.influence, ob.voxel_residual(fraction_dose(t), objectives(t))))


@query("objective_gradient", f"{OBJ}, {GRAD} SELECT patient_id, plan_id, beamlet_id, {S6.format('score')} AS score FROM o_score")
def objective_gradient(t):
    return scores(t).select("patient_id", "plan_id", "beamlet_id", snap(F.col("score")).alias("score"))


@query("objective_finite_difference", f"""{OBJ}, o_n AS (SELECT patient_id, plan_id, structure, count(*) AS n FROM o_fd GROUP BY 1, 2, 3),
o_fdiff AS (SELECT f.patient_id, f.plan_id, i.beamlet_id, sum(o.wf / n.n * (({PEN.format(d='(f.d + 0.001::double * i.a_int)')}) - ({PEN.format(d='f.d')}))) / 0.001::double AS s
 FROM v_influence i JOIN o_fd f USING (patient_id, voxel_id) JOIN o_obj o USING (structure) JOIN o_n n USING (patient_id, plan_id, structure)
 WHERE i.beamlet_id NOT IN (SELECT beamlet_id FROM v_fluence WHERE plan_id = 'A' AND intensity >= 40) GROUP BY 1, 2, 3)
SELECT patient_id, plan_id, beamlet_id, floor(s * 1e4 + 0.5) / 1e4 AS score FROM o_fdiff""")
def objective_finite_difference(t):
    selected = t.fluence.filter("plan_id = 'A' AND intensity >= 40").select("beamlet_id")
    r = ob.finite_difference(t.influence, fraction_dose(t), objectives(t), selected)
    return r.withColumn("score", snap(F.col("score"), 4))


SEG = """o_p AS (SELECT s.patient_id, s.plan_id, b.beam_id, b.row_idx AS row, b.col_idx AS col, floor(s.score * 1e6 + 0.5) AS sc FROM o_score s JOIN v_beamlet b USING (beamlet_id)),
o_all AS (SELECT a.patient_id, a.plan_id, a.beam_id, a.row, a.col AS c1, e.col AS c2, (SELECT sum(m.sc) FROM o_p m WHERE m.patient_id = a.patient_id AND m.plan_id = a.plan_id AND m.beam_id = a.beam_id AND m.row = a.row AND m.col BETWEEN a.col AND e.col) AS v
  FROM o_p a JOIN o_p e ON e.patient_id = a.patient_id AND e.plan_id = a.plan_id AND e.beam_id = a.beam_id AND e.row = a.row AND e.col >= a.col),
o_best AS (SELECT *, row_number() OVER (PARTITION BY patient_id, plan_id, beam_id, row ORDER BY v, c2, c1) AS k FROM o_all),
o_seg1 AS (SELECT patient_id, plan_id, beam_id, row, CASE WHEN v < 0 THEN c1 END AS first_col, CASE WHEN v < 0 THEN c2 END AS last_col, least(v, 0) / 1e6 AS segment_score FROM o_best WHERE k = 1)"""


def segments(t):
    scored = scores(t).select("patient_id", "plan_id", "beamlet_id", F.floor(F.col("score") * 1e6 + 0.5).cast("double").alias("score"))
    on_grid = t.unit_cell.join(scored, "beamlet_id").select("patient_id", "plan_id", "beam_id", "row", "col", "score")
    return ob.best_row_segments(on_grid, ["patient_id", "plan_id", "beam_id"]).withColumn("segment_score", F.col("segment_score") / 1e6)


@query("best_row_segment", f"{OBJ}, {GRAD}, {SEG} SELECT patient_id, plan_id, beam_id, row, first_col, last_col, segment_score FROM o_seg1")
def best_row_segment(t):
    return segments(t)


@query("best_aperture", f"""{OBJ}, {GRAD}, {SEG}, o_ap AS (SELECT patient_id, plan_id, beam_id, {S6.format('sum(segment_score)')} AS s FROM o_seg1 GROUP BY 1, 2, 3)
SELECT patient_id, plan_id, arg_min(beam_id, s * 1e6 + beam_id / 1000.0) AS beam_id, min(s) AS aperture_score FROM o_ap GROUP BY 1, 2""")
def best_aperture(t):
    per_row = segments(t)
    r = ob.best_aperture(per_row, ["patient_id", "plan_id"])
    return r.withColumn("aperture_score", snap(F.col("aperture_score")))


def descent_sql(rounds, step, w_right, w_down):
    """The gradient steps unrolled over named tables."""
    parts = ["""o_pairs AS (SELECT a.beamlet_id AS p, b.beamlet_id AS q, CASE WHEN b.col_idx = a.col_idx + 1 THEN %s::double ELSE %s::double END AS w FROM v_beamlet a JOIN v_beamlet b
  ON a.beam_id = b.beam_id AND ((a.row_idx = b.row_idx AND b.col_idx = a.col_idx + 1) OR (b.row_idx = a.row_idx + 1 AND b.col_idx = a.col_idx)))""" % (w_right, w_down),
        "o_both AS (SELECT p, q, w FROM o_pairs UNION ALL SELECT q, p, w FROM o_pairs)",
        "o_x0 AS (SELECT DISTINCT i.patient_id, i.beamlet_id, f.intensity::double AS x FROM v_influence i JOIN v_fluence f ON f.beamlet_id = i.beamlet_id AND f.plan_id = 'A')"]
    for k in range(rounds + 1):
        parts += [
            f"o_d{k} AS (SELECT i.patient_id, i.voxel_id, sum(i.a_int * x.x) * 0.0003::double AS d FROM v_influence i JOIN o_x{k} x USING (patient_id, beamlet_id) GROUP BY 1, 2)",
            f"o_s{k} AS (SELECT o.structure, o.patient_id, o.voxel_id, d.d, count(*) OVER (PARTITION BY o.structure, o.patient_id) AS n FROM o_ov o JOIN o_d{k} d USING (patient_id, voxel_id))",
            f"o_rough{k} AS (SELECT x.patient_id, x.beamlet_id, sum(b.w * (x.x - y.x) * (x.x - y.x) / 2) AS part, sum(2 * b.w * (x.x - y.x)) AS pull FROM o_x{k} x JOIN o_both b ON b.p = x.beamlet_id JOIN o_x{k} y ON y.patient_id = x.patient_id AND y.beamlet_id = b.q GROUP BY 1, 2)",
            f"o_f{k} AS (SELECT patient_id, sum(v) AS f FROM (SELECT s.patient_id, max(o.wf) * sum({PEN.format(d='s.d')}) / count(*) AS v FROM o_s{k} s JOIN o_obj o USING (structure) GROUP BY s.patient_id, o.objective_id UNION ALL SELECT patient_id, part FROM o_rough{k}) GROUP BY 1)",
        ]
        if k < rounds:
            parts += [
                f"o_r{k} AS (SELECT s.patient_id, s.voxel_id, sum(2 * o.wf / s.n * ({SLOPE.format(d='s.d')})) AS r FROM o_s{k} s JOIN o_obj o USING (structure) GROUP BY 1, 2)",
                f"o_g{k} AS (SELECT patient_id, beamlet_id, sum(g) AS g FROM (SELECT i.patient_id, i.beamlet_id, sum(i.a_int * r.r) * 0.0003::double AS g FROM v_influence i JOIN o_r{k} r USING (patient_id, voxel_id) GROUP BY 1, 2 UNION ALL SELECT patient_id, beamlet_id, pull FROM o_rough{k}) GROUP BY 1, 2)",
                f"o_x{k + 1} AS (SELECT x.patient_id, x.beamlet_id, greatest(x.x - {step}::double * coalesce(g.g, 0), 0) AS x FROM o_x{k} x LEFT JOIN o_g{k} g USING (patient_id, beamlet_id))",
            ]
    every = " UNION ALL ".join(f"SELECT x.patient_id, x.beamlet_id, x.x, f.f, {k} AS it FROM o_x{k} x JOIN o_f{k} f USING (patient_id)" for k in range(rounds + 1))
    best = " UNION ALL ".join(f"SELECT patient_id, f, {k} AS it FROM o_f{k}" for k in range(rounds + 1))
    parts += [f"o_every AS ({every})", f"o_best AS (SELECT patient_id, arg_min(it, f) AS it FROM ({best}) GROUP BY 1)"]
    return ", ".join(parts) + """ SELECT e.patient_id, 'A' AS plan_id, e.beamlet_id, floor(e.x * 1e4 + 0.5) / 1e4 AS intensity, floor(e.f * 1e4 + 0.5) / 1e4 AS objective, e.it::bigint AS iteration
FROM o_every e JOIN o_best b ON b.patient_id = e.patient_id AND b.it = e.it"""


@query("fluence_descent", f"{OBJ}, {descent_sql(2, 0.8, 0.002, 0.001)}")
def fluence_descent(t):
    start = t.own_beamlet.join(t.fluence.filter("plan_id = 'A'"), "beamlet_id").select(
        "patient_id", "plan_id", "beamlet_id", "intensity")
    r = ob.fluence_descent(
        start, t.influence, t.voxel, t.opt_voxel, objectives(t), ob.neighbour_pairs(t.unit_cell, ["beam_id"]),
        smooth=(0.002, 0.001), step=0.8, rounds=2, scale=0.0003,
    )
    return r.withColumn("intensity", snap(F.col("intensity"), 4)).withColumn("objective", snap(F.col("objective"), 4))


@query("fluence_descent_settled")
def fluence_descent_settled(t):
    """Both plans, until neither gains more than 1e-3 of its objective in a round: an open number of rounds, so no SQL; a test repeats them in numpy."""
    start = t.own_beamlet.join(t.fluence, "beamlet_id").select("patient_id", "plan_id", "beamlet_id", "intensity")
    r = ob.settled_descent(
        start, t.influence, t.voxel, t.opt_voxel, objectives(t), ob.neighbour_pairs(t.unit_cell, ["beam_id"]),
        smooth=(0.002, 0.001), step=0.8, scale=0.0003,
    )
    return r.withColumn("intensity", snap(F.col("intensity"), 4)).withColumn("objective", snap(F.col("objective"), 4))


LIMITS = [("m1", "max", "PTV", 66.0), ("m2", "mean", "HEART", 27.0), ("t1", "cvar", "PTV", 50.0), ("t2", "cvar", "CORD", 45.0), ("t3", "cvar", "BODY", 55.0), ("m3", "max", "LIVER", 5.0)]


@query("dose_limit_report", f"""{TAIL_SQL},
o_lim(limit_id, kind, structure, limit_gy) AS (VALUES {', '.join(f"('{i}', '{k}', '{s}', {v}::double)" for i, k, s, v in LIMITS)}),
o_t AS (SELECT p.*, r.request_id, r.bound_type, CASE WHEN r.bound_type = 'lower' THEN 1 - r.volume_perc / s.frac / 100 ELSE r.volume_perc / s.frac / 100 END AS fr,
  CASE WHEN r.bound_type = 'lower' THEN p.below + p.vol_u ELSE p.total - p.below END AS upto FROM o_pt p JOIN o_req r USING (structure) JOIN o_struct s USING (structure, patient_id)),
o_val AS (SELECT patient_id, plan_id, request_id AS limit_id, coalesce(sum(CASE WHEN upto <= fr * total THEN vol_u * dose_gy END) / sum(CASE WHEN upto <= fr * total THEN vol_u END),
    CASE WHEN max(bound_type) = 'lower' THEN min(dose_gy) ELSE max(dose_gy) END) AS v FROM o_t GROUP BY 1, 2, 3
  UNION ALL SELECT d.patient_id, d.plan_id, l.limit_id, CASE WHEN l.kind = 'max' THEN max(d.dose_gy) ELSE sum(d.vol_u * d.dose_gy) / sum(d.vol_u) * max(s.frac) END
   FROM o_sd d JOIN o_lim l USING (structure) JOIN o_struct s USING (structure, patient_id) WHERE l.kind IN ('max', 'mean') GROUP BY d.patient_id, d.plan_id, l.limit_id, l.kind)
SELECT v.patient_id, v.plan_id, l.limit_id, l.kind, l.structure, {S6.format('l.limit_gy - v.v')} AS slack_gy FROM o_val v JOIN o_lim l USING (limit_id)""")
def dose_limit_report(t):
    limits = F.broadcast(rows(t.spark, "limit_id string, kind string, structure string, limit_gy double", LIMITS))
    r = ob.dose_limit_report(ev.dose_statistics(t.structure_dose, t.structure), ev.tail_mean(t.structure_dose, t.structure, tails(t)), limits)
    return r.select("patient_id", "plan_id", "limit_id", "kind", "structure", snap(F.col("slack_gy")).alias("slack_gy"))


@query("objective_prediction", f"""{OBJ}, o_j AS (SELECT f.*, f.d - p.pred_cgy / 100.0::double / 30 AS e FROM o_fd f JOIN v_predicted p USING (patient_id, voxel_id)),
o_org AS (SELECT patient_id, plan_id, sum(o1) AS o1, sum(o2) AS o2 FROM (SELECT j.patient_id, j.plan_id, j.structure, 0.1::double * max(o.wf) * avg(pow(greatest(j.e, 0), 2)) AS o1, 0.00001::double * max(o.wf) * avg(j.d * j.d) AS o2
  FROM o_j j JOIN o_obj o USING (structure) WHERE o.type = 'quadratic' GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT j.patient_id, j.plan_id, {S6.format('10 * avg(e * e)')} AS target_prediction, {S6.format('0.1::double * avg(pow(d - 2, 2))')} AS target_prescription,
 {S6.format('max(o.o1)')} AS organ_prediction, {S6.format('max(o.o2)')} AS organ_quadratic FROM o_j j JOIN o_org o USING (patient_id, plan_id) WHERE j.structure = 'PTV' GROUP BY 1, 2""")
def objective_prediction(t):
    r = ob.objective_prediction(fraction_dose(t), predicted(t), objectives(t), 2.0)
    return r.select("patient_id", "plan_id", *[snap(F.col(c)).alias(c) for c in ("target_prediction", "target_prescription", "organ_prediction", "organ_quadratic")])
