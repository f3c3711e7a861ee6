"""Prediction-data and metric queries; the predicted table stands in for a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import geometry as ge
from dosefold.operators import matrix as im
from dosefold.operators import prediction as ml
from dosefold.operators import structures as st
from dosefold.plans import geometry as pg
from dosefold.plans.evaluation import RX, S6
from dosefold.plans.grids import S4
from dosefold.plans.registry import changed, query
from dosefold.plans.structures import BLOCK_CT_SQL, block_ct

ORGANS = [("CORD", 1), ("HEART", 3), ("LUNG_L", 4), ("LUNG_R", 5)]
LABEL_SQL = "o_lab AS (SELECT patient_id, voxel_id, CASE prio WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 WHEN '5-LOW' THEN 5 ELSE 0 END::bigint AS label, CASE WHEN prio = '1-URGENT' THEN 1 ELSE 0 END::bigint AS target FROM v_voxel)"
OPEN_SQL = "o_raw AS (SELECT v.patient_id, v.voxel_id, coalesce(sum(i.a_int), 0) AS raw FROM v_voxel v LEFT JOIN v_influence i USING (patient_id, voxel_id) GROUP BY 1, 2), o_of AS (SELECT patient_id, voxel_id, cast(raw - min(raw) OVER w as double) / cast(max(raw) OVER w - min(raw) OVER w as double) * 72.0 AS open_field FROM o_raw WINDOW w AS (PARTITION BY patient_id))"
FEATURE_SQL = f"""{LABEL_SQL}, {OPEN_SQL}, o_feat AS (SELECT v.patient_id, v.ix, v.iy, v.iz, (least(greatest(v.hu, -1000), 3071) + 1000) / 4071.0::double AS ct_norm, least(greatest(d.dose_gy, 0), 72) AS dose_gy, l.label, l.target, CASE WHEN l.target = 1 THEN 60.0::double ELSE o.open_field END AS open_field
 FROM v_voxel v JOIN o_lab l USING (patient_id, voxel_id) JOIN o_of o USING (patient_id, voxel_id) JOIN o_dose d ON d.patient_id = v.patient_id AND d.voxel_id = v.voxel_id AND d.plan_id = 'A'
 WHERE v.ix >= 2 AND v.ix < 23 AND v.iy >= 3 AND v.iy < 18 AND EXISTS (SELECT 1 FROM o_lab t WHERE t.patient_id = v.patient_id AND t.target = 1))"""


FEATURE_PLANS_SQL = changed(FEATURE_SQL, ("o_feat AS (SELECT v.patient_id,", "o_feat AS (SELECT v.patient_id, d.plan_id,"), (" AND d.plan_id = 'A'", ""))


def features(t, dose=None):
    """Of plan A, or of all plans of the given dose."""
    ct = t.voxel.filter("ix >= 2 AND ix < 23 AND iy >= 3 AND iy < 18")
    labels = st.label_map(t.structure_voxel, ORGANS)
    return ml.training_features(
        ct, t.dose.filter("plan_id = 'A'").drop("plan_id") if dose is None else dose, labels, im.open_field_dose(t.influence, t.voxel, RX), RX
    )


@query("training_features", f"{FEATURE_SQL} SELECT patient_id, ix, iy, iz, {S6.format('ct_norm')} AS ct_norm, {S6.format('dose_gy')} AS dose_gy, label, target, {S6.format('open_field')} AS open_field_gy FROM o_feat")
def training_features(t):
    r = features(t)
    return r.select("patient_id", "ix", "iy", "iz", snap(F.col("ct_norm")).alias("ct_norm"), snap(F.col("dose_gy")).alias("dose_gy"), "label", "target", snap(F.col("open_field_gy")).alias("open_field_gy"))


@query("training_features_plans", f"{FEATURE_PLANS_SQL} SELECT patient_id, plan_id, ix, iy, iz, {S6.format('ct_norm')} AS ct_norm, {S6.format('dose_gy')} AS dose_gy, label, target, {S6.format('open_field')} AS open_field_gy FROM o_feat")
def training_features_plans(t):
    r = features(t, t.dose)
    return r.select("patient_id", "plan_id", "ix", "iy", "iz", *[snap(F.col(c)).alias(c) for c in ("ct_norm", "dose_gy", "open_field_gy")], "label", "target")


S7 = "floor(({}) * 1e7 + 0.5) / 1e7"


RESIZED_SQL = f"""o_tg AS (SELECT p.patient_id, x.range AS jx, y.range AS jy, z.range AS jz, abs((x.range + 0.5::double) * (21.0::double / 9) - 0.5) AS fx, abs((y.range + 0.5::double) * (15.0::double / 7) - 0.5) AS fy, abs((z.range + 0.5::double) * (3.0::double / 8) - 0.5) AS z0
  FROM (SELECT DISTINCT patient_id FROM o_feat) p CROSS JOIN range(9) x CROSS JOIN range(7) y CROSS JOIN range(8) z),
o_tm AS (SELECT *, CASE WHEN z0 > 2 THEN 4 - z0 ELSE z0 END AS fz FROM o_tg),
o_cw AS (SELECT t.*, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
 (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
 FROM o_tm t CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c)),
o_ln AS (SELECT c.patient_id, jx, jy, jz, sum(w * ct_norm) AS ct_norm, sum(w * dose_gy) AS dose_gy, sum(w * open_field) AS open_field FROM o_cw c JOIN o_feat f ON f.patient_id = c.patient_id AND f.ix = c.ix + 2 AND f.iy = c.iy + 3 AND f.iz = c.iz GROUP BY 1, 2, 3, 4)
SELECT l.patient_id, l.jx, l.jy, l.jz, {S7.format('l.ct_norm')} AS ct_norm, {S7.format('l.dose_gy')} AS dose_gy, {S7.format('l.open_field')} AS open_field_gy, f.label, f.target
FROM o_ln l JOIN o_tm t USING (patient_id, jx, jy, jz) JOIN o_feat f ON f.patient_id = t.patient_id AND f.ix = floor(t.fx + 0.5)::bigint + 2 AND f.iy = floor(t.fy + 0.5)::bigint + 3 AND f.iz = floor(t.fz + 0.5)::bigint"""


@query("training_features_resized", f"{FEATURE_SQL},\n{RESIZED_SQL}")
def training_features_resized(t):
    r = ml.resize_features(features(t), (2, 3), (21, 15, 3), (9, 7, 8))
    return r.select("patient_id", "jx", "jy", "jz", *[snap(F.col(c), 7).alias(c) for c in ("ct_norm", "dose_gy", "open_field_gy")], "label", "target")


RESIZED_PLANS_SQL = changed(
    RESIZED_SQL, ("SELECT p.patient_id, x.range", "SELECT p.patient_id, p.plan_id, x.range"), ("SELECT DISTINCT patient_id FROM", "SELECT DISTINCT patient_id, plan_id FROM"),
    ("SELECT c.patient_id, jx", "SELECT c.patient_id, c.plan_id, jx"), ("f.patient_id = c.patient_id", "f.patient_id = c.patient_id AND f.plan_id = c.plan_id"), ("GROUP BY 1, 2, 3, 4)", "GROUP BY 1, 2, 3, 4, 5)"),
    ("SELECT l.patient_id, l.jx", "SELECT l.patient_id, l.plan_id, l.jx"), ("USING (patient_id, jx", "USING (patient_id, plan_id, jx"), ("f.patient_id = t.patient_id", "f.patient_id = t.patient_id AND f.plan_id = t.plan_id"),
)


@query("training_features_resized_plans", f"{FEATURE_PLANS_SQL},\n{RESIZED_PLANS_SQL}")
def training_features_resized_plans(t):
    r = ml.resize_features(features(t, t.dose), (2, 3), (21, 15, 3), (9, 7, 8))
    return r.select("patient_id", "plan_id", "jx", "jy", "jz", *[snap(F.col(c), 7).alias(c) for c in ("ct_norm", "dose_gy", "open_field_gy")], "label", "target")


SAMPLE_SQL = f"""{pg.FRAME_SQL}, o_ch AS (SELECT patient_id, beam_id FROM o_b8 WHERE (beam_id * 45 - (patient_id * 7 + 42) % 12 * 5) % 60 = 0),
o_tail AS (SELECT i.*, b.beam_id, b.x_mm, b.y_mm, max(i.a_int) OVER (PARTITION BY i.patient_id, i.beamlet_id) AS top FROM v_influence i JOIN v_beamlet b USING (beamlet_id)),
o_pair AS (SELECT t.patient_id, t.beam_id, t.beamlet_id, t.voxel_id, t.a_int, f.hu, {pg.D1} AS d1, {pg.R2} AS r2 FROM o_tail t JOIN o_ch c USING (patient_id, beam_id) JOIN o_fr f ON f.patient_id = t.patient_id AND f.beam_id = t.beam_id AND f.voxel_id = t.voxel_id WHERE t.a_int > t.top * 0.3::double),
o_e AS (SELECT patient_id, beam_id, beamlet_id, min(d1) AS entry FROM (SELECT f.patient_id, f.beam_id, b.beamlet_id, {pg.D1} AS d1, {pg.R2} AS r2 FROM o_fr f JOIN o_ch c USING (patient_id, beam_id) JOIN v_beamlet b USING (beam_id) WHERE f.hu > 0) WHERE sqrt(greatest(r2 - d1 * d1, 0)) <= 3.1 GROUP BY 1, 2, 3),
o_smp AS (SELECT p.*, e.entry, sqrt(greatest(r2 - d1 * d1, 0)) AS d2, CASE WHEN entry IS NULL THEN d1 WHEN hu > 0 THEN entry ELSE 0 END AS outside, CASE WHEN entry IS NULL THEN 0 ELSE greatest(d1 - entry, 0) END AS inside FROM o_pair p LEFT JOIN o_e e USING (patient_id, beam_id, beamlet_id))"""


def samples(t):
    chosen = pg.beams(t).filter((F.col("gantry_angle") - (F.col("patient_id") * 7 + 42) % 12 * 5) % 60 == 0)
    framed = ge.beam_frame(pg.voxels(t), chosen).withColumn("in_body", F.col("hu") > 0)
    return ml.beamlet_samples(t.influence, framed, pg.lattice(t), chosen, pg.RADIUS, 0.3)


@query("beamlet_samples", f"{SAMPLE_SQL} SELECT patient_id, beam_id, beamlet_id, voxel_id, a_int::double AS target_value, {S4.format('d1')} AS d1_mm, {S4.format('d2')} AS d2_mm, {S4.format('entry')} AS entry_mm, {S4.format('outside')} AS outside_mm, {S4.format('inside')} AS inside_mm, hu > 0 AS in_body FROM o_smp")
def beamlet_samples(t):
    r = samples(t)
    return r.select("patient_id", "beam_id", "beamlet_id", "voxel_id", "target_value", *[snap(F.col(c), 4).alias(c) for c in ("d1_mm", "d2_mm", "entry_mm", "outside_mm", "inside_mm")], "in_body")


@query("channel_normalize", f"""{SAMPLE_SQL} SELECT patient_id, beamlet_id, voxel_id, {S6.format('d2 / 600')} AS d2_norm, {S6.format('d1 / 1600')} AS d1_norm, {S6.format('outside / 800')} AS outside_norm, {S6.format('a_int / 4000.0::double / 0.7::double * 10')} AS value_norm,
 CASE WHEN a_int / 4000.0::double / 0.7::double * 10 >= 0.1 THEN 1 ELSE 0 END::bigint AS hot, CASE WHEN a_int / 4000.0::double / 0.7::double * 10 < 0.1 THEN 1 ELSE 0 END::bigint AS scatter FROM o_smp""")
def channel_normalize(t):
    r = ml.normalize_channels(samples(t).withColumn("value", F.col("target_value") / 4000.0))
    return r.select("patient_id", "beamlet_id", "voxel_id", *[snap(F.col(c)).alias(c) for c in ("d2_norm", "d1_norm", "outside_norm", "value_norm")], "hot", "scatter")


@query("beam_normalize", f"""o_q AS (SELECT i.patient_id, b.beam_id, i.voxel_id, i.beamlet_id, i.a_int FROM v_influence i JOIN v_beamlet b USING (beamlet_id)),
o_s AS (SELECT patient_id, beam_id, CASE WHEN count(*) >= 16 THEN quantile_cont(a_int::double, 0.99) ELSE max(a_int) END AS scale FROM o_q GROUP BY 1, 2)
SELECT patient_id, beam_id, voxel_id, beamlet_id, {S6.format('least(greatest(a_int / greatest(scale, 1e-6), 0), 1)')} AS beam_norm FROM o_q JOIN o_s USING (patient_id, beam_id)""")
def beam_normalize(t):
    df = t.influence.join(t.beamlet.select("beamlet_id", "beam_id"), "beamlet_id")
    r = ml.normalize_beam(df, ["patient_id", "beam_id"], "a")
    return r.select("patient_id", "beam_id", "voxel_id", "beamlet_id", snap(F.col("beam_norm")).alias("beam_norm"))


@query("predicted_matrix", f"""{BLOCK_CT_SQL}, o_p0 AS (SELECT i.patient_id, i.beamlet_id, v.ix, v.iy, v.iz, i.a_int * 0.1::double * 0.07::double * CASE WHEN i.a_int > 3 THEN 1 ELSE 0 END AS v FROM v_influence i JOIN v_voxel v USING (patient_id, voxel_id)),
o_p1 AS (SELECT * FROM (SELECT *, max(v) OVER (PARTITION BY patient_id, beamlet_id) AS top FROM o_p0) WHERE v >= 0.2::double * top AND v <> 0),
o_sc AS (SELECT patient_id, beamlet_id, x.range AS ix, y.range AS iy, p.iz, sum(v * (1 - abs(x.range * 0.8::double + 1.3::double - p.ix)) * (1 - abs(y.range + 0.4::double - p.iy))) AS v FROM o_p1 p JOIN range(25) x ON abs(x.range * 0.8::double + 1.3::double - p.ix) < 1 JOIN range(20) y ON abs(y.range + 0.4::double - p.iy) < 1 GROUP BY 1, 2, 3, 4, 5),
o_last AS (SELECT patient_id, voxel_id, max((iz * 1000 + iy) * 1000 + ix) AS code FROM o_ct WHERE voxel_id IS NOT NULL GROUP BY 1, 2)
SELECT s.patient_id, s.beamlet_id, l.voxel_id, {S6.format('s.v')} AS a FROM o_sc s JOIN o_last l ON l.patient_id = s.patient_id AND l.code = (s.iz * 1000 + s.iy) * 1000 + s.ix WHERE s.v <> 0""")
def predicted_matrix(t):
    operator = ml.interpolation_operator(block_ct(t), (0.8, 1.0, 1.0), (1.3, 0.4, 0.0), (25, 20, 3))
    return ml.predicted_matrix(guessed(t), operator, unscale=0.07, tail=0.2).withColumn("a", snap(F.col("a")))


def guessed(t):
    """Predicted grids made from the matrix."""
    return t.influence.join(t.voxel.select("patient_id", "voxel_id", "ix", "iy", "iz"), ["patient_id", "voxel_id"]).select(
        "patient_id", "beamlet_id", "ix", "iy", "iz", (F.col("a") * 0.1).alias("value"), (F.col("a") > 3).cast("int").alias("mask")
    )


PAIR_SQL = "o_tp AS (SELECT p.patient_id, p.voxel_id, v.ix, v.iy, v.iz, v.prio, true_cgy / 100.0::double AS t, pred_cgy / 100.0::double AS p, CASE WHEN v.hu > 0 THEN 1 ELSE 0 END AS m FROM v_predicted p JOIN v_voxel v USING (patient_id, voxel_id))"


def pairs(t):
    """True and predicted dose per voxel with a mask."""
    return t.predicted.join(t.voxel.select("patient_id", "voxel_id", "ix", "iy", "iz", "hu"), ["patient_id", "voxel_id"]).select(
        "patient_id", "voxel_id", "ix", "iy", "iz", (F.col("true_cgy") / 100.0).alias("true_value"),
        (F.col("pred_cgy") / 100.0).alias("predicted"), (F.col("hu") > 0).cast("double").alias("mask"),
    )


METRIC_SQL = f"""{PAIR_SQL}, o_mk AS (SELECT patient_id, t * m AS t, p * m AS p, m FROM o_tp), o_mean AS (SELECT patient_id, sum(t) / greatest(sum(m), 1) AS tm, sum(p) / greatest(sum(m), 1) AS pm FROM o_mk GROUP BY 1),
o_met AS (SELECT k.patient_id, sum(abs(p - t)) / greatest(sum(m), 1) AS mae, 1 - sum(pow(t - p, 2)) / greatest(sum(pow(t - tm, 2)), 1e-8) AS r2, sum((p - pm) * (t - tm)) / (greatest(sqrt(sum(pow(p - pm, 2))), 1e-8) * greatest(sqrt(sum(pow(t - tm, 2))), 1e-8)) AS corr,
 sqrt(sum(pow(t - p, 2)) / greatest(sum(m), 1)) / greatest(max(t) - min(t), 1e-8) AS nrmse FROM o_mk k JOIN o_mean USING (patient_id) GROUP BY 1)"""
METRICS = ["mae", "r2", "corr", "nrmse"]


@query("prediction_metrics", f"{METRIC_SQL} SELECT patient_id, {', '.join(S6.format(m) + ' AS ' + m for m in METRICS)} FROM o_met")
def prediction_metrics(t):
    r = ml.prediction_metrics(pairs(t), ["patient_id"])
    return r.select("patient_id", *[snap(F.col(m)).alias(m) for m in METRICS])


@query("scaled_mae", f"""{PAIR_SQL}, o_q AS (SELECT patient_id, 60 / (quantile_cont(t, 0.03) + 1e-5) AS k FROM o_tp WHERE prio = '1-URGENT' GROUP BY 1)
SELECT patient_id, {S6.format('avg(abs(t * k - p * k)) FILTER (WHERE t * k > 0 OR p * k > 0)')} AS scaled_mae_gy FROM o_tp JOIN o_q USING (patient_id) GROUP BY 1""")
def scaled_mae(t):
    doses = pairs(t).select("patient_id", "voxel_id", F.col("true_value").alias("true_gy"), F.col("predicted").alias("predicted_gy"))
    r = ml.scaled_mae(doses, t.structure_voxel.filter("structure = 'PTV'"), t.voxel, RX)
    return r.withColumn("scaled_mae_gy", snap(F.col("scaled_mae_gy")))


@query("metric_rollup", f"""{PAIR_SQL}, o_s AS (SELECT patient_id, prio, avg(abs(p - t)) AS mae, CASE WHEN prio = '2-HIGH' THEN NULL ELSE sqrt(avg(pow(p - t, 2))) END AS rmse FROM o_tp GROUP BY 1, 2)
SELECT patient_id, count(*) AS samples, {S6.format('avg(mae)')} AS mae, {S6.format('avg(rmse)')} AS rmse FROM o_s GROUP BY ROLLUP (patient_id)""")
def metric_rollup(t):
    e = F.col("predicted") - F.col("true_value")
    per_sample = pairs(t).join(t.voxel.select("patient_id", "voxel_id", "prio"), ["patient_id", "voxel_id"]).groupBy("patient_id", "prio").agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse")
    ).withColumn("rmse", F.when(F.col("prio") == "2-HIGH", float("nan")).otherwise(F.col("rmse")))
    r = ml.metric_rollup(per_sample, ["mae", "rmse"])
    return r.select("patient_id", "samples", snap(F.col("mae")).alias("mae"), snap(F.col("rmse")).alias("rmse"))


@query("weighted_l1", f"""{PAIR_SQL}, o_w AS (SELECT *, 1 + 2 * t / greatest(max(t) OVER (PARTITION BY patient_id), 1e-6) AS w FROM o_tp)
SELECT patient_id, {S6.format('sum(abs(p - t) * w) / sum(w)')} AS loss, {S6.format('sum(abs(p - t) * w * m) / greatest(sum(w * m), 1e-6)')} AS masked_loss FROM o_w GROUP BY 1""")
def weighted_l1(t):
    r = ml.weighted_l1(pairs(t), ["patient_id"])
    return r.select("patient_id", snap(F.col("loss")).alias("loss"), snap(F.col("masked_loss")).alias("masked_loss"))


ORGAN_PAIR_SQL = f"{PAIR_SQL}, o_op AS (SELECT s.structure, t.* FROM o_tp t JOIN v_structure_voxel s USING (patient_id, voxel_id))"


def organ_pairs(t):
    return pairs(t).join(t.structure_voxel.select("patient_id", "voxel_id", "structure"), ["patient_id", "voxel_id"])


@query("moment_difference", f"""{ORGAN_PAIR_SQL}, o_mo AS (SELECT patient_id, structure, n, abs(pow(greatest(avg(pow(p, n)), 1e-6), 1.0::double / n) - pow(greatest(avg(pow(t, n)), 1e-6), 1.0::double / n)) AS d FROM o_op CROSS JOIN (VALUES (1), (2), (10)) q(n) GROUP BY 1, 2, 3)
SELECT patient_id, {S6.format('avg(d)')} AS loss FROM o_mo GROUP BY 1""")
def moment_difference(t):
    return ml.moment_difference(organ_pairs(t)).withColumn("loss", snap(F.col("loss")))


@query("gradient_difference", f"""{PAIR_SQL}, o_s AS (SELECT patient_id, ix, iy, iz, t / 100 AS t, p / 100 AS p FROM o_tp), o_g AS (SELECT *,
 (coalesce(lead(t) OVER x, t) - coalesce(lag(t) OVER x, t)) / 2 AS tx, (coalesce(lead(p) OVER x, p) - coalesce(lag(p) OVER x, p)) / 2 AS px, (coalesce(lead(t) OVER y, t) - coalesce(lag(t) OVER y, t)) / 2 AS ty, (coalesce(lead(p) OVER y, p) - coalesce(lag(p) OVER y, p)) / 2 AS py,
 (coalesce(lead(t) OVER z, t) - coalesce(lag(t) OVER z, t)) / 2 AS tz, (coalesce(lead(p) OVER z, p) - coalesce(lag(p) OVER z, p)) / 2 AS pz FROM o_s
 WINDOW x AS (PARTITION BY patient_id, iy, iz ORDER BY ix), y AS (PARTITION BY patient_id, ix, iz ORDER BY iy), z AS (PARTITION BY patient_id, ix, iy ORDER BY iz))
SELECT patient_id, floor(avg((pow(px - tx, 2) + pow(py - ty, 2) + pow(pz - tz, 2)) * (0.1::double * least(pow(sqrt(tx * tx + ty * ty + tz * tz) + 1e-6, 2), 6) + 0.05::double)) * 1e9 + 0.5) / 1e9 AS loss FROM o_g GROUP BY 1""")
def gradient_difference(t):
    small = pairs(t).withColumn("true_value", F.col("true_value") / 100).withColumn("predicted", F.col("predicted") / 100)
    return ml.gradient_difference(small, gamma_edge=2).withColumn("loss", snap(F.col("loss"), 9))


BIN_SQL = "o_h AS (SELECT patient_id, structure, b.bin, avg(1 / (1 + exp(-(t - b.bin * (70.0::double / 350)) / (70.0::double / 350)))) AS t, avg(1 / (1 + exp(-(p - b.bin * (70.0::double / 350)) / (70.0::double / 350)))) AS p FROM o_op CROSS JOIN (SELECT range AS bin FROM range(351)) b GROUP BY 1, 2, 3)"


@query("dvh_loss", f"{ORGAN_PAIR_SQL}, {BIN_SQL} SELECT patient_id, {S6.format('avg(pow(p - t, 2))')} AS dvh_loss, {S6.format('-ln(greatest(sum(sqrt(p * t)), 0.001))')} AS bhattacharyya_loss FROM o_h GROUP BY 1")
def dvh_loss(t):
    r = ml.dvh_losses(organ_pairs(t))
    return r.select("patient_id", snap(F.col("dvh_loss")).alias("dvh_loss"), snap(F.col("bhattacharyya_loss")).alias("bhattacharyya_loss"))


@query("berhu", f"{PAIR_SQL} SELECT patient_id, {S6.format('sum(CASE WHEN abs((p - t) * m) <= 0.5 THEN abs((p - t) * m) ELSE (pow((p - t) * m, 2) + 0.25::double) / 1.0::double END) / greatest(sum(m), 1e-8)')} AS loss FROM o_tp GROUP BY 1")
def berhu(t):
    return ml.berhu(pairs(t), ["patient_id"], delta=0.5).withColumn("loss", snap(F.col("loss")))


@query("dvh_comparison", f"{ORGAN_PAIR_SQL}, {BIN_SQL} SELECT patient_id, structure, bin, {S4.format('bin * (70.0::double / 350)')} AS bin_gy, {S4.format('t * 100')} AS true_perc, {S4.format('p * 100')} AS predicted_perc FROM o_h")
def dvh_comparison(t):
    r = ml.dvh_comparison(organ_pairs(t))
    return r.select("patient_id", "structure", "bin", *[snap(F.col(c), 4).alias(c) for c in ("bin_gy", "true_perc", "predicted_perc")])


MAP = [[0.98123457, -0.17234561, 0.01345619], [0.16456723, 0.97567833, -0.05678941], [0.01378929, 0.04892353, -0.99912367]]
SHIFT = [1.3, -0.7, 2.1]


AFFINE_SQL = f"""
o_f AS (SELECT v.patient_id, v.ix, v.iy, v.iz, least(greatest({MAP[0][0]}::double * v.ix + {MAP[0][1]}::double * v.iy + {MAP[0][2]}::double * v.iz + 1.3::double, 0), 24) AS fx,
 least(greatest({MAP[1][0]}::double * v.ix + {MAP[1][1]}::double * v.iy + {MAP[1][2]}::double * v.iz - 0.7::double, 0), 19) AS fy, least(greatest({MAP[2][0]}::double * v.ix + {MAP[2][1]}::double * v.iy + {MAP[2][2]}::double * v.iz + 2.1::double, 0), 2) AS fz FROM v_voxel v),
o_src AS (SELECT v.patient_id, v.ix, v.iy, v.iz, v.hu, v.prio, d.dose_gy FROM v_voxel v JOIN o_dose d ON d.patient_id = v.patient_id AND d.voxel_id = v.voxel_id AND d.plan_id = 'A'),
o_lin AS (SELECT c.patient_id, c.jx, c.jy, c.jz, sum(w * s.hu) AS hu, sum(w * s.dose_gy) AS dose FROM (SELECT patient_id, ix AS jx, iy AS jy, iz AS jz, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
   (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
   FROM o_f CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c)) c JOIN o_src s USING (patient_id, ix, iy, iz) WHERE w > 0 GROUP BY 1, 2, 3, 4)
SELECT f.patient_id, f.ix AS jx, f.iy AS jy, f.iz AS jz, {S4.format('l.hu')} AS hu, {S4.format('CASE WHEN s.dose_gy > 0 THEN l.dose ELSE 0 END')} AS dose_gy, CASE WHEN s.prio = '1-URGENT' THEN 1 ELSE 0 END::bigint AS target
FROM o_f f JOIN o_lin l ON l.patient_id = f.patient_id AND l.jx = f.ix AND l.jy = f.iy AND l.jz = f.iz JOIN o_src s ON s.patient_id = f.patient_id AND s.ix = floor(f.fx + 0.5)::bigint AND s.iy = floor(f.fy + 0.5)::bigint AND s.iz = floor(f.fz + 0.5)::bigint"""


def plan_a_grid(t):
    """CT, dose of plan A and target flag on CT cells."""
    return t.voxel.join(t.dose.filter("plan_id = 'A'"), ["patient_id", "voxel_id"]).select(
        "patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("hu"), "dose_gy", (F.col("prio") == "1-URGENT").cast("long").alias("target")
    )


def fixed_maps(t):
    maps = t.voxel.select("patient_id").distinct()
    for i in range(3):
        for j in range(3):
            maps = maps.withColumn(f"m{i}{j}", F.lit(MAP[i][j]))
        maps = maps.withColumn(f"o{i}", F.lit(SHIFT[i]))
    return maps


@query("augment_affine", AFFINE_SQL)
def augment_affine(t):
    r = ml.augment(plan_a_grid(t), fixed_maps(t), (25, 20, 3), ["hu", "dose_gy"], ["target"])
    return r.select("patient_id", "jx", "jy", "jz", snap(F.col("hu"), 4).alias("hu"), snap(F.col("dose_gy"), 4).alias("dose_gy"), "target")


def _draw(k):
    return f"('0x' || substr(md5('42|' || patient_id || '|' || {k} || '|' || {k * k}), 1, 13))::bigint / 4503599627370496.0::double"


SEED_SQL = f"""o_an AS (SELECT patient_id, {', '.join(f'CASE WHEN {_draw(k)} < 0.5 THEN -1.0::double ELSE 1.0::double END AS s{k}' for k in (1, 2, 3))}, {', '.join(f'radians((({_draw(k)}) * 2 - 1) * 10) AS {a}' for k, a in ((4, 'a'), (5, 'b'), (6, 'c')))},
 {', '.join(f'(({_draw(7 + i)}) * 2 - 1) * 10 AS h{i}' for i in range(3))} FROM (SELECT DISTINCT patient_id FROM v_voxel)),
o_m AS (SELECT *, s1 * (cos(c) * cos(b)) AS m00, s1 * (cos(c) * sin(b) * sin(a) - sin(c) * cos(a)) AS m01, s1 * (cos(c) * sin(b) * cos(a) + sin(c) * sin(a)) AS m02,
 s2 * (sin(c) * cos(b)) AS m10, s2 * (sin(c) * sin(b) * sin(a) + cos(c) * cos(a)) AS m11, s2 * (sin(c) * sin(b) * cos(a) - cos(c) * sin(a)) AS m12, s3 * (-sin(b)) AS m20, s3 * (cos(b) * sin(a)) AS m21, s3 * (cos(b) * cos(a)) AS m22 FROM o_an),
o_f AS (SELECT v.patient_id, v.ix, v.iy, v.iz, {', '.join(f"least(greatest(m{i}0 * v.ix + m{i}1 * v.iy + m{i}2 * v.iz + ({n} - (m{i}0 * 12.5::double + m{i}1 * 10 + m{i}2 * 1.5::double) + h{i}), 0), {top}) AS {f}" for i, n, top, f in ((0, '12.5::double', 24, 'fx'), (1, '10.0::double', 19, 'fy'), (2, '1.5::double', 2, 'fz')))} FROM v_voxel v JOIN o_m USING (patient_id))"""


@query("augment_parameters", f"{SEED_SQL} SELECT patient_id, {', '.join(S6.format(f'm{i}{j}') + f' AS m{i}{j}' for i in range(3) for j in range(3))} FROM o_m")
def augment_parameters(t):
    maps = ml.augment_parameters(t.voxel.select("patient_id").distinct(), (25, 20, 3), seed=42)
    return maps.select("patient_id", *[snap(F.col(f"m{i}{j}")).alias(f"m{i}{j}") for i in range(3) for j in range(3)])


SEEDED_SQL = f"""{SEED_SQL}, o_src AS (SELECT v.patient_id, v.ix, v.iy, v.iz, v.hu, v.prio, d.dose_gy FROM v_voxel v JOIN o_dose d ON d.patient_id = v.patient_id AND d.voxel_id = v.voxel_id AND d.plan_id = 'A'),
o_lin AS (SELECT c.patient_id, c.jx, c.jy, c.jz, sum(w * s.hu) AS hu, sum(w * s.dose_gy) AS dose FROM (SELECT patient_id, ix AS jx, iy AS jy, iz AS jz, floor(fx)::bigint + a.a AS ix, floor(fy)::bigint + b.b AS iy, floor(fz)::bigint + c.c AS iz,
   (CASE a.a WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) * (CASE b.b WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE c.c WHEN 1 THEN fz - floor(fz) ELSE 1 - fz + floor(fz) END) AS w
   FROM o_f CROSS JOIN (VALUES (0), (1)) a(a) CROSS JOIN (VALUES (0), (1)) b(b) CROSS JOIN (VALUES (0), (1)) c(c)) c JOIN o_src s USING (patient_id, ix, iy, iz) WHERE w > 0 GROUP BY 1, 2, 3, 4)
SELECT f.patient_id, f.ix AS jx, f.iy AS jy, f.iz AS jz, {S4.format('l.hu')} AS hu, {S4.format('CASE WHEN s.dose_gy > 0 THEN l.dose ELSE 0 END')} AS dose_gy, CASE WHEN s.prio = '1-URGENT' THEN 1 ELSE 0 END::bigint AS target
FROM o_f f JOIN o_lin l ON l.patient_id = f.patient_id AND l.jx = f.ix AND l.jy = f.iy AND l.jz = f.iz JOIN o_src s ON s.patient_id = f.patient_id AND s.ix = floor(f.fx + 0.5)::bigint AND s.iy = floor(f.fy + 0.5)::bigint AND s.iz = floor(f.fz + 0.5)::bigint"""


@query("augment_seeded", SEEDED_SQL)
def augment_seeded(t):
    grid = t.voxel.join(t.dose.filter("plan_id = 'A'"), ["patient_id", "voxel_id"]).select(
        "patient_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("hu"), "dose_gy", (F.col("prio") == "1-URGENT").cast("long").alias("target")
    )
    maps = ml.augment_parameters(t.voxel.select("patient_id").distinct(), (25, 20, 3), seed=42)
    r = ml.augment(grid, maps, (25, 20, 3), ["hu", "dose_gy"], ["target"])
    return r.select("patient_id", "jx", "jy", "jz", snap(F.col("hu"), 4).alias("hu"), snap(F.col("dose_gy"), 4).alias("dose_gy"), "target")


@query("feature_channels", f"{FEATURE_SQL} SELECT patient_id, ix, iy, iz, {S6.format('ct_norm')} AS ct_norm, {S6.format('open_field')} AS open_field_gy, {', '.join(f'CASE WHEN label = {k} THEN 1 ELSE 0 END::bigint AS organ_{k}' for k in range(1, 6))}, target FROM o_feat")
def feature_channels(t):
    r = ml.feature_channels(features(t))
    return r.withColumn("ct_norm", snap(F.col("ct_norm"))).withColumn("open_field_gy", snap(F.col("open_field_gy")))


AUGMENT_PLANS = (
    ("v.prio, d.dose_gy FROM", "v.prio, d.dose_gy, d.plan_id FROM"), (" AND d.plan_id = 'A'", ""), ("SELECT c.patient_id, c.jx", "SELECT c.patient_id, s.plan_id, c.jx"), ("WHERE w > 0 GROUP BY 1, 2, 3, 4)", "WHERE w > 0 GROUP BY 1, 2, 3, 4, 5)"),
    ("SELECT f.patient_id, f.ix AS jx", "SELECT f.patient_id, l.plan_id, f.ix AS jx"), ("JOIN o_src s ON s.patient_id = f.patient_id", "JOIN o_src s ON s.patient_id = f.patient_id AND s.plan_id = l.plan_id"),
)


def augmented_plans(t, maps):
    grid = t.voxel.join(t.dose, ["patient_id", "voxel_id"]).select(
        "patient_id", "plan_id", "ix", "iy", "iz", F.col("hu").cast("double").alias("hu"), "dose_gy", (F.col("prio") == "1-URGENT").cast("long").alias("target")
    )
    r = ml.augment(grid, maps, (25, 20, 3), ["hu", "dose_gy"], ["target"])
    return r.select("patient_id", "plan_id", "jx", "jy", "jz", snap(F.col("hu"), 4).alias("hu"), snap(F.col("dose_gy"), 4).alias("dose_gy"), "target")


@query("augment_affine_plans", changed(AFFINE_SQL, *AUGMENT_PLANS))
def augment_affine_plans(t):
    maps = t.voxel.select("patient_id").distinct().select(
        "patient_id", *[F.lit(MAP[i][j]).alias(f"m{i}{j}") for i in range(3) for j in range(3)], *[F.lit(SHIFT[i]).alias(f"o{i}") for i in range(3)]
    )
    return augmented_plans(t, maps)


@query("augment_seeded_plans", changed(SEEDED_SQL, *AUGMENT_PLANS))
def augment_seeded_plans(t):
    return augmented_plans(t, ml.augment_parameters(t.voxel.select("patient_id").distinct(), (25, 20, 3), seed=42))


@query("feature_channels_plans", f"{FEATURE_PLANS_SQL} SELECT patient_id, plan_id, ix, iy, iz, {S6.format('ct_norm')} AS ct_norm, {S6.format('open_field')} AS open_field_gy, {', '.join(f'CASE WHEN label = {k} THEN 1 ELSE 0 END::bigint AS organ_{k}' for k in range(1, 6))}, target FROM o_feat")
def feature_channels_plans(t):
    r = ml.feature_channels(features(t, t.dose))
    return r.withColumn("ct_norm", snap(F.col("ct_norm"))).withColumn("open_field_gy", snap(F.col("open_field_gy")))
