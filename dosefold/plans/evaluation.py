"""Dose and dose-volume queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import rows, snap
from dosefold.operators import evaluation as ev
from dosefold.plans.registry import query

RX, FX = 60.0, 30
S6 = "floor(({}) * 1e6 + 0.5) / 1e6"
TAILS = [("t1", "PTV", 90.0, "lower"), ("t2", "CORD", 5.0, "upper"), ("t3", "BODY", 20.0, "upper"),
         ("t4", "HEART", 0.01, "upper")]
TAIL_SQL = ("o_req(request_id, structure, volume_perc, bound_type) AS (values ('t1','PTV',90.0::double,'lower'),"
            "('t2','CORD',5.0::double,'upper'),('t3','BODY',20.0::double,'upper'),('t4','HEART',0.01::double,'upper'))")
D_SQL = """CASE WHEN q.v > 100.1 OR q.v > 100 * s.frac THEN 0.0
     WHEN 100 * g.y = q.v THEN g.x
     ELSE g.x + (q.v - 100 * g.y) * (g.x2 - g.x) / (100 * g.y2 - 100 * g.y) END"""
D_FROM = """FROM o_struct s JOIN (SELECT DISTINCT structure, patient_id, plan_id FROM o_sd) k USING (structure, patient_id)
CROSS JOIN (VALUES {values}) q(v)
LEFT JOIN o_seg g ON g.structure = k.structure AND g.patient_id = k.patient_id AND g.plan_id = k.plan_id
  AND 100 * g.y >= q.v AND 100 * g.y2 < q.v"""


def tails(t):
    return F.broadcast(rows(t.spark, "request_id string, structure string, volume_perc double, bound_type string", TAILS))


@query("structure_dose_summary", f"""
o_d AS (SELECT k.structure, k.patient_id, k.plan_id, {D_SQL} AS d95 {D_FROM.format(values='(95.0::double)')}),
o_u AS (SELECT structure, patient_id, plan_id, x, max(y) AS y FROM o_curve GROUP BY 1, 2, 3, 4),
o_v AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, min(x) OVER (PARTITION BY structure, patient_id, plan_id) AS lo,
        max(x) OVER (PARTITION BY structure, patient_id, plan_id) AS hi, max(y) OVER (PARTITION BY structure, patient_id, plan_id) AS top
        FROM o_u WINDOW w AS (PARTITION BY structure, patient_id, plan_id ORDER BY x)),
o_v20 AS (SELECT structure, patient_id, plan_id, max(CASE WHEN hi < 20 THEN 0 WHEN lo > 20 THEN 100 * top
            WHEN x <= 20 AND x2 > 20 THEN 100 * y + (20 - x) * (100 * y2 - 100 * y) / (x2 - x) WHEN x = 20 AND x2 IS NULL THEN 0 END) AS v20
          FROM o_v GROUP BY 1, 2, 3)
SELECT p.patient_id, p.plan_id, p.structure, max(p.dose_gy) AS max_dose_gy,
  {S6.format('sum(p.vol_u * p.dose_gy) / sum(p.vol_u) * max(s.frac)')} AS mean_dose_gy,
  {S6.format('max(v.v20)')} AS v20_perc, {S6.format('max(d.d95)')} AS d95_gy
FROM o_pt p JOIN o_struct s USING (structure, patient_id)
JOIN o_v20 v ON v.structure = p.structure AND v.patient_id = p.patient_id AND v.plan_id = p.plan_id
JOIN o_d d ON d.structure = p.structure AND d.patient_id = p.patient_id AND d.plan_id = p.plan_id
GROUP BY 1, 2, 3""")
def structure_dose_summary(t):
    r = ev.structure_dose_summary(t.structure_dose, t.structure)
    return r.select(
        *ev.KEYS, "max_dose_gy", snap(F.col("mean_dose_gy")).alias("mean_dose_gy"),
        snap(F.col("volume_at_dose_perc")).alias("v20_perc"), snap(F.col("dose_at_volume_gy")).alias("d95_gy"),
    )


@query("dvh", f"""SELECT patient_id, plan_id, structure, voxel_id, {S6.format('x')} AS dose_gy, {S6.format('y')} AS volume_frac FROM o_curve""")
def dvh(t):
    points = ev.dvh(t.structure_dose, t.structure)
    return points.select(*ev.KEYS, "voxel_id", snap(F.col("x")).alias("dose_gy"), snap(F.col("y")).alias("volume_frac"))


@query("dvh_unweighted", f"""
o_n AS (SELECT *, row_number() OVER (PARTITION BY structure, patient_id, plan_id ORDER BY dose_gy, voxel_id) - 1 AS i,
  count(*) OVER (PARTITION BY structure, patient_id, plan_id) AS n FROM o_sd)
SELECT patient_id, plan_id, structure, voxel_id, {S6.format('dose_gy')} AS dose_gy,
  {S6.format('1 - cast(i as double) / n')} AS volume_frac FROM o_n
UNION ALL SELECT patient_id, plan_id, structure, NULL, {S6.format('max(dose_gy) + cast(0.01 as double)')}, cast(0 as double)
FROM o_n GROUP BY 1, 2, 3""")
def dvh_unweighted(t):
    points = ev.dvh(t.structure_dose, t.structure, weighted=False)
    return points.select(*ev.KEYS, "voxel_id", snap(F.col("x")).alias("dose_gy"), snap(F.col("y")).alias("volume_frac"))


@query("dose_at_volume", f"""
SELECT k.structure, k.patient_id, k.plan_id, q.v AS volume_perc, {S6.format(D_SQL)} AS dose_at_volume_gy
{D_FROM.format(values='(2.0::double),(50.0::double),(90.0::double),(98.0::double),(99.9::double),(101.0::double)')}""")
def dose_at_volume(t):
    r = ev.dose_at_volume(t.structure_dose, t.structure, [2, 50, 90, 98, 99.9, 101])
    return r.withColumn("dose_at_volume_gy", snap(F.col("dose_at_volume_gy")))


@query("volume_at_dose", f"""
o_u AS (SELECT structure, patient_id, plan_id, x, max(y) AS y FROM o_curve GROUP BY 1, 2, 3, 4),
o_v AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, min(x) OVER p AS lo, max(x) OVER p AS hi, max(y) OVER p AS top
  FROM o_u WINDOW w AS (PARTITION BY structure, patient_id, plan_id ORDER BY x), p AS (PARTITION BY structure, patient_id, plan_id))
SELECT structure, patient_id, plan_id, q.d AS at_dose_gy,
  {S6.format('''max(CASE WHEN hi < q.d THEN 0 WHEN lo > q.d THEN 100 * top
    WHEN x <= q.d AND x2 > q.d THEN 100 * y + (q.d - x) * (100 * y2 - 100 * y) / (x2 - x) WHEN x = q.d AND x2 IS NULL THEN 0 END)''')} AS volume_at_dose_perc
FROM o_v CROSS JOIN (VALUES (0.0::double),(5.0::double),(20.0::double),(45.5::double),(500.0::double)) q(d) GROUP BY 1, 2, 3, 4""")
def volume_at_dose(t):
    r = ev.volume_at_dose(t.structure_dose, t.structure, [0, 5, 20, 45.5, 500])
    return r.withColumn("volume_at_dose_perc", snap(F.col("volume_at_dose_perc")))


@query("max_dose", "SELECT patient_id, plan_id, structure, max(dose_gy) AS max_dose_gy FROM o_sd GROUP BY 1, 2, 3")
def max_dose(t):
    return ev.dose_statistics(t.structure_dose, t.structure).select(*ev.KEYS, "max_dose_gy")


@query("mean_dose", f"""SELECT d.patient_id, d.plan_id, d.structure,
{S6.format('sum(d.vol_u * d.dose_gy) / sum(d.vol_u) * max(s.frac)')} AS mean_dose_gy
FROM o_sd d JOIN o_struct s USING (structure, patient_id) GROUP BY 1, 2, 3""")
def mean_dose(t):
    r = ev.dose_statistics(t.structure_dose, t.structure)
    return r.select(*ev.KEYS, snap(F.col("mean_dose_gy")).alias("mean_dose_gy"))


CONFORM_SQL = """SELECT d.patient_id, d.plan_id, {out} FROM o_dose d
LEFT JOIN (SELECT patient_id, voxel_id FROM v_structure_voxel WHERE structure = '{s}') p USING (patient_id, voxel_id) GROUP BY 1, 2"""


def _conform(threshold):
    both = f"count(*) FILTER (WHERE p.voxel_id IS NOT NULL AND d.dose_gy >= {threshold})"
    return S6.format(f"cast({both} * {both} as double) / nullif(count(p.voxel_id) * count(*) FILTER (WHERE d.dose_gy >= {threshold}), 0)")


# the target column of o_dose has the name voxel_id too, so the mask is renamed in the join
CONFORM_SQL = CONFORM_SQL.replace("SELECT patient_id, voxel_id FROM", "SELECT patient_id AS pid, voxel_id FROM").replace(
    "USING (patient_id, voxel_id)", "ON p.pid = d.patient_id AND p.voxel_id = d.voxel_id")


@query("conformity_index", CONFORM_SQL.format(s="PTV", out=_conform("57.0") + " AS conformity_index"))
def conformity_index(t):
    target = t.structure_voxel.filter("structure = 'PTV'")
    r = ev.conformity(t.dose, target, 0.95 * RX)
    return r.withColumn("conformity_index", snap(F.col("conformity_index")))


@query("conformation_number", CONFORM_SQL.format(s="GTV", out=_conform("30.0") + " AS conformation_number"))
def conformation_number(t):
    target = t.structure_voxel.filter("structure = 'GTV'")
    r = ev.conformity(t.dose, target, 30.0, "conformation_number")
    return r.withColumn("conformation_number", snap(F.col("conformation_number")))


@query("homogeneity_index", f"""SELECT d.patient_id, d.plan_id,
{S6.format("(quantile_cont(dose_gy, 0.98) - quantile_cont(dose_gy, 0.02)) / quantile_cont(dose_gy, 0.5)")} AS homogeneity_index
FROM o_dose d JOIN v_structure_voxel s USING (patient_id, voxel_id) WHERE s.structure = 'PTV' GROUP BY 1, 2""")
def homogeneity_index(t):
    target = t.structure_voxel.filter("structure = 'PTV'").select("patient_id", "voxel_id")
    r = ev.homogeneity(t.dose.join(target, ["patient_id", "voxel_id"], "left_semi"))
    return r.withColumn("homogeneity_index", snap(F.col("homogeneity_index")))


@query("biologically_effective_dose", f"""SELECT patient_id, plan_id, voxel_id,
{S6.format("30 * (dose_gy / 30 + (dose_gy / 30) * (dose_gy / 30) / 10)")} AS bed_gy FROM o_dose""")
def biologically_effective_dose(t):
    r = ev.biologically_effective_dose(t.dose, FX, alpha=0.3, beta=0.03)
    return r.select("patient_id", "plan_id", "voxel_id", snap(F.col("bed_gy")).alias("bed_gy"))


@query("normalize_dose", f"""
o_d90 AS (SELECT k.structure, k.patient_id, k.plan_id, {D_SQL} AS d90 {D_FROM.format(values='(90.0::double)')})
SELECT d.patient_id, d.plan_id, d.voxel_id, {S6.format('d.dose_gy / nullif(n.d90 / 60.0::double, 0)')} AS dose_norm_gy
FROM o_dose d JOIN o_d90 n ON n.patient_id = d.patient_id AND n.plan_id = d.plan_id AND n.structure = 'PTV'""")
def normalize_dose(t):
    r = ev.normalize_dose(t.dose, t.structure_dose, t.structure, RX)
    return r.select("patient_id", "plan_id", "voxel_id", snap(F.col("dose_norm_gy")).alias("dose_norm_gy"))


@query("dvh_scaled", f"""SELECT c.patient_id, c.plan_id, c.structure, c.voxel_id, {S6.format('x')} AS dose_gy,
{S6.format('x / 60.0::double * 100')} AS dose_perc, {S6.format('y * 100')} AS volume_perc,
{S6.format('y * s.volume_cc')} AS volume_cc FROM o_curve c JOIN o_struct s USING (structure, patient_id)""")
def dvh_scaled(t):
    r = ev.scaled_dvh(ev.dvh(t.structure_dose, t.structure), t.structure, RX)
    return r.select(*ev.KEYS, "voxel_id", *[snap(F.col(c)).alias(c) for c in ("dose_gy", "dose_perc", "volume_perc", "volume_cc")])


@query("robust_dvh", f"""
o_all AS (SELECT o.structure, o.patient_id, o.voxel_id, q.scenario, coalesce(c.dose_gy, 0) AS dose_gy
  FROM o_ov o CROSS JOIN (VALUES ('A'), ('N'), ('R')) q(scenario)
  LEFT JOIN v_scenario c ON c.patient_id = o.patient_id AND c.voxel_id = o.voxel_id AND c.scenario = q.scenario),
o_r AS (SELECT *, row_number() OVER (PARTITION BY structure, patient_id, scenario ORDER BY dose_gy, voxel_id) AS rank FROM o_all)
SELECT patient_id, structure, rank, min(dose_gy) AS dose_min_gy, max(dose_gy) AS dose_max_gy,
  {S6.format('sum(dose_gy) / count(*)')} AS dose_mean_gy FROM o_r GROUP BY 1, 2, 3""")
def robust_dvh(t):
    scenarios = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    full = t.opt_voxel.withColumn("scenario", F.explode(scenarios)).join(
        t.scenario, ["patient_id", "voxel_id", "scenario"], "left"
    ).fillna(0.0, ["dose_gy"])
    r = ev.robust_dvh(full, t.structure)
    return r.withColumn("dose_mean_gy", snap(F.col("dose_mean_gy")))


@query("isodose_volumes", f"""
SELECT patient_id, plan_id, structure, q.level, {S6.format("sum(CASE WHEN dose_gy >= q.level * 60.0::double THEN cast(vol_u as double) / 1e6 ELSE 0 END)")} AS volume_cc
FROM o_sd CROSS JOIN (VALUES (0.3::double),(0.5::double),(0.7::double),(0.9::double),(1.0::double),(1.1::double)) q(level) GROUP BY 1, 2, 3, 4""")
def isodose_volumes(t):
    r = ev.isodose_volumes(t.structure_dose, RX)
    return r.withColumn("volume_cc", snap(F.col("volume_cc")))


@query("low_dose_voxels", f"""{TAIL_SQL},
o_t AS (SELECT p.*, r.request_id, r.bound_type, r.volume_perc / s.frac AS share,
  CASE WHEN r.bound_type = 'lower' THEN p.total - p.below - p.vol_u ELSE p.below END AS before
  FROM o_pt p JOIN o_req r USING (structure) JOIN o_struct s USING (structure, patient_id))
SELECT request_id, patient_id, plan_id, structure, voxel_id, dose_gy FROM o_t
WHERE before = 0 OR cast(before as double) / cast(total as double) * 100 < CASE WHEN bound_type = 'lower' THEN share ELSE 100 - share END""")
def low_dose_voxels(t):
    return ev.low_dose_voxels(t.structure_dose, t.structure, tails(t))


@query("tail_mean", f"""{TAIL_SQL},
o_t AS (SELECT p.*, r.request_id, r.bound_type, CASE WHEN r.bound_type = 'lower' THEN 1 - r.volume_perc / s.frac / 100 ELSE r.volume_perc / s.frac / 100 END AS fr,
  CASE WHEN r.bound_type = 'lower' THEN p.below + p.vol_u ELSE p.total - p.below END AS upto
  FROM o_pt p JOIN o_req r USING (structure) JOIN o_struct s USING (structure, patient_id))
SELECT request_id, patient_id, plan_id, structure,
  {S6.format('''coalesce(sum(CASE WHEN upto <= fr * total THEN vol_u * dose_gy END) / sum(CASE WHEN upto <= fr * total THEN vol_u END),
    CASE WHEN max(bound_type) = 'lower' THEN min(dose_gy) ELSE max(dose_gy) END)''')} AS tail_mean_gy
FROM o_t GROUP BY 1, 2, 3, 4""")
def tail_mean(t):
    r = ev.tail_mean(t.structure_dose, t.structure, tails(t))
    return r.withColumn("tail_mean_gy", snap(F.col("tail_mean_gy")))


@query("dose_difference", f"""
SELECT o.patient_id, o.structure, {S6.format('max(abs(b.dose_gy - a.dose_gy))')} AS max_abs_diff_gy,
  {S6.format('avg(abs(b.dose_gy - a.dose_gy))')} AS mean_abs_diff_gy, {S6.format('avg(b.dose_gy - a.dose_gy)')} AS mean_diff_gy
FROM o_ov o JOIN o_dose a ON a.patient_id = o.patient_id AND a.voxel_id = o.voxel_id AND a.plan_id = 'A'
JOIN o_dose b ON b.patient_id = o.patient_id AND b.voxel_id = o.voxel_id AND b.plan_id = 'B' GROUP BY 1, 2""")
def dose_difference(t):
    r = ev.dose_difference(t.dose, t.opt_voxel, "A", "B")
    return r.select("patient_id", "structure", *[snap(F.col(c)).alias(c) for c in ("max_abs_diff_gy", "mean_abs_diff_gy", "mean_diff_gy")])


@query("dvh_binned", """
SELECT patient_id, plan_id, structure, b.bin, floor(b.bin * (70.0::double / 350) * 1e4 + 0.5) / 1e4 AS bin_gy,
  floor(avg(1 / (1 + exp(-(dose_gy - b.bin * (70.0::double / 350)) / (70.0::double / 350)))) * 1e4 + 0.5) / 1e4 AS volume_frac
FROM o_sd CROSS JOIN (SELECT range AS bin FROM range(351)) b GROUP BY 1, 2, 3, 4""")
def dvh_binned(t):
    r = ev.smoothed_dvh(t.structure_dose, ev.KEYS)
    return r.select(*ev.KEYS, "bin", snap(F.col("bin_gy"), 4).alias("bin_gy"), snap(F.col("volume_frac"), 4).alias("volume_frac"))
