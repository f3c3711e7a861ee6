"""Criteria and scorecard queries: a fixed protocol applied to every patient, with patient-dependent bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.nearest import nearest_site
from dosefold.functions.numeric import fan_out, rows, snap
from dosefold.operators import criteria as cr
from dosefold.operators import structures as st
from dosefold.plans.evaluation import D_SQL, RX, S6
from dosefold.plans.registry import query

RES = (0.98, 0.98, 3.0)
SCHEMA = (
    "criterion_id long, type string, structure string, dose_value double, dose_unit string, volume_value double, volume_unit string, "
    "coldest boolean, bound_key string, num long, txt string, bound_type string, weight double"
)
PROTOCOL = [
    (0, "max_dose", "PTV", None, None, None, None, None, "limit_dose_gy", 66, None, None, None),
    (0, "max_dose", "PTV", None, None, None, None, None, "goal_dose_gy", None, "1.1*prescription_gy", None, None),
    (1, "mean_dose", "HEART", None, None, None, None, None, "limit_dose_gy", 27, None, None, None),
    (1, "mean_dose", "HEART", None, None, None, None, None, "goal_dose_gy", 20, None, None, None),
    (2, "max_dose", "CORD", None, None, None, None, None, "limit_dose_perc", 83, None, None, None),
    (2, "max_dose", "CORD", None, None, None, None, None, "goal_dose_gy", None, "N/A", None, None),
    (3, "dose_volume_V", "LUNG_L", 20.0, "gy", None, None, None, "limit_volume_perc", 37, None, None, None),
    (3, "dose_volume_V", "LUNG_L", 20.0, "gy", None, None, None, "goal_volume_perc", 30, None, None, 8.0),
    (4, "dose_volume_V", "CORD", 50.0, "perc", None, None, None, "limit_volume_cc", 900, None, None, None),
    (4, "dose_volume_V", "CORD", 50.0, "perc", None, None, None, "goal_volume_cc", -5, None, None, None),
    (5, "dose_volume_D", "PTV", None, None, 95.0, "perc", None, "goal_dose_perc", 95, None, "lower", None),
    (6, "dose_volume_D", "HEART", None, None, 500.0, "cc", None, "limit_dose_perc", 80, None, None, None),
    (7, "dose_volume_V", "LUNG_R", 15.0, "gy", None, None, True, "limit_volume_cc", 700, None, None, None),
    (8, "max_dose", "LIVER", None, None, None, None, None, "limit_dose_gy", 30, None, None, None),
    (9, "mean_dose", "LUNG_R", None, None, None, None, None, "limit_dose_gy", None, "prescription_gy - 2", None, None),
    (10, "max_dose", "PTV_LOW", None, None, None, None, None, "limit_dose_gy", 70, None, None, None),
    (11, "dose_volume_V", "GTV", 57.0, "gy", None, None, None, "limit_volume_perc", 99, None, None, None),
    (12, "dose_volume_D", "LUNG_R", None, None, 40.0, "perc", True, "limit_dose_gy", 50, None, None, None),
]
UPDATES = [
    (0, "max_dose", "PTV", None, None, None, None, None, "limit_dose_gy", 64, None, None, None),
    (1, "mean_dose", "HEART", None, None, None, None, None, "limit_dose_perc", 40, None, None, None),
    (3, "dose_volume_V", "LUNG_L", 20.0, "gy", None, None, None, "goal_volume_perc", 25, None, None, 9.0),
    (20, "dose_volume_V", "BOX", 30.0, "gy", None, None, None, "limit_volume_perc", 60, None, None, None),
]


def literal(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return f"{v}::double"
    return f"'{v}'" if isinstance(v, str) else f"{v}::bigint"


COLS = [c.split(" ")[0] for c in SCHEMA.split(", ")]
TYPES = {"string": "varchar", "double": "double", "long": "bigint", "boolean": "boolean"}


def criteria_sql(name, data):
    """The same protocol rows as SQL, crossed with the patients."""
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in data)
    typed = ", ".join(f"cast({c} as {TYPES[k]}) as {c}" for c, k in (x.split(" ") for x in SCHEMA.split(", ")))
    return f"""{name} AS (SELECT p.patient_id, {typed}, coalesce(txt, cast(num + p.patient_id % 3 as varchar)) AS bound_value
  FROM (SELECT DISTINCT patient_id FROM v_voxel) p CROSS JOIN (VALUES {values}) q({', '.join(COLS)}))"""


VALUE = """CASE WHEN bound_value LIKE '%*prescription_gy' THEN try_cast(replace(bound_value, '*prescription_gy', '') as double) * 60 ELSE try_cast(bound_value as double) END"""
C_SQL = criteria_sql("o_raw", PROTOCOL) + f", o_crit AS (SELECT *, {VALUE} AS v FROM o_raw)"
OK_SQL = C_SQL + ", o_ok AS (SELECT * FROM o_crit WHERE v >= 0)"


def protocol(t, data=PROTOCOL):
    return fan_out(t.voxel.select("patient_id").distinct(), SCHEMA, data).withColumn(
        "bound_value", F.coalesce("txt", (F.col("num") + F.col("patient_id") % 3).cast("string"))
    ).drop("num", "txt")


@query("criteria_list", f"{OK_SQL} SELECT patient_id, criterion_id, type, structure, bound_key, bound_value FROM o_ok")
def criteria_list(t):
    return cr.criteria_list(protocol(t), RX).select("patient_id", "criterion_id", "type", "structure", "bound_key", "bound_value")


@query("criteria_list_by_type", f"{OK_SQL} SELECT patient_id, criterion_id, structure, bound_key, bound_value FROM o_ok WHERE type = 'max_dose'")
def criteria_list_by_type(t):
    return cr.criteria_list(protocol(t), RX, "max_dose").select("patient_id", "criterion_id", "structure", "bound_key", "bound_value")


@query("resolve_bound", f"""{C_SQL} SELECT patient_id, criterion_id, bound_key, {S6.format("CASE WHEN bound_value LIKE '%prescription_gy%' OR bound_key LIKE '%gy%' THEN v WHEN bound_key LIKE '%dose_perc%' THEN v * 60 / 100 END")} AS bound_gy FROM o_crit""")
def resolve_bound(t):
    return cr.resolve_bound(protocol(t), RX).select("patient_id", "criterion_id", "bound_key", snap(F.col("bound_gy")).alias("bound_gy"))


UP_SQL = f"{C_SQL}, {criteria_sql('o_new', UPDATES)}"
SAME = "n.patient_id = o.patient_id AND n.type = o.type AND n.structure = o.structure AND n.dose_value IS NOT DISTINCT FROM o.dose_value AND n.volume_value IS NOT DISTINCT FROM o.volume_value"


@query("criterion_upsert", f"""{UP_SQL} SELECT o.patient_id, o.criterion_id, o.type, o.structure, o.bound_key, coalesce(n.bound_value, o.bound_value) AS bound_value
FROM o_crit o LEFT JOIN o_new n ON {SAME} AND n.bound_key = o.bound_key
UNION ALL SELECT n.patient_id, n.criterion_id, n.type, n.structure, n.bound_key, n.bound_value FROM o_new n WHERE NOT EXISTS (SELECT 1 FROM o_crit o WHERE {SAME} AND n.bound_key = o.bound_key)""")
def criterion_upsert(t):
    r = cr.criterion_upsert(protocol(t), protocol(t, UPDATES))
    return r.select("patient_id", "criterion_id", "type", "structure", "bound_key", "bound_value")


GYPERC = """SELECT c.patient_id, c.criterion_id, c.type, c.structure, c.bound_type, c.weight, s.frac, s.volume_cc,
 CASE WHEN c.type = 'dose_volume_D' THEN replace(bound_key, 'perc', 'gy') ELSE replace(bound_key, 'volume_cc', 'volume_perc') END AS bound_key,
 CASE WHEN c.type = 'dose_volume_D' THEN CASE WHEN bound_key LIKE '%perc%' THEN v / 100 * 60 ELSE v END
  ELSE CASE WHEN coldest THEN 100 - CASE WHEN bound_key LIKE '%cc' THEN v / s.volume_cc * 100 ELSE v END ELSE CASE WHEN bound_key LIKE '%cc' THEN v / s.volume_cc * 100 ELSE v END END END AS bound,
 CASE WHEN c.type = 'dose_volume_V' THEN CASE WHEN dose_unit = 'perc' THEN dose_value / 100 * 60 ELSE dose_value END END AS dose_gy,
 CASE WHEN c.type = 'dose_volume_D' THEN CASE WHEN coldest THEN 100 - CASE WHEN volume_unit = 'cc' THEN volume_value / s.volume_cc * 100 ELSE volume_value END
  ELSE CASE WHEN volume_unit = 'cc' THEN volume_value / s.volume_cc * 100 ELSE volume_value END END END AS volume_perc
 FROM {src} c JOIN o_struct s USING (patient_id, structure) WHERE c.type LIKE 'dose_volume%'"""


@query("to_gy_and_percent", f"""{C_SQL}, o_g AS ({GYPERC.format(src='o_crit')}) SELECT patient_id, criterion_id, structure, bound_key, {S6.format('bound')} AS bound, {S6.format('dose_gy')} AS dose_gy, {S6.format('volume_perc')} AS volume_perc FROM o_g""")
def to_gy_and_percent(t):
    r = cr.to_gy_and_percent(protocol(t), t.structure, RX)
    return r.select("patient_id", "criterion_id", "structure", "bound_key", *[snap(F.col(c)).alias(c) for c in ("bound", "dose_gy", "volume_perc")])


@query("cold_to_hot", f"""{C_SQL} SELECT c.patient_id, c.criterion_id, c.structure, c.bound_key,
 {S6.format("CASE WHEN coldest AND type = 'dose_volume_V' THEN CASE WHEN bound_key LIKE '%cc' THEN s.volume_cc - v ELSE 100 - v END ELSE v END")} AS bound,
 {S6.format("CASE WHEN coldest AND type = 'dose_volume_D' THEN CASE WHEN volume_unit = 'cc' THEN s.volume_cc - volume_value ELSE 100 - volume_value END ELSE volume_value END")} AS volume_value
FROM o_crit c LEFT JOIN o_struct s USING (patient_id, structure)""")
def cold_to_hot(t):
    r = cr.cold_to_hot(protocol(t), t.structure, RX)
    return r.select("patient_id", "criterion_id", "structure", "bound_key", snap(F.col("bound")).alias("bound"), snap(F.col("volume_value")).alias("volume_value"))


TABLE_SQL = f"""{UP_SQL}, o_hit AS (SELECT DISTINCT o.patient_id, o.criterion_id FROM o_crit o JOIN o_new n ON {SAME} AND n.bound_key = o.bound_key),
o_merged AS (SELECT o.* FROM o_crit o LEFT JOIN o_hit h USING (patient_id, criterion_id) WHERE h.criterion_id IS NULL UNION ALL SELECT n.*, {VALUE.replace('bound_value', 'n.bound_value')} AS v FROM o_new n),
o_okm AS (SELECT * FROM o_merged WHERE v >= 0), o_g AS ({GYPERC.format(src='o_okm')}),
o_table AS (SELECT patient_id, criterion_id, structure, CASE WHEN type = 'dose_volume_D' THEN bound ELSE dose_gy END AS dose_gy,
 CASE WHEN type = 'dose_volume_D' THEN volume_perc ELSE bound END AS volume_perc, CASE WHEN bound_key LIKE 'goal%' THEN 'goal' ELSE 'constraint' END AS dvh_type,
 coalesce(bound_type, 'upper') AS bound_type, CASE WHEN bound_key LIKE 'goal%' THEN coalesce(weight, 5.0::double) END AS weight, frac FROM o_g WHERE frac > 0)"""
TABLE_COLS = f"patient_id, criterion_id, structure, {S6.format('dose_gy')} AS dose_gy, {S6.format('volume_perc')} AS volume_perc, dvh_type, bound_type, weight"


def table(t):
    return cr.dvh_table(protocol(t), t.structure, RX, protocol(t, UPDATES))


def shown(df, *more):
    return df.select(
        "patient_id", "criterion_id", "structure", snap(F.col("dose_gy")).alias("dose_gy"), snap(F.col("volume_perc")).alias("volume_perc"),
        "dvh_type", "bound_type", "weight", *more,
    )


@query("dvh_table", f"{TABLE_SQL} SELECT {TABLE_COLS} FROM o_table")
def dvh_table(t):
    return shown(table(t))


@query("max_tolerance", f"""{TABLE_SQL} SELECT {TABLE_COLS.replace('patient_id', 't.patient_id', 1).replace('criterion_id', 't.criterion_id', 1)}, {S6.format('''coalesce(
 (SELECT max(CASE WHEN c.bound_key LIKE '%perc' THEN c.v * 60 / 100 ELSE c.v END) FROM o_crit c WHERE c.patient_id = t.patient_id AND c.type = 'max_dose' AND c.bound_key LIKE 'limit%' AND c.v >= 0
   AND (c.structure = t.structure OR starts_with(c.structure, t.structure || '_'))), 90.0::double)''')} AS max_tol_gy FROM o_table t""")
def max_tolerance(t):
    r = cr.max_tolerance(table(t), protocol(t), RX)
    return shown(r, snap(F.col("max_tol_gy")).alias("max_tol_gy"))


@query("dvh_table_filter", f"{TABLE_SQL} SELECT {TABLE_COLS} FROM o_table WHERE volume_perc / frac < 100 AND volume_perc / frac > 0")
def dvh_table_filter(t):
    return shown(cr.dvh_table_filter(table(t), t.structure))


R2 = "round_even(({}) * 100, 0) / 100"
V_ANY = """CASE WHEN hi < q.d THEN 0 WHEN lo > q.d THEN 100 * top WHEN x <= q.d AND x2 > q.d THEN 100 * y + (q.d - x) * (100 * y2 - 100 * y) / (x2 - x) WHEN x = q.d AND x2 IS NULL THEN 0 END"""
CURVES = """o_u AS (SELECT structure, patient_id, plan_id, x, max(y) AS y FROM o_curve GROUP BY 1, 2, 3, 4),
o_v AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, min(x) OVER p AS lo, max(x) OVER p AS hi, max(y) OVER p AS top
  FROM o_u WINDOW w AS (PARTITION BY structure, patient_id, plan_id ORDER BY x), p AS (PARTITION BY structure, patient_id, plan_id)),
o_mm AS (SELECT p.structure, p.patient_id, p.plan_id, max(dose_gy) AS mx, sum(vol_u * dose_gy) / sum(vol_u) * max(s.frac) AS mean
  FROM o_sd p JOIN o_struct s USING (structure, patient_id) GROUP BY 1, 2, 3)"""
REPORT_SQL = f"""{OK_SQL}, {CURVES},
o_hot AS (SELECT c.*, s.volume_cc, s.frac, CASE WHEN coldest AND type = 'dose_volume_V' THEN CASE WHEN bound_key LIKE '%cc' THEN s.volume_cc - v ELSE 100 - v END ELSE v END AS b,
  CASE WHEN coldest AND type = 'dose_volume_D' THEN CASE WHEN volume_unit = 'cc' THEN s.volume_cc - volume_value ELSE 100 - volume_value END ELSE volume_value END AS vv,
  CASE WHEN bound_key LIKE '%gy' OR bound_value LIKE '%prescription_gy%' THEN 'Gy' WHEN bound_key LIKE '%cc' THEN 'cc' ELSE '%' END AS unit FROM o_ok c JOIN o_struct s USING (patient_id, structure)),
o_l AS (SELECT patient_id, criterion_id, type, structure, dose_value, dose_unit, vv, volume_unit, volume_cc, frac,
  max(CASE WHEN bound_key LIKE 'limit%' THEN {R2.format('b')} || unit END) AS "limit", max(CASE WHEN bound_key LIKE 'goal%' THEN {R2.format('b')} || unit END) AS goal,
  max(CASE WHEN bound_key LIKE 'limit%' THEN b END) AS limit_value, max(CASE WHEN bound_key LIKE 'goal%' THEN b END) AS goal_value FROM o_hot GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10),
o_val AS (
  SELECT q.patient_id, q.criterion_id, v.plan_id, max({V_ANY}) AS raw FROM (SELECT *, CASE WHEN dose_unit = 'perc' THEN dose_value * 60 / 100 ELSE dose_value END AS d FROM o_l WHERE type = 'dose_volume_V') q
    JOIN o_v v USING (structure, patient_id) GROUP BY 1, 2, 3
  UNION ALL SELECT q.patient_id, q.criterion_id, k.plan_id, {D_SQL.replace('s.frac', 'q.frac')} FROM (SELECT *, CASE WHEN volume_unit = 'cc' THEN vv / volume_cc * 100 ELSE vv END AS v FROM o_l WHERE type = 'dose_volume_D') q
    CROSS JOIN (SELECT DISTINCT plan_id FROM v_fluence) k LEFT JOIN o_seg g ON g.structure = q.structure AND g.patient_id = q.patient_id AND g.plan_id = k.plan_id AND 100 * g.y >= q.v AND 100 * g.y2 < q.v
  UNION ALL SELECT q.patient_id, q.criterion_id, m.plan_id, CASE WHEN q.type = 'max_dose' THEN m.mx ELSE m.mean END FROM o_l q JOIN o_mm m USING (structure, patient_id) WHERE q.type IN ('max_dose', 'mean_dose')),
o_shown AS (SELECT l.*, v.plan_id, {R2.format("CASE WHEN type = 'dose_volume_V' AND coalesce(l.limit, l.goal) LIKE '%cc' THEN raw * volume_cc / 100 WHEN type <> 'dose_volume_V' AND ends_with(coalesce(l.limit, l.goal), '%') THEN raw / 60 * 100 ELSE raw END")} AS shown,
  CASE type WHEN 'max_dose' THEN 'Max Dose' WHEN 'mean_dose' THEN 'Mean Dose' WHEN 'dose_volume_V' THEN 'V(' || {R2.format('dose_value')} || CASE WHEN dose_unit = 'perc' THEN '%' ELSE 'Gy' END || ')'
   ELSE 'D(' || {R2.format('vv')} || CASE WHEN volume_unit = 'cc' THEN 'cc' ELSE '%' END || ')' END AS "constraint" FROM o_l l JOIN o_val v USING (patient_id, criterion_id)),
o_report AS (SELECT patient_id, criterion_id, "constraint", structure, "limit", goal, limit_value, goal_value, max(CASE WHEN plan_id = 'A' THEN shown END) AS A, max(CASE WHEN plan_id = 'B' THEN shown END) AS B
  FROM o_shown GROUP BY ALL)"""


def report(t):
    return cr.criteria_report(protocol(t), t.structure_dose, t.structure, RX, ["A", "B"])


@query("criteria_report", REPORT_SQL + """ SELECT patient_id, criterion_id, "constraint", structure, "limit", goal, A, B FROM o_report""")
def criteria_report(t):
    return report(t).select("patient_id", "criterion_id", "constraint", "structure", "limit", "goal", "A", "B")


@query("criteria_status", REPORT_SQL + """, o_long AS (SELECT *, 'A' AS plan_id, A AS value FROM o_report UNION ALL SELECT *, 'B', B FROM o_report)
SELECT patient_id, criterion_id, plan_id, value, CASE WHEN limit_value IS NOT NULL AND goal_value IS NOT NULL AND limit_value < goal_value THEN CASE WHEN value < limit_value THEN 'red' WHEN value < goal_value THEN 'orange' ELSE 'green' END
 WHEN limit_value IS NOT NULL AND goal_value IS NOT NULL THEN CASE WHEN value <= goal_value THEN 'green' WHEN value <= limit_value THEN 'orange' ELSE 'red' END
 WHEN goal_value IS NOT NULL THEN CASE WHEN value <= goal_value THEN 'green' ELSE 'orange' END ELSE CASE WHEN value <= limit_value THEN 'green' ELSE 'red' END END AS status FROM o_long""")
def criteria_status(t):
    return cr.criteria_status(report(t), ["A", "B"]).select("patient_id", "criterion_id", "plan_id", "value", "status")


ITEMS = [
    (0, "LUNG_L", "VolumeAtDose", 20.0, "Gy", "%", [(37.0, 0.0), (20.0, 8.0), (0.0, 10.0)]),
    (1, "ptv", "DoseAtVolume", 95.0, "%", "Gy", [(0.0, 0.0), (57.0, 5.0), (60.0, 10.0)]),
    (2, "SpinalCord", "DoseAtVolume", 300.0, "CC", "Gy", [(20.0, 6.0), (50.0, 0.0)]),
    (3, "HEART", "MeanDose", 0.0, None, "Gy", [(5.0, 5.0), (20.0, 2.5), (30.0, 0.0)]),
    (4, "GTV", "DoseAtSubVolume", 50.0, "CC", "%", [(50.0, 10.0), (110.0, 0.0)]),
    (5, "PTV", "ConformationNumber", 30.0, "Gy", None, [(0.0, 0.0), (0.5, 4.0), (1.0, 12.0)]),
    (6, "LIVER", "MeanDose", 0.0, None, "Gy", [(5.0, 5.0), (20.0, 0.0)]),
    (7, "CORD", "GradientIndex", 0.0, None, "Gy", [(5.0, 5.0), (20.0, 0.0)]),
    (8, "CORD", "DoseAtVolume", 1.0, "ml", "Gy", [(5.0, 5.0), (20.0, 0.0)]),
]
ITEM_SCHEMA = "item_id long, requested string, metric string, input_value double, input_unit string, output_unit string, points array<struct<x: double, score: double>>"


def score_items(t):
    """Card items per patient with resolved structure names."""
    asked = fan_out(t.voxel.select("patient_id").distinct(), ITEM_SCHEMA, ITEMS)
    names = st.resolve_names(asked, t.structure, {"SPINALCORD": "CORD"})
    return names.withColumnRenamed("actual", "structure")


ITEM_SQL = "o_it(item_id, requested, structure, metric, input_value, input_unit, output_unit) AS (VALUES " + ", ".join(
    f"({i}::bigint, '{n}', {literal({'LIVER': None, 'SpinalCord': 'CORD'}.get(n, n.upper()))}, '{m}', {v}::double, {literal(u)}, {literal(o)})" for i, n, m, v, u, o, _ in ITEMS
) + "), o_pts(item_id, px, score) AS (VALUES " + ", ".join(f"({it[0]}::bigint, {x}::double, {s}::double)" for it in ITEMS for x, s in it[6]) + ")"
SCORE_SQL = f"""{ITEM_SQL}, {CURVES},
o_item AS (SELECT p.patient_id, k.plan_id, i.*, s.volume_cc, s.frac FROM (SELECT DISTINCT patient_id FROM v_voxel) p CROSS JOIN (SELECT DISTINCT plan_id FROM v_fluence) k CROSS JOIN o_it i
  LEFT JOIN o_struct s ON s.patient_id = p.patient_id AND s.structure = i.structure),
o_cn AS (SELECT d.patient_id, d.plan_id, count(*) FILTER (WHERE dose_gy >= 30) AS v_ri, count(m.voxel_id) AS tv, count(m.voxel_id) FILTER (WHERE dose_gy >= 30) AS tv_ri
  FROM o_dose d LEFT JOIN (SELECT patient_id AS pid, voxel_id FROM v_structure_voxel WHERE structure = 'PTV') m ON m.pid = d.patient_id AND m.voxel_id = d.voxel_id GROUP BY 1, 2),
o_metric AS (
  SELECT q.patient_id, q.plan_id, q.item_id, max({V_ANY}) AS raw FROM (SELECT *, input_value AS d FROM o_item WHERE metric = 'VolumeAtDose') q JOIN o_v v ON v.structure = q.structure AND v.patient_id = q.patient_id AND v.plan_id = q.plan_id GROUP BY 1, 2, 3
  UNION ALL SELECT q.patient_id, q.plan_id, q.item_id, ({D_SQL.replace('s.frac', 'q.frac')}) * CASE WHEN metric = 'DoseAtSubVolume' THEN 100.0::double / 60 ELSE 1 END
    FROM (SELECT *, CASE WHEN input_unit = 'CC' THEN 100.0::double * input_value / volume_cc ELSE input_value END AS v FROM o_item WHERE metric = 'DoseAtSubVolume' OR (metric = 'DoseAtVolume' AND input_unit <> 'ml')) q
    LEFT JOIN o_seg g ON g.structure = q.structure AND g.patient_id = q.patient_id AND g.plan_id = q.plan_id AND 100 * g.y >= q.v AND 100 * g.y2 < q.v
  UNION ALL SELECT q.patient_id, q.plan_id, q.item_id, m.mean FROM o_item q JOIN o_mm m ON m.structure = q.structure AND m.patient_id = q.patient_id AND m.plan_id = q.plan_id WHERE q.metric = 'MeanDose'
  UNION ALL SELECT q.patient_id, q.plan_id, q.item_id, cast(tv_ri * tv_ri as double) / nullif(tv * v_ri, 0) FROM o_item q JOIN o_cn c USING (patient_id, plan_id) WHERE q.metric = 'ConformationNumber'),
o_scored AS (SELECT i.patient_id, i.plan_id, i.item_id, i.requested, i.metric, m.raw AS metric_value,
  CASE WHEN i.structure IS NULL THEN 'missing_structure' WHEN metric = 'GradientIndex' THEN 'unsupported_metric:GradientIndex' WHEN input_unit = 'ml' THEN 'metric_error' ELSE 'ok' END AS status,
  (SELECT CASE WHEN m.raw IS NULL THEN NULL WHEN max(px) FILTER (WHERE px <= m.raw) IS NULL THEN arg_min(score, px) WHEN min(px) FILTER (WHERE px > m.raw) IS NULL THEN arg_max(score, px)
    ELSE (arg_max(score, px) FILTER (WHERE px <= m.raw)) + (m.raw - max(px) FILTER (WHERE px <= m.raw)) * ((arg_min(score, px) FILTER (WHERE px > m.raw)) - (arg_max(score, px) FILTER (WHERE px <= m.raw)))
      / ((min(px) FILTER (WHERE px > m.raw)) - (max(px) FILTER (WHERE px <= m.raw))) END FROM o_pts p WHERE p.item_id = i.item_id) AS score
  FROM o_item i LEFT JOIN o_metric m USING (patient_id, plan_id, item_id))"""


def scored(t):
    return cr.score_metrics(score_items(t), t.structure_dose, t.dose, t.structure_voxel, t.structure, RX, ["A", "B"])


@query("score_metric", f"{SCORE_SQL} SELECT patient_id, plan_id, item_id, requested, metric, {S6.format('metric_value')} AS metric_value, status FROM o_scored")
def score_metric(t):
    return scored(t).select("patient_id", "plan_id", "item_id", "requested", "metric", snap(F.col("metric_value")).alias("metric_value"), "status")


@query("score_interpolate", f"{SCORE_SQL} SELECT patient_id, plan_id, item_id, {S6.format('score')} AS score FROM o_scored")
def score_interpolate(t):
    return scored(t).select("patient_id", "plan_id", "item_id", snap(F.col("score")).alias("score"))


@query("total_quality_score", f"{SCORE_SQL} SELECT patient_id, plan_id, {S6.format('coalesce(sum(score), 0)')} AS total_score FROM o_scored GROUP BY 1, 2")
def total_quality_score(t):
    return cr.total_score(scored(t)).withColumn("total_score", snap(F.col("total_score")))


@query("score_rescale", f"""{ITEM_SQL} SELECT v.patient_id, i.item_id, {S6.format("CASE WHEN i.input_unit = 'Gy' THEN i.input_value * (70.2::double / 60) ELSE i.input_value END")} AS input_value,
 {S6.format("CASE WHEN i.output_unit = 'Gy' THEN p.px * (70.2::double / 60) ELSE p.px END")} AS point_x, p.score FROM (SELECT DISTINCT patient_id FROM v_voxel) v CROSS JOIN o_it i JOIN o_pts p USING (item_id)""")
def score_rescale(t):
    r = cr.rescale_scorecard(score_items(t), RX, 70.2)
    return r.select("patient_id", "item_id", snap(F.col("input_value")).alias("input_value"), F.inline("points")).select(
        "patient_id", "item_id", "input_value", snap(F.col("x")).alias("point_x"), "score"
    )


LIMITS = [("PTV", "max", 66.0), ("CORD", "max", 50.0), ("GTV", "max", 20.0), ("LUNG_L", "max", 64.0), ("BODY", "max", 69.0), ("HEART", "mean", 27.0), ("LIVER", "max", 10.0)]
LIMIT_SQL = "o_lim(structure, kind, limit_gy) AS (VALUES " + ", ".join(f"('{s}', '{k}', {v}::double)" for s, k, v in LIMITS) + ")"
NEAR_SQL = """o_near AS (SELECT b.patient_id, b.voxel_id, min((((b.ix - p.ix) * 0.98::double) * ((b.ix - p.ix) * 0.98::double) + ((b.iy - p.iy) * 0.98::double) * ((b.iy - p.iy) * 0.98::double))
   + ((b.iz - p.iz) * 3.0::double) * ((b.iz - p.iz) * 3.0::double)) AS d2
  FROM v_voxel b LEFT JOIN (SELECT patient_id AS pid, voxel_id AS vid FROM v_structure_voxel WHERE structure = 'PTV') x ON x.pid = b.patient_id AND x.vid = b.voxel_id
  JOIN v_structure_voxel p ON p.patient_id = b.patient_id AND p.structure = 'PTV' WHERE x.vid IS NULL GROUP BY 1, 2)"""
STEP_SQL = "CASE WHEN sqrt(d2) <= 0 THEN 60.0::double WHEN sqrt(d2) <= 1 THEN 55.0::double WHEN sqrt(d2) <= 2 THEN 45.0::double WHEN sqrt(d2) <= 50 THEN 30.0::double END"


def target_distance(t):
    """BODY cells outside the target with their distance to it."""
    outside = t.voxel.join(t.structure_voxel.filter("structure = 'PTV'").select("patient_id", "voxel_id"), ["patient_id", "voxel_id"], "left_anti")
    sites = t.structure_voxel.filter("structure = 'PTV'").select("patient_id", "ix", "iy", "iz", F.col("voxel_id").alias("site_id"))
    found = nearest_site(outside.select("patient_id", "voxel_id", "ix", "iy", "iz"), sites, RES, ["patient_id"])
    return found.withColumn("distance_mm", F.sqrt("dist2"))


@query("constraint_violation", f"""{LIMIT_SQL}, {NEAR_SQL}, o_x AS (
 SELECT d.patient_id, d.plan_id, l.kind, CASE WHEN l.kind = 'max' THEN max(d.dose_gy) - max(l.limit_gy) ELSE sum(d.vol_u * d.dose_gy) / sum(d.vol_u) - max(l.limit_gy) / max(s.frac) END AS e
  FROM o_sd d JOIN o_lim l USING (structure) JOIN o_struct s USING (structure, patient_id) GROUP BY d.patient_id, d.plan_id, l.kind, d.structure
 UNION ALL SELECT d.patient_id, d.plan_id, 'distance', d.dose_gy - {STEP_SQL} FROM o_dose d JOIN o_near n USING (patient_id, voxel_id))
SELECT patient_id, plan_id, kind, {S6.format('greatest(max(e), 0)')} AS worst_excess_gy, greatest(max(e), 0) > 5 AS violated FROM o_x GROUP BY 1, 2, 3""")
def constraint_violation(t):
    from dosefold.operators.objectives import step_lookup

    limits = F.broadcast(rows(t.spark, "structure string, kind string, limit_gy double", LIMITS))
    near = target_distance(t)
    steps = step_lookup(F.col("distance_mm"), [(0.0, 60.0), (1.0, 55.0), (2.0, 45.0), (50.0, 30.0)])
    far = near.select("patient_id", "voxel_id", steps.alias("limit_gy")).filter("limit_gy IS NOT NULL")
    r = cr.constraint_violation(t.structure_dose, t.structure, limits, far, t.dose, 5.0)
    return r.withColumn("worst_excess_gy", snap(F.col("worst_excess_gy")))


@query("max_dose_vector", f"""{LIMIT_SQL} SELECT o.patient_id, o.voxel_id, {S6.format('min(l.limit_gy) / 30')} AS limit_per_fraction_gy FROM o_ov o JOIN o_lim l USING (structure)
WHERE l.kind = 'max' AND structure NOT IN ('GTV', 'CTV') GROUP BY 1, 2""")
def max_dose_vector(t):
    limits = F.broadcast(rows(t.spark, "structure string, kind string, limit_gy double", LIMITS))
    r = cr.max_dose_vector(t.opt_voxel, limits, 30)
    return r.withColumn("limit_per_fraction_gy", snap(F.col("limit_per_fraction_gy")))


@query("definition_dedup", """SELECT min(s_suppkey)::bigint AS position, s_nationkey % 4 AS structure_no, s_suppkey % 3 AS weight FROM supplier GROUP BY 2, 3""")
def definition_dedup(t):
    d = t.table("supplier").select(F.col("s_suppkey").cast("long").alias("position"), (F.col("s_nationkey") % 4).alias("structure_no"), (F.col("s_suppkey") % 3).alias("weight"))
    return cr.definition_dedup(d, ["structure_no", "weight"], "position")


@query("prescription", "SELECT s_suppkey::bigint AS protocol_id, (s_nationkey % 5 + 1) * 0.5::double * (s_suppkey % 30 + 1) AS prescription_gy FROM supplier")
def prescription(t):
    p = t.table("supplier").select(F.col("s_suppkey").cast("long").alias("protocol_id"), ((F.col("s_nationkey") % 5 + 1) * F.lit(0.5)).alias("pres_per_fraction_gy"), (F.col("s_suppkey") % 30 + 1).alias("num_of_fractions"))
    return cr.prescription(p).select("protocol_id", "prescription_gy")
