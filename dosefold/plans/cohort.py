"""Cohort queries over patients derived from nations and beams derived from suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import cohort as co
from dosefold.plans.evaluation import S6
from dosefold.plans.registry import query

NAME_SQL = """CASE WHEN {k} % 3 = 0 THEN 'Lung_Patient_' || {k} WHEN {k} % 3 = 1 THEN 'Prostate_Patient_' || {k} ELSE 'Phantom_' || {k} END"""
P_SQL = f"o_p AS (SELECT cast(n_nationkey as bigint) AS patient_id, {NAME_SQL.format(k='n_nationkey')} AS name FROM nation)"


def patients(t):
    k = F.col("n_nationkey")
    text = k.cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Lung_Patient_"), text)).when(
        k % 3 == 1, F.concat(F.lit("Prostate_Patient_"), text)
    ).otherwise(F.concat(F.lit("Phantom_"), text))
    return t.table("nation").select(k.cast("long").alias("patient_id"), name.alias("name"))


def structures(t):
    """Structure metadata with a list position per name."""
    order = ["BODY", "CORD", "GTV", "PTV", "HEART", "LUNG_L", "LUNG_R", "BOX"]
    position = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("structure"))
    return t.structure.select("patient_id", "structure", "volume_cc", position.alias("position"))


def planner(t):
    return t.beam.filter("is_planner").select("patient_id", "beam_id")


@query("patient_list", f"""{P_SQL} SELECT p.name, split_part(p.name, '_', 1) AS disease_site, {S6.format('max(s.volume_cc)')} AS ptv_vol_cc, count(b.beam_id) AS num_beams
FROM o_p p LEFT JOIN o_struct s ON s.patient_id = p.patient_id AND s.structure = 'PTV' LEFT JOIN v_beam b ON b.patient_id = p.patient_id
WHERE p.name LIKE '%Patient%' GROUP BY 1, 2""")
def patient_list(t):
    return co.patient_list(patients(t), t.structure, t.beam).withColumn("ptv_vol_cc", snap(F.col("ptv_vol_cc")))


@query("beam_inventory", """SELECT patient_id, beam_id, gantry_angle, collimator_angle, couch_angle, energy_mv, iso_x_mm,
CASE WHEN beam_id % 3 <> 0 AND beam_id % 4 <> 0 THEN 'Both' WHEN beam_id % 4 <> 0 THEN 'Only Sparse' WHEN beam_id % 3 <> 0 THEN 'Only Full' END AS matrix FROM v_beam""")
def beam_inventory(t):
    b = t.beam.withColumn("full_file", F.when(F.col("beam_id") % 3 != 0, F.lit("Beam_Data.h5/influence_full"))).withColumn(
        "sparse_file", F.when(F.col("beam_id") % 4 != 0, F.lit("Beam_Data.h5/influence_sparse")))
    return co.beam_inventory(b)


@query("structure_inventory", f"SELECT patient_id, structure, {S6.format('volume_cc')} AS volume_cc FROM o_struct")
def structure_inventory(t):
    return t.structure.select("patient_id", "structure", snap(F.col("volume_cc")).alias("volume_cc"))


@query("cohort_filter", f"""{P_SQL} SELECT p.patient_id, p.name, {S6.format('s.volume_cc')} AS ptv_vol_cc, b.n AS num_matching_beams
FROM o_p p JOIN o_struct s ON s.patient_id = p.patient_id AND s.structure = 'PTV'
JOIN (SELECT patient_id, count(*) AS n FROM v_beam WHERE gantry_angle IN (0, 45, 90, 135, 180, 225, 270, 315, 350) AND collimator_angle IN (0, 90, 270) GROUP BY 1) b ON b.patient_id = p.patient_id
WHERE lower(split_part(p.name, '_', 1)) LIKE '%lung%' AND s.volume_cc >= 100.0
ORDER BY p.patient_id LIMIT 3""")
def cohort_filter(t):
    r = co.cohort_filter(
        patients(t), structures(t), t.beam, site="LUNG", min_ptv_cc=100.0, max_patients=3,
        gantry=[0, 45, 90, 135, 180, 225, 270, 315, 350], collimator=[0, 90, 270],
    )
    return r.withColumn("ptv_vol_cc", snap(F.col("ptv_vol_cc")))


B_COLS = "patient_id, beam_id, gantry_angle, collimator_angle, couch_angle, energy_mv, iso_x_mm"
B_LIST = B_COLS.split(", ")


@query("beam_filter", f"SELECT {B_COLS} FROM v_beam WHERE gantry_angle IN (0, 30, 60, 90, 120, 180, 270) AND collimator_angle IN (0, 90) AND energy_mv IN ('6')")
def beam_filter(t):
    return co.beam_filter(t.beam, gantry=[0, 30, 60, 90, 120, 180, 270], collimator=[0, 90], couch=[], energies=["6"]).select(*B_LIST)


@query("beam_filter_explicit", "SELECT patient_id, cast(beam_id as varchar) AS beam_id FROM v_beam WHERE beam_id IN (1, 5, 9, 10)")
def beam_filter_explicit(t):
    return co.beam_filter(t.beam, gantry=[999], beam_ids=[1, 5, 9, 10]).select("patient_id", "beam_id")


@query("planner_beam_semi", f"SELECT {B_COLS} FROM v_beam WHERE is_planner")
def planner_beam_semi(t):
    return co.planner_beams(t.beam, planner(t)).select(*B_LIST)


@query("planner_beam_plan_path", f"SELECT {B_COLS} FROM v_beam b WHERE is_planner OR NOT EXISTS (SELECT 1 FROM v_beam p WHERE p.patient_id = b.patient_id AND p.is_planner)")
def planner_beam_plan_path(t):
    return co.planner_beams(t.beam, planner(t), all_if_none=True).select(*B_LIST)


@query("iso_match", f"""o_b AS (SELECT {B_COLS}, is_planner, floor(iso_x_mm / 200) AS iso_cell FROM v_beam)
SELECT patient_id, beam_id, iso_cell FROM o_b b WHERE EXISTS (SELECT 1 FROM o_b p WHERE p.patient_id = b.patient_id AND p.is_planner AND p.iso_cell = b.iso_cell)
 OR NOT EXISTS (SELECT 1 FROM o_b p WHERE p.patient_id = b.patient_id AND p.is_planner)""")
def iso_match(t):
    cells = t.beam.withColumn("iso_cell", F.floor(F.col("iso_x_mm") / 200).cast("double"))
    return co.iso_match(cells, planner(t), ["iso_cell"]).select("patient_id", "beam_id", "iso_cell")


@query("beam_dedup", """SELECT patient_id, beam_id, gantry_angle FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, collimator_angle, couch_angle, energy_mv,
 round_even(iso_x_mm / 200, 0) ORDER BY beam_id) AS k FROM v_beam) WHERE k = 1""")
def beam_dedup(t):
    coarse = t.beam.withColumn("iso_mm", F.bround(F.col("iso_x_mm") / 200, 0))
    return co.beam_dedup(coarse, ["patient_id", "collimator_angle", "couch_angle", "energy_mv"], ["iso_mm"]).select(
        "patient_id", "beam_id", "gantry_angle"
    )


MANIFEST_SQL = f"""{P_SQL}, o_files AS (SELECT name, 'data/' || name || '/' || f AS path FROM o_p CROSS JOIN
 (VALUES ('CT_Data.h5'), ('CT_MetaData.json'), ('StructureSet_Data.h5'), ('StructureSet_MetaData.json'), ('OptimizationVoxels_Data.h5'), ('OptimizationVoxels_MetaData.json'), ('PlannerBeams.json'), ('DicomFiles/**')) x(f)
UNION ALL SELECT p.name, 'data/' || p.name || '/Beams/Beam_' || b.beam_id || q.s FROM v_beam b JOIN o_p p USING (patient_id) CROSS JOIN (VALUES ('_Data.h5'), ('_MetaData.json')) q(s) WHERE b.is_planner)"""


@query("download_manifest", f"{MANIFEST_SQL} SELECT name, path FROM o_files")
def download_manifest(t):
    return co.download_manifest(patients(t), planner(t))


@query("download_missing", f"""{MANIFEST_SQL} SELECT f.name, f.path FROM o_files f WHERE f.path NOT IN
 (SELECT 'data/' || p.name || '/Beams/Beam_' || b.beam_id || '_Data.h5' FROM v_beam b JOIN o_p p USING (patient_id))""")
def download_missing(t):
    on_disk = t.beam.join(patients(t), "patient_id").select(
        F.concat(F.lit("data/"), F.col("name"), F.lit("/Beams/Beam_"), F.col("beam_id").cast("string"), F.lit("_Data.h5")).alias("path")
    )
    return co.missing_files(co.download_manifest(patients(t), planner(t)), on_disk).select("name", "path")


@query("size_tier", """o_v AS (SELECT n_nationkey::bigint AS patient_id, max(s.volume_cc) AS v FROM nation LEFT JOIN o_struct s ON s.patient_id = n_nationkey AND s.structure = 'PTV' GROUP BY 1)
SELECT patient_id, CASE WHEN v >= 0 AND v < 40 THEN 'small' WHEN v >= 40 AND v < 3900 THEN 'large' WHEN v >= 3900 AND v < 4200 THEN 'x_large' ELSE 'medium' END AS tier FROM o_v""")
def size_tier(t):
    volume = t.structure.filter("structure = 'PTV'").select("patient_id", F.col("volume_cc").alias("ptv_volume_cc"))
    r = co.size_tier(patients(t).join(volume, "patient_id", "left"), [("small", 0, 40), ("large", 40, 3900), ("x_large", 3900, 4200)])
    return r.select("patient_id", "tier")


@query("beam_attribute_lookup", "SELECT q.p::bigint AS position, b.patient_id, b.beam_id, b.gantry_angle, b.collimator_angle FROM (VALUES (0, 7), (1, 3), (2, 7), (3, 1)) q(p, id) JOIN v_beam b ON b.beam_id = q.id")
def beam_attribute_lookup(t):
    return co.beam_attributes(t.beam, [7, 3, 7, 1], ["gantry_angle", "collimator_angle"])


@query("spaced_angle_sample", """SELECT patient_id, beam_id, gantry_angle FROM v_beam WHERE (gantry_angle - (patient_id * 7 + 42) % 12 * 5) % 60 = 0""")
def spaced_angle_sample(t):
    return co.spaced_angles(patients(t), t.beam).select("patient_id", "beam_id", "gantry_angle")
