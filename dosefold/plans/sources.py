"""Source and sink queries: files are derived from the given tables by Spark, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.operators import matrix as im
from dosefold.operators import structures as st
from dosefold.plans.cohort import NAME_SQL, P_SQL, patients
from dosefold.plans.registry import query
from dosefold.session import scratch_folder
from dosefold.sources import metadata as io


@query("metadata_scan", f"""{P_SQL} SELECT p.name AS patient_id, b.beam_id, b.gantry_angle::double AS gantry_angle, b.collimator_angle::double AS collimator_angle,
b.energy_mv, b.iso_x_mm FROM v_beam b JOIN o_p p USING (patient_id)""")
def metadata_scan(t):
    folder = scratch_folder(t.spark, "metadata")
    t.beam.join(patients(t), "patient_id").select(
        F.col("name").alias("folder"), F.col("beam_id").alias("ID"), "gantry_angle", "collimator_angle", "couch_angle",
        F.struct(F.col("iso_x_mm").alias("x_mm"), F.lit(0.0).alias("y_mm"), F.lit(0.0).alias("z_mm")).alias("iso_center"),
        F.col("energy_mv").alias("energy_MV"),
    ).write.partitionBy("folder").json(folder)
    scanned = io.scan_metadata(t.spark, folder, io.BEAM_SCHEMA, r"folder=([^/]+)/", multi_line=False)
    return scanned.select("patient_id", F.col("ID").alias("beam_id"), "gantry_angle", "collimator_angle",
                          F.col("energy_MV").alias("energy_mv"), F.col("iso_center.x_mm").alias("iso_x_mm"))


@query("manifest_scan", f"""SELECT {NAME_SQL.format(k='s_suppkey')} AS patient_id, split_part({NAME_SQL.format(k='s_suppkey')}, '_', 1) AS disease_site,
 CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE (s_suppkey % 4)::bigint END AS num_beams FROM supplier WHERE s_suppkey % 7 <> 0""")
def manifest_scan(t):
    folder = scratch_folder(t.spark, "manifest")
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Lung_Patient_"), text)).when(
        k % 3 == 1, F.concat(F.lit("Prostate_Patient_"), text)).otherwise(F.concat(F.lit("Phantom_"), text))
    paths = F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < k % 4, F.concat(F.lit("Beam_"), i.cast("string")))), lambda x: x.isNotNull())
    line = F.concat(
        F.lit('{"patient_id": '), F.when(k % 7 == 0, "null").otherwise(F.concat(F.lit('"'), name, F.lit('"'))),
        F.lit(', "beam_metadata_paths": '), F.when(k % 5 == 0, '"unknown"').otherwise(F.to_json(paths)), F.lit("}"),
    )
    t.table("supplier").select(line.alias("value")).write.text(folder)
    return io.scan_manifest(t.spark, folder)


@query("protocol_scan", """o_c AS (SELECT 'P' || s_suppkey AS protocol_name, * FROM supplier CROSS JOIN
 (VALUES (0, 'max_dose', 'PTV', 'limit_dose_gy', '66'), (0, 'max_dose', 'PTV', 'goal_dose_gy', '1.1*prescription_gy'), (1, 'mean_dose', 'HEART', 'limit_dose_perc', NULL)) q(criterion_id, type, structure, bound_key, v))
SELECT protocol_name, 2.0::double AS pres_per_fraction_gy, (s_nationkey + 20)::bigint AS num_of_fractions, criterion_id::bigint AS criterion_id, type, structure, bound_key,
 coalesce(v, (s_nationkey + 10)::varchar) AS bound_value FROM o_c""")
def protocol_scan(t):
    folder = scratch_folder(t.spark, "protocol")
    k = F.col("s_nationkey")
    line = F.concat(
        F.lit('{"disease_site": "Lung", "protocol_name": "P'), F.col("s_suppkey").cast("string"),
        F.lit('", "pres_per_fraction_gy": 2, "num_of_fractions": '), (k + 20).cast("string"),
        F.lit(', "criteria": [{"type": "max_dose", "parameters": {"structure_name": "PTV"}, "constraints": {"limit_dose_gy": 66, '
              '"goal_dose_gy": "1.1*prescription_gy"}}, {"type": "mean_dose", "parameters": {"structure_name": "HEART"}, "constraints": {"limit_dose_perc": '),
        (k + 10).cast("string"), F.lit("}}]}"),
    )
    t.table("supplier").select(line.alias("value")).write.text(folder)
    return io.scan_protocols(t.spark, folder, multi_line=False).drop("parameters")


@query("table_load", """SELECT i.patient_id, b.beam_id, i.voxel_id, i.beamlet_id, i.a_int::double AS a FROM v_influence i JOIN v_beamlet b USING (beamlet_id)
WHERE b.beam_id IN (0, 3, 5) AND i.a_int > 10""")
def table_load(t):
    folder = scratch_folder(t.spark, "matrix")
    full = t.influence.join(t.beamlet.select("beamlet_id", "beam_id"), "beamlet_id")
    variants = F.array_compact(F.array(F.lit("full"), F.when(F.col("a") > 10, "sparse")))
    io.save_matrix(full.withColumn("variant", F.explode(variants)), folder)
    r = io.load_matrix(t.spark, folder, full=False, beam_ids=[0, 3, 5])
    return r.select(F.col("patient_id").cast("long").alias("patient_id"), F.col("beam_id").cast("long").alias("beam_id"), "voxel_id", "beamlet_id", "a")


@query("source_id_lookup", f"""SELECT q.name, c.subject_id, CASE WHEN c.subject_id IS NULL THEN 'Invalid patient id' ELSE 'ok' END AS status
FROM (SELECT {NAME_SQL.format(k='s_suppkey')} AS name FROM supplier) q LEFT JOIN (SELECT {NAME_SQL.format(k='n_nationkey')} AS name, n_name AS subject_id FROM nation) c USING (name)""")
def source_id_lookup(t):
    k, text = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("Lung_Patient_"), text)).when(
        k % 3 == 1, F.concat(F.lit("Prostate_Patient_"), text)).otherwise(F.concat(F.lit("Phantom_"), text))
    known = t.table("nation").select(F.col("n_nationkey").cast("long").alias("patient_id"), F.col("n_name").alias("subject_id"))
    sources = known.join(patients(t), "patient_id").select("name", "subject_id")
    return io.lookup_source_ids(t.table("supplier").select(name.alias("name")), sources)


@query("solution_store", "SELECT plan_id, beamlet_id, intensity::double AS intensity FROM v_fluence WHERE plan_id = 'B'")
def solution_store(t):
    folder = scratch_folder(t.spark, "solution")
    io.save_solution(t.fluence, folder)
    return io.load_solution(t.spark, folder, "B").select("plan_id", "beamlet_id", "intensity")


@query("solution_store_patients", "SELECT DISTINCT i.patient_id, f.plan_id, f.beamlet_id, f.intensity::double AS intensity FROM v_influence i JOIN v_fluence f ON f.beamlet_id = i.beamlet_id WHERE f.plan_id = 'B'")
def solution_store_patients(t):
    folder = scratch_folder(t.spark, "solution")
    own = t.own_beamlet.join(t.fluence, "beamlet_id")
    io.save_solution(own, folder)
    found = io.load_solution(t.spark, folder, "B")
    return found.select(F.col("patient_id").cast("long").alias("patient_id"), "plan_id", "beamlet_id", "intensity")


@query("fluence_export", """
o_m AS (SELECT beam_id, max(row_idx) AS mr, max(col_idx) + 1 AS nx, min(x_mm) AS x0, max(y_mm) AS y0 FROM v_beamlet GROUP BY 1),
o_g AS (SELECT m.beam_id, r.r AS row, c.c AS col, m.mr - r.r AS row_idx FROM o_m m, lateral (SELECT unnest(range(0, m.mr + 1)) AS r) r, lateral (SELECT unnest(range(0, m.nx)) AS c) c),
o_v AS (SELECT g.beam_id, g.row, g.col, coalesce(f.intensity, 0) / 2.0::double AS v FROM o_g g LEFT JOIN v_beamlet b ON b.beam_id = g.beam_id AND b.row_idx = g.row_idx AND b.col_idx = g.col
  LEFT JOIN (SELECT beamlet_id, intensity FROM v_fluence WHERE plan_id = 'A') f ON f.beamlet_id = b.beamlet_id)
SELECT beam_id, 8 + row AS line_no, string_agg(printf('%.6f', v), chr(9) ORDER BY col) AS line FROM o_v GROUP BY 1, 2
UNION ALL SELECT beam_id, q.n::bigint, CASE q.n WHEN 0 THEN 'optimalfluence' WHEN 1 THEN 'SizeX      ' || nx WHEN 2 THEN 'SizeY      ' || (mr + 1) WHEN 3 THEN 'SpacingX   2.5'
  WHEN 4 THEN 'SpacingY   2.5' WHEN 5 THEN 'OriginX    ' || x0 WHEN 6 THEN 'OriginY    ' || y0 ELSE 'Values' END FROM o_m CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) q(n)""")
def fluence_export(t):
    sized = t.beamlet.withColumn("width_mm", F.lit(2.5)).withColumn("height_mm", F.lit(2.5))
    grid = im.fluence_to_grid(t.fluence.filter("plan_id = 'A'"), im.finest_grid(sized))
    return io.fluence_lines(grid, sized, dose_per_fraction_gy=2.0)


PLAN_LINES_SQL = """
o_m AS (SELECT beam_id, max(row_idx) AS mr, max(col_idx) + 1 AS nx, min(x_mm) AS x0, max(y_mm) AS y0 FROM v_beamlet GROUP BY 1), o_pl AS (SELECT DISTINCT plan_id FROM v_fluence),
o_g AS (SELECT p.plan_id, m.beam_id, r.r AS row, c.c AS col, m.mr - r.r AS row_idx FROM o_m m CROSS JOIN o_pl p, lateral (SELECT unnest(range(0, m.mr + 1)) AS r) r, lateral (SELECT unnest(range(0, m.nx)) AS c) c),
o_v AS (SELECT g.plan_id, g.beam_id, g.row, g.col, coalesce(f.intensity, 0) / 2.0::double AS v FROM o_g g LEFT JOIN v_beamlet b ON b.beam_id = g.beam_id AND b.row_idx = g.row_idx AND b.col_idx = g.col
  LEFT JOIN v_fluence f ON f.beamlet_id = b.beamlet_id AND f.plan_id = g.plan_id)
SELECT plan_id, beam_id, 8 + row AS line_no, string_agg(printf('%.6f', v), chr(9) ORDER BY col) AS line FROM o_v GROUP BY 1, 2, 3
UNION ALL SELECT plan_id, beam_id, q.n::bigint, CASE q.n WHEN 0 THEN 'optimalfluence' WHEN 1 THEN 'SizeX      ' || nx WHEN 2 THEN 'SizeY      ' || (mr + 1) WHEN 3 THEN 'SpacingX   2.5'
  WHEN 4 THEN 'SpacingY   2.5' WHEN 5 THEN 'OriginX    ' || x0 WHEN 6 THEN 'OriginY    ' || y0 ELSE 'Values' END FROM o_m CROSS JOIN o_pl CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) q(n)"""


@query("fluence_export_plans", PLAN_LINES_SQL)
def fluence_export_plans(t):
    return plan_lines(t)


def plan_lines(t):
    """Fluence lines of every plan on the beamlets it has an intensity for."""
    sized = t.fluence.select("plan_id", "beamlet_id").join(t.beamlet, "beamlet_id").withColumn("width_mm", F.lit(2.5)).withColumn("height_mm", F.lit(2.5))
    keys = ["plan_id", "beam_id"]
    grid = im.fluence_to_grid(t.fluence, im.finest_grid(sized.select("beam_id", "beamlet_id", "x_mm", "y_mm", "width_mm", "height_mm", "plan_id"), keys))
    return io.fluence_lines(grid, sized, dose_per_fraction_gy=2.0, beam=keys)


@query("fluence_files", PLAN_LINES_SQL)
def fluence_files(t):
    """The files of every plan and beam, written and read back."""
    folder = scratch_folder(t.spark, "fluence")
    io.write_fluence(plan_lines(t), folder)
    read = io.read_fluence(t.spark, folder)
    return read.select("plan_id", F.col("beam_id").cast("long").alias("beam_id"), "line_no", "line")


@query("label_volume_export", """
o_l(structure, label) AS (VALUES ('CORD', 1), ('HEART', 2), ('LUNG_L', 3)),
o_lab AS (SELECT s.patient_id, s.ix, s.iy, s.iz, max(coalesce(l.label, 0)) AS label, max(CASE WHEN s.structure = 'PTV' THEN 1 ELSE 0 END) AS target
  FROM v_structure_voxel s LEFT JOIN o_l l USING (structure) GROUP BY 1, 2, 3, 4),
o_all AS (SELECT patient_id, ix, iy, iz, string_agg(DISTINCT structure, ',' ORDER BY structure) AS structures FROM v_structure_voxel GROUP BY 1, 2, 3, 4)
SELECT v.patient_id, d.plan_id, v.ix, v.iy, v.iz, v.hu, d.dose_gy, l.label::bigint AS label, l.target::bigint AS target, s.structures FROM v_voxel v JOIN o_lab l USING (patient_id, ix, iy, iz)
JOIN o_all s USING (patient_id, ix, iy, iz) JOIN o_dose d ON d.patient_id = v.patient_id AND d.voxel_id = v.voxel_id""")
def label_volume_export(t):
    labels = st.label_map(t.structure_voxel, [("CORD", 1), ("HEART", 2), ("LUNG_L", 3)])
    folder = scratch_folder(t.spark, "volume")
    io.label_volume(t.voxel, t.dose, labels, t.structure_voxel).hint("rebalance", "patient_id").write.partitionBy("patient_id").parquet(folder)
    read = t.spark.read.parquet(folder).withColumn("patient_id", F.col("patient_id").cast("long"))
    return read.withColumn("structures", F.array_join("structures", ","))


@query("ct_header_scan", """SELECT s_suppkey AS patient_id, s_suppkey * 1.5::double AS origin_x, -2.0::double AS origin_y, 0.98::double AS spacing_x, 2.0::double + s_nationkey % 3 AS spacing_z, (100 + s_nationkey)::integer AS size_z FROM supplier""")
def ct_header_scan(t):
    """Headers written as one file per row's folder, read back as the header table."""
    folder, k = scratch_folder(t.spark, "ct"), F.col("s_suppkey")
    t.table("supplier").select(
        k.alias("folder"), F.array(k * 1.5, F.lit(-2.0), F.lit(0.0)).alias("origin_xyz_mm"),
        F.array(F.lit(0.98), F.lit(0.98), 2.0 + F.col("s_nationkey") % 3).alias("resolution_xyz_mm"),
        F.array(F.lit(512), F.lit(512), F.col("s_nationkey").cast("int") + 100).alias("size_xyz_mm"),
    ).repartition(8, "folder").write.partitionBy("folder").json(folder)
    found = io.ct_headers(io.scan_metadata(t.spark, folder, io.CT_SCHEMA, r"folder=([^/]+)/", multi_line=False))
    return found.select(F.col("patient_id").cast("long").alias("patient_id"), F.col("origin.x").alias("origin_x"), F.col("origin.y").alias("origin_y"),
                        F.col("spacing.x").alias("spacing_x"), F.col("spacing.z").alias("spacing_z"), F.col("size.z").alias("size_z"))


@query("arc_scan", """SELECT b.patient_id, a.n::varchar AS arc_id, count(*) AS points, min(b.beam_id) AS first_beam, max(b.beam_id) AS last_beam FROM v_beam b JOIN (SELECT unnest([0, 1]) AS n) a ON b.beam_id % 2 = a.n GROUP BY 1, 2""")
def arc_scan(t):
    """Arcs of each patient's beams, written as JSON and read back."""
    folder = scratch_folder(t.spark, "arcs")
    arc = t.beam.groupBy("patient_id", (F.col("beam_id") % 2).cast("string").alias("arc_id")).agg(F.sort_array(F.collect_list("beam_id")).alias("control_point_ids"))
    arc.groupBy(F.col("patient_id").alias("folder")).agg(F.collect_list(F.struct("arc_id", "control_point_ids")).alias("arcs")).write.partitionBy("folder").json(folder)
    found = io.arc_rows(io.scan_metadata(t.spark, folder, io.ARC_SCHEMA, r"folder=([^/]+)/", multi_line=False))
    return found.select(F.col("patient_id").cast("long").alias("patient_id"), "arc_id", F.size("beam_ids").cast("long").alias("points"),
                        F.array_min("beam_ids").alias("first_beam"), F.array_max("beam_ids").alias("last_beam"))
