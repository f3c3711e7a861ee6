"""Readers and writers: patient metadata JSON, protocols, tables and exports.

Every reader takes an explicit schema and fails on malformed input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosefold.functions.stored import bucketed
from dosefold.operators.cohort import disease_site
from dosefold.sources.sinks import read_keyed_text, write_keyed_text

POINT = "struct<x_mm: double, y_mm: double, z_mm: double>"
BEAM_SCHEMA = (
    f"ID long, gantry_angle double, collimator_angle double, couch_angle double, iso_center {POINT}, "
    "jaw_position struct<top_left_x_mm: double, top_left_y_mm: double, bottom_right_x_mm: double, bottom_right_y_mm: double>, "
    "MLC_name string, beam_modality string, energy_MV string, SSD_mm double, SAD_mm double, machine_name string, "
    "influenceMatrixSparse_File string, influenceMatrixSparse_tol double, influenceMatrixFull_File string, "
    "beamlets struct<id_File: string, width_mm_File: string, height_mm_File: string, position_x_mm_File: string, position_y_mm_File: string, "
    "MLC_leaf_idx_File: string>, BEV_structure_contour_points_File string, MLC_leaves_pos_y_mm_File string"
)
# fixed field names of the file formats
CT_SCHEMA = "origin_xyz_mm array<double>, resolution_xyz_mm array<double>, size_xyz_mm array<int>, direction array<double>, ct_hu_3d_File string"
VOXEL_SCHEMA = (
    "ct_origin_xyz_mm array<double>, ct_voxel_resolution_xyz_mm array<double>, dose_voxel_resolution_xyz_mm array<double>, "
    "ct_to_dose_voxel_map_File string, voxel_coordinate_XYZ_mm_File string, cal_box_xyz_start array<double>, cal_box_xyz_end array<double>"
)
ARC_SCHEMA = (
    "arcs array<struct<arc_id: string, control_point_ids: array<long>, gantry_start_angle: double, gantry_stop_angle: double, "
    "minimum_dynamic_leaf_gap: double, technique: string, gantry_rotation_direction: string>>"
)
OBJECTIVE = "struct<type: string, structure_name: string, weight: double, dose_gy: string, dose_perc: double, structure_def: string>"
OBJECTIVE_SCHEMA = f"objective_functions array<{OBJECTIVE}>, constraints array<struct<type: string, parameters: map<string, string>, constraints: map<string, string>>>"
SOURCE_ID_SCHEMA = "tcia_patients array<map<string, string>>"
SCORECARD_SCHEMA = (
    "DosePerFraction double, NumberOfFractions long, ScoreTemplates array<struct<Structure: struct<StructureId: string, TemplateStructureId: string>, "
    "MetricType: string, InputValue: double, InputUnit: string, OutputUnit: string, MetricComment: string, "
    "ScorePoints: array<struct<PointX: double, Score: double>>>>"
)
STRUCTURE_SCHEMA = "name string, volume_cc double, fraction_of_vol_in_calc_box double, structure_mask_3d_File string"
PLANNER_SCHEMA = "IDs array<long>"
MANIFEST_SCHEMA = "patient_id string, beam_metadata_paths string"
CRITERION = "struct<type: string, parameters: map<string, string>, constraints: map<string, string>>"
PROTOCOL_SCHEMA = (
    f"disease_site string, protocol_name string, pres_per_fraction_gy double, num_of_fractions long, criteria array<{CRITERION}>"
)
FOLDER = r"/([^/]+)/(?:Beams/)?[^/]+$"


def _json(spark: SparkSession, schema: str, paths, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST").json(paths)


def scan_metadata(spark: SparkSession, paths, schema: str, folder_pattern: str = FOLDER, multi_line: bool = True) -> DataFrame:
    """One row per JSON object with the patient folder and file it came from.

    A file that holds a list of objects gives one row per element.
    """
    path = F.col("_metadata.file_path")
    return _json(spark, schema, paths, multi_line).select(
        F.regexp_extract(path, folder_pattern, 1).alias("patient_id"), F.col("_metadata.file_name").alias("file_name"), "*"
    )


def scan_beams(spark: SparkSession, root: str) -> DataFrame:
    """Beam metadata of all patients under `root`, in natural order of the beam files."""
    beams = scan_metadata(spark, f"{root}/*/Beams/*.json", BEAM_SCHEMA)
    number = F.regexp_extract("file_name", r"(\d+)", 1).cast("long")
    return beams.withColumn("file_number", number).orderBy("patient_id", "file_number")


def scan_structures(spark: SparkSession, root: str) -> DataFrame:
    return scan_metadata(spark, f"{root}/*/StructureSet_MetaData.json", STRUCTURE_SCHEMA)


def scan_planner_beams(spark: SparkSession, root: str) -> DataFrame:
    return scan_metadata(spark, f"{root}/*/PlannerBeams.json", PLANNER_SCHEMA).select(
        "patient_id", F.explode("IDs").alias("beam_id")
    )


def _three(column: str, kind: str = "double"):
    return F.struct(*[F.col(column)[i].cast(kind).alias(a) for i, a in enumerate("xyz")])


def ct_headers(files: DataFrame) -> DataFrame:
    """The header table of functions/headers.py from rows of CT_SCHEMA with a patient_id."""
    return files.select("patient_id", _three("origin_xyz_mm").alias("origin"), _three("resolution_xyz_mm").alias("spacing"), _three("size_xyz_mm", "int").alias("size"))


def scan_ct_headers(spark: SparkSession, root: str) -> DataFrame:
    return ct_headers(scan_metadata(spark, f"{root}/*/CT_MetaData.json", CT_SCHEMA))


def scan_voxel_headers(spark: SparkSession, root: str) -> DataFrame:
    """Origin and both spacings of each patient's dose grid, with the corners of its calculation box (NULL if not given)."""
    found = scan_metadata(spark, f"{root}/*/OptimizationVoxels_MetaData.json", VOXEL_SCHEMA)
    return found.select(
        "patient_id", _three("ct_origin_xyz_mm").alias("origin"), _three("ct_voxel_resolution_xyz_mm").alias("spacing"),
        _three("dose_voxel_resolution_xyz_mm").alias("dose_spacing"),
        *[F.when(F.col(c).isNotNull(), _three(c)).alias(c.removeprefix("cal_box_xyz_") + "_mm") for c in ("cal_box_xyz_start", "cal_box_xyz_end")],
    )


def arc_rows(files: DataFrame) -> DataFrame:
    """Arcs with their control points from rows of ARC_SCHEMA with a patient_id; `beam_ids` fits operators/arcs.py."""
    arcs = files.select("patient_id", F.explode("arcs").alias("arc"))
    return arcs.select(
        "patient_id", "arc.arc_id", F.col("arc.control_point_ids").alias("beam_ids"), "arc.gantry_start_angle", "arc.gantry_stop_angle",
        "arc.minimum_dynamic_leaf_gap", "arc.technique", "arc.gantry_rotation_direction",
    )


def scan_arcs(spark: SparkSession, root: str) -> DataFrame:
    return arc_rows(scan_metadata(spark, f"{root}/*/arcs.json", ARC_SCHEMA))


def scan_objectives(spark: SparkSession, paths) -> DataFrame:
    """Objective functions of each file in their order; a dose may be a number or a formula, as text."""
    files = _json(spark, OBJECTIVE_SCHEMA, paths, True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode("objective_functions").alias("place", "o"))
    return files.select("file_name", F.col("place").cast("long").alias("objective_id"), "o.*").withColumnRenamed("structure_name", "structure")


def scan_source_ids(spark: SparkSession, paths, name_field: str) -> DataFrame:
    """External ids of the listed patients, a row for each field but `name_field`, which names the patient."""
    listed = _json(spark, SOURCE_ID_SCHEMA, paths, True).select(F.explode("tcia_patients").alias("p"))
    return listed.select(F.col("p")[name_field].alias("name"), F.explode("p").alias("field", "value")).filter(F.col("field") != name_field)


def scan_size_tiers(spark: SparkSession, path: str) -> DataFrame:
    """(tier, low, high) of a file with ptv_size_thresholds_cc."""
    files = _json(spark, "ptv_size_thresholds_cc map<string, array<double>>", path, True)
    return files.select(F.explode("ptv_size_thresholds_cc").alias("tier", "ends")).select("tier", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def scan_scorecards(spark: SparkSession, paths) -> DataFrame:
    """A row for each score point of each metric."""
    files = _json(spark, SCORECARD_SCHEMA, paths, True)
    metrics = files.select("DosePerFraction", "NumberOfFractions", F.posexplode("ScoreTemplates").alias("metric_id", "m"))
    points = metrics.select("*", F.posexplode("m.ScorePoints").alias("point_id", "p"))
    return points.select(
        F.col("DosePerFraction").alias("dose_per_fraction_gy"), F.col("NumberOfFractions").alias("fractions"), F.col("metric_id").cast("long").alias("metric_id"),
        F.coalesce("m.Structure.TemplateStructureId", "m.Structure.StructureId").alias("structure"), F.col("m.MetricType").alias("metric_type"),
        F.col("m.InputValue").alias("input_value"), F.col("m.InputUnit").alias("input_unit"), F.col("m.OutputUnit").alias("output_unit"),
        F.col("point_id").cast("long").alias("point_id"), F.col("p.PointX").alias("x"), F.col("p.Score").alias("score"),
    )


def scan_manifest(spark: SparkSession, paths) -> DataFrame:
    """Cohort manifest: JSON lines, rows without an id dropped, beam count NULL unless a list."""
    listed = F.from_json("beam_metadata_paths", "array<string>")
    return (
        _json(spark, MANIFEST_SCHEMA, paths, False)
        .filter(F.coalesce(F.col("patient_id"), F.lit("")) != "")
        .select(
            "patient_id", disease_site(F.col("patient_id")).alias("disease_site"),
            F.when(F.coalesce("beam_metadata_paths", F.lit("[]")).startswith("["),
                   F.size(F.coalesce(listed, F.array().cast("array<string>"))).cast("long")).alias("num_beams"),
        )
    )


def explode_protocol(protocols: DataFrame) -> DataFrame:
    """One row per (criterion, limit or goal key)."""
    criteria = protocols.select(
        "protocol_name", "pres_per_fraction_gy", "num_of_fractions", F.posexplode("criteria").alias("criterion_id", "c")
    )
    return criteria.select(
        "protocol_name", "pres_per_fraction_gy", "num_of_fractions", F.col("criterion_id").cast("long").alias("criterion_id"),
        F.col("c.type").alias("type"), F.col("c.parameters.structure_name").alias("structure"),
        F.explode(F.map_entries("c.constraints")).alias("e"), F.col("c.parameters").alias("parameters"),
    ).select("*", F.col("e.key").alias("bound_key"), F.col("e.value").alias("bound_value")).drop("e")


def scan_protocols(spark: SparkSession, paths, multi_line: bool = True) -> DataFrame:
    return explode_protocol(_json(spark, PROTOCOL_SCHEMA, paths, multi_line))


def lookup_source_ids(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """External ids of each requested patient; unknown ids are reported, not dropped."""
    found = requests.join(sources, "name", "left")
    return found.withColumn("status", F.when(F.col("subject_id").isNull(), "Invalid patient id").otherwise("ok"))


#: Folders of a beam that the patients of a matrix table are dealt to.
PATIENT_GROUPS = 16


def _patient_group(patient):
    return F.pmod(F.xxhash64(patient.cast("string")), F.lit(PATIENT_GROUPS)).cast("int")


def save_matrix(influence: DataFrame, path: str) -> None:
    """Matrix table laid out by variant, beam and group of patients, so a plan reads only its beams.

    A patient's beam lies in one file of each variant, sorted by patient: folders and
    files grow with the rows and the beams' numbers, which patients share, and not with
    the patients. Spark splits a group that is large among many writers (rebalance).
    """
    keys = ["variant", "beam_id", "patient_group"]
    dealt = influence.withColumn("patient_group", _patient_group(F.col("patient_id"))).hint("rebalance", *keys)
    dealt.sortWithinPartitions(*keys, "patient_id").write.partitionBy(*keys).parquet(path)


def save_matrix_by_voxel(influence: DataFrame, path: str, buckets: int | None = None) -> DataFrame:
    """The matrix as a table in buckets by patient and voxel: dose from fluence and gradients of many plans read it without a shuffle of it."""
    return bucketed(influence, path, ["patient_id", "voxel_id"], buckets)


def load_matrix(spark: SparkSession, path: str, full: bool = False, beam_ids: list[int] | None = None, patient_id=None) -> DataFrame:
    """Either the sparse or the full variant, never both; beams and the group of a patient prune folders."""
    df = spark.read.parquet(path).filter(F.col("variant") == ("full" if full else "sparse"))
    if patient_id is not None:
        df = df.filter((F.col("patient_group") == _patient_group(F.lit(patient_id))) & (F.col("patient_id") == patient_id))
    return (df if beam_ids is None else df.filter(F.col("beam_id").isin(beam_ids))).drop("patient_group")


def save_solution(fluence: DataFrame, path: str) -> None:
    """Solutions in a folder per plan; Spark's commit leaves a failed job's rows out.

    A patient's rows lie together in one file of the plan, sorted by patient: the
    files grow with the rows and not with the patients, and a reader of one patient
    skips by the files' statistics.
    """
    if "patient_id" in fluence.columns:
        fluence = fluence.repartition("patient_id", "plan_id").sortWithinPartitions("plan_id", "patient_id")
    else:
        fluence = fluence.repartition("plan_id")
    fluence.write.partitionBy("plan_id").parquet(path)


def load_solution(spark: SparkSession, path: str, plan_id: str | None = None, patient_id=None) -> DataFrame:
    """All solutions, or those of a plan or patient: only the plan's folder and the patient's row groups are read."""
    df = spark.read.parquet(path)
    for column, value in (("plan_id", plan_id), ("patient_id", patient_id)):
        df = df if value is None else df.filter(F.col(column) == value)
    return df


def fluence_lines(
    grid: DataFrame, beamlets: DataFrame, dose_per_fraction_gy: float | None = None, beam: list[str] = ["beam_id"]
) -> DataFrame:
    """Text lines of an optimal-fluence file per beam: header, then tab separated rows with 6 decimals.

    Only one grid row of a beam, at most the field width in cells, is ever gathered.
    """
    scale = 1.0 / dose_per_fraction_gy if dose_per_fraction_gy else 1.0
    size = grid.groupBy(*beam).agg((F.max("col") + 1).alias("nx"), (F.max("row") + 1).alias("ny"))
    corner = beamlets.groupBy(*beam).agg(
        (F.min(F.col("x_mm") - F.col("width_mm") / 2) + 1.25).alias("x0"),
        (F.max(F.col("y_mm") + F.col("height_mm") / 2) - 1.25).alias("y0"),
    )
    texts = [
        F.lit("optimalfluence"), F.concat(F.lit("SizeX      "), F.col("nx").cast("string")),
        F.concat(F.lit("SizeY      "), F.col("ny").cast("string")), F.lit("SpacingX   2.5"), F.lit("SpacingY   2.5"),
        F.concat(F.lit("OriginX    "), F.col("x0").cast("string")),
        F.concat(F.lit("OriginY    "), F.col("y0").cast("string")), F.lit("Values"),
    ]
    head = size.join(corner, beam).select(*beam, F.posexplode(F.array(*texts)).alias("line_no", "line"))
    scaled = F.col("intensity") * scale if scale != 1.0 else F.col("intensity")
    value = F.format_string("%.6f", F.when(scaled < 1e-6, 0.0).otherwise(scaled))
    gathered = grid.withColumn("text", value).groupBy(*beam, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("cells")
    )
    empty = F.lit("0.000000")
    body = size.select(*beam, "nx", F.explode(F.expr("sequence(0L, ny - 1)")).alias("row")).join(
        gathered, [*beam, "row"], "left"
    ).select(
        *beam, (F.col("row") + len(texts)).cast("long").alias("line_no"),
        F.array_join(
            F.transform(F.expr("sequence(0L, nx - 1)"), lambda c: F.coalesce(F.try_element_at("cells", c), empty)), "\t"
        ).alias("line"),
    )
    return head.withColumn("line_no", F.col("line_no").cast("long")).unionByName(body)


FLUENCE_FILE = "optimal_fluence.txt"


def write_fluence(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """A file for each patient, plan and beam (as far as `lines` has them as keys), all of them or none."""
    keys = [c for c in ("patient_id", "plan_id", "beam_id") if c in lines.columns]
    write_keyed_text(lines, keys, path, FLUENCE_FILE, overwrite)


def read_fluence(spark: SparkSession, path: str) -> DataFrame:
    """The lines of `write_fluence`, with their keys and line_no."""
    return read_keyed_text(spark, path, FLUENCE_FILE)


def label_volume(ct: DataFrame, dose: DataFrame, labels: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Dense CT table with dose and organ label, zero where absent.

    With `masks` (a structure table) every cell also lists all structures that hold it, overlaps included.
    A dose with plan_id gives the table of each plan.
    """
    cell = ["patient_id", "ix", "iy", "iz"]
    plan = [c for c in ("plan_id",) if c in dose.columns]
    if plan:
        ct = ct.join(dose.select("patient_id", *plan).distinct(), "patient_id")
    found = ct.join(dose, ["patient_id", *plan, "voxel_id"], "left").join(labels, cell, "left")
    extra = []
    if masks is not None:
        found = found.join(masks.groupBy(*cell).agg(F.array_sort(F.collect_set("structure")).alias("structures")), cell, "left")
        extra = [F.coalesce("structures", F.array().cast("array<string>")).alias("structures")]
    return found.select(
        *plan, *cell, "hu", F.coalesce("dose_gy", F.lit(0.0)).alias("dose_gy"),
        F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("target", F.lit(0)).alias("target"), *extra,
    )
