"""Readers on files shaped like patient folders."""

import json

import pytest
from pyspark.sql import functions as F

from dosefold.sources import metadata as io


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(data))


def test_patient_folders(spark, tmp_path):
    for patient in ("Lung_Patient_2", "Lung_Patient_10"):
        for beam in (0, 2, 10):
            put(tmp_path / patient / "Beams" / f"Beam_{beam}_MetaData.json", {
                "ID": beam, "gantry_angle": beam * 5, "iso_center": {"x_mm": 1.5, "y_mm": 2, "z_mm": -3}, "energy_MV": "6",
                "influenceMatrixSparse_File": "Beam_Data.h5/influenceMatrixSparse",
            })
        put(tmp_path / patient / "StructureSet_MetaData.json", [
            {"name": "PTV", "volume_cc": 12.5, "fraction_of_vol_in_calc_box": 1}, {"name": "CORD", "volume_cc": 3.0, "fraction_of_vol_in_calc_box": 0.5},
        ])
        put(tmp_path / patient / "PlannerBeams.json", {"IDs": [0, 10]})
    beams = io.scan_beams(spark, str(tmp_path)).collect()
    assert [(b.patient_id, b.ID) for b in beams if b.patient_id == "Lung_Patient_2"] == [("Lung_Patient_2", k) for k in (0, 2, 10)]
    assert beams[0].iso_center.x_mm == 1.5 and beams[0].jaw_position is None
    assert {(s.patient_id, s.name, s.volume_cc) for s in io.scan_structures(spark, str(tmp_path)).collect()} == {
        (p, n, v) for p in ("Lung_Patient_2", "Lung_Patient_10") for n, v in (("PTV", 12.5), ("CORD", 3.0))}
    assert io.scan_planner_beams(spark, str(tmp_path)).count() == 4


def test_manifest_counts_only_lists(spark, tmp_path):
    lines = [{"patient_id": "Lung_Patient_1", "beam_metadata_paths": ["a", "b"]}, {"patient_id": "Phantom", "beam_metadata_paths": "a"},
             {"patient_id": None, "beam_metadata_paths": ["a"]}, {"patient_id": "Prostate_Patient_3"}]
    (tmp_path / "data_info.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    got = {r.patient_id: (r.disease_site, r.num_beams) for r in io.scan_manifest(spark, str(tmp_path)).collect()}
    assert got == {"Lung_Patient_1": ("Lung", 2), "Phantom": ("Unknown", None), "Prostate_Patient_3": ("Prostate", 0)}


def test_protocol_rows(spark, tmp_path):
    put(tmp_path / "p.json", {"disease_site": "Lung", "protocol_name": "L", "pres_per_fraction_gy": 2, "num_of_fractions": 30, "criteria": [
        {"type": "max_dose", "parameters": {"structure_name": "PTV"}, "constraints": {"limit_dose_gy": 69, "goal_dose_gy": "1.1*prescription_gy"}}]})
    got = {(r.structure, r.bound_key, r.bound_value) for r in io.scan_protocols(spark, str(tmp_path / "p.json")).collect()}
    assert got == {("PTV", "limit_dose_gy", "69"), ("PTV", "goal_dose_gy", "1.1*prescription_gy")}


def test_fluence_files_are_ordered(spark, tmp_path):
    grid = spark.createDataFrame([(0, r, c, float(r * 3 + c)) for r in range(2) for c in range(3) if (r, c) != (0, 1)], "beam_id long, row long, col long, intensity double")
    beamlets = spark.createDataFrame([(0, c * 2.5, r * 2.5, 2.5, 2.5) for r in range(2) for c in range(3)], "beam_id long, x_mm double, y_mm double, width_mm double, height_mm double")
    io.write_fluence(io.fluence_lines(grid, beamlets, 2.0), str(tmp_path / "out"))
    text = next((tmp_path / "out" / "beam_id=0").glob("*.txt")).read_text().splitlines()
    assert text[:3] == ["optimalfluence", "SizeX      3", "SizeY      2"] and text[7] == "Values"
    assert text[8:] == ["0.000000\t0.000000\t1.000000", "1.500000\t2.000000\t2.500000"]


def test_headers_arcs_and_configuration(spark, tmp_path):
    put(tmp_path / "P_1" / "CT_MetaData.json", {"origin_xyz_mm": [-10.5, 2, 3], "resolution_xyz_mm": [1, 1, 3], "size_xyz_mm": [9, 8, 7], "direction": [1, 0, 0, 0, 1, 0, 0, 0, 1]})
    put(tmp_path / "P_1" / "OptimizationVoxels_MetaData.json", {"ct_origin_xyz_mm": [0, 1, 2], "ct_voxel_resolution_xyz_mm": [1, 1, 2], "dose_voxel_resolution_xyz_mm": [2, 2, 2]})
    put(tmp_path / "P_1" / "arcs.json", {"arcs": [{"arc_id": "a", "control_point_ids": [3, 4, 5], "gantry_start_angle": 180.0}, {"arc_id": "b", "control_point_ids": []}]})
    put(tmp_path / "objectives.json", {"objective_functions": [{"type": "quadratic", "structure_name": "CORD", "weight": 2.5}, {"type": "linear", "structure_name": "PTV", "weight": 1, "dose_gy": "prescription_gy"}]})
    put(tmp_path / "ids.json", {"tcia_patients": [{"own": "P_1", "subject": "S9", "site": "x"}]})
    put(tmp_path / "tiers.json", {"ptv_size_thresholds_cc": {"small": [0, 50], "large": [50, 900.5]}})
    put(tmp_path / "card.json", {"DosePerFraction": 2, "NumberOfFractions": 30, "ScoreTemplates": [
        {"Structure": {"StructureId": "PTV"}, "MetricType": "DoseAtVolume", "InputValue": 95, "InputUnit": "%", "OutputUnit": "Gy", "ScorePoints": [{"PointX": 57, "Score": 0}, {"PointX": 60, "Score": 10}]}]})
    head = io.scan_ct_headers(spark, str(tmp_path)).first()
    assert (head.patient_id, head.origin.x, head.spacing.z, head.size.y) == ("P_1", -10.5, 3.0, 8)
    voxel = io.scan_voxel_headers(spark, str(tmp_path)).first()
    assert voxel.dose_spacing.x == 2.0 and voxel.start_mm is None
    assert [(r.arc_id, r.beam_ids) for r in io.scan_arcs(spark, str(tmp_path)).collect()] == [("a", [3, 4, 5]), ("b", [])]
    assert [(r.objective_id, r.structure, r.dose_gy) for r in io.scan_objectives(spark, str(tmp_path / "objectives.json")).collect()] == [(0, "CORD", None), (1, "PTV", "prescription_gy")]
    assert {(r.name, r.field, r.value) for r in io.scan_source_ids(spark, str(tmp_path / "ids.json"), "own").collect()} == {("P_1", "subject", "S9"), ("P_1", "site", "x")}
    assert {tuple(r) for r in io.scan_size_tiers(spark, str(tmp_path / "tiers.json")).collect()} == {("small", 0.0, 50.0), ("large", 50.0, 900.5)}
    assert [(r.structure, r.fractions, r.x, r.score) for r in io.scan_scorecards(spark, str(tmp_path / "card.json")).collect()] == [("PTV", 30, 57.0, 0.0), ("PTV", 30, 60.0, 10.0)]


LINES = "patient_id long, plan_id string, beam_id long, line_no long, line string"


def fluence_rows():
    return [(p, plan, b, n, f"{p}{plan}{b} line {n}\tx") for p in (1, 22) for plan in ("A", "B/2") for b in range(3) for n in range(12)]


def test_fluence_files_of_two_plans(spark, tmp_path):
    given = spark.createDataFrame(fluence_rows(), LINES).repartition(5)
    io.write_fluence(given, str(tmp_path / "out"))
    assert (tmp_path / "out/patient_id=22/plan_id=A/beam_id=2/optimal_fluence.txt").read_text().splitlines() == [f"22A2 line {n}\tx" for n in range(12)]
    read = io.read_fluence(spark, str(tmp_path / "out"))
    assert sorted((r.patient_id, r.plan_id, r.beam_id, r.line_no, r.line) for r in read.collect()) == sorted(fluence_rows())
    left = [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert len(left) == 12 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_failed_fluence_job_leaves_no_file(spark, tmp_path):
    given = spark.createDataFrame(fluence_rows(), LINES).repartition(4, "beam_id")
    bad = given.withColumn("line", F.when((F.col("beam_id") == 2) & (F.col("line_no") == 11) & (F.col("patient_id") == 22), F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        io.write_fluence(bad, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_files_that_are_there_stay(spark, tmp_path):
    first = spark.createDataFrame(fluence_rows(), LINES)
    io.write_fluence(first.filter("beam_id = 0"), str(tmp_path))
    with pytest.raises(Exception, match="are there already"):
        io.write_fluence(first.withColumn("line", F.lit("new")), str(tmp_path))
    assert len([p for p in tmp_path.rglob("*") if p.is_file()]) == 4
    io.write_fluence(first.withColumn("line", F.lit("new")), str(tmp_path), overwrite=True)
    assert {p.read_text() for p in tmp_path.rglob("*") if p.is_file()} == {"new\n" * 12}


def test_solutions_of_a_patient_and_plan(spark, tmp_path):
    rows = [(p, plan, b, float(b)) for p in (1, 2) for plan in "AB" for b in range(5)]
    io.save_solution(spark.createDataFrame(rows, "patient_id long, plan_id string, beamlet_id long, intensity double"), str(tmp_path / "s"))
    found = io.load_solution(spark, str(tmp_path / "s"), "B", 2)
    assert sorted((r.patient_id, r.plan_id, r.beamlet_id) for r in found.collect()) == [(2, "B", b) for b in range(5)]
    assert "PartitionFilters: [isnotnull" in found._jdf.queryExecution().toString()
