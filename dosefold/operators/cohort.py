"""Cohort, beam and file selection over metadata tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.functions.numeric import rows

# Files every patient folder holds.
STATIC_FILES = [
    "CT_Data.h5", "CT_MetaData.json", "StructureSet_Data.h5", "StructureSet_MetaData.json",
    "OptimizationVoxels_Data.h5", "OptimizationVoxels_MetaData.json", "PlannerBeams.json",
]


def disease_site(name: Column) -> Column:
    return F.when(name.contains("_"), F.substring_index(name, "_", 1)).otherwise("Unknown")


def natural_order(name: Column) -> list[Column]:
    """Text part first, then the trailing number by value."""
    number = F.regexp_extract(name, r"(\d+)$", 1)
    return [F.regexp_replace(name, r"\d+$", ""), F.when(number != "", number.cast("long"))]


def patient_list(patients: DataFrame, structures: DataFrame, beams: DataFrame) -> DataFrame:
    """Patients with site, exact-PTV volume and beam count in natural order."""
    volume = structures.filter("structure = 'PTV'").select("patient_id", F.col("volume_cc").alias("ptv_vol_cc"))
    counts = beams.groupBy("patient_id").agg(F.count(F.lit(1)).alias("num_beams"))
    return (
        patients.filter(F.col("name").contains("Patient"))
        .join(volume, "patient_id", "left").join(counts, "patient_id", "left")
        .select("name", disease_site(F.col("name")).alias("disease_site"), "ptv_vol_cc",
                F.coalesce("num_beams", F.lit(0)).alias("num_beams"))
        .orderBy(*natural_order(F.col("name")))
    )


def beam_inventory(beams: DataFrame) -> DataFrame:
    """Beam attributes and which matrix files exist."""
    full = F.coalesce(F.col("full_file").contains("full"), F.lit(False))
    sparse = F.coalesce(F.col("sparse_file").contains("sparse"), F.lit(False))
    return beams.select(
        "patient_id", "beam_id", "gantry_angle", "collimator_angle", "couch_angle", "energy_mv", "iso_x_mm",
        F.when(full & sparse, "Both").when(sparse, "Only Sparse").when(full, "Only Full").alias("matrix"),
    )


def beam_filter(
    beams: DataFrame, gantry=None, collimator=None, couch=None, energies=None, iso_x=None, beam_ids=None
) -> DataFrame:
    """AND of membership filters; an empty list means no filter, explicit ids override all others.

    Ids are returned as text when they were given explicitly.
    """
    if beam_ids is not None:
        return beams.filter(F.col("beam_id").cast("string").isin([str(b) for b in beam_ids])).withColumn(
            "beam_id", F.col("beam_id").cast("string")
        )
    asked = {
        "gantry_angle": gantry, "collimator_angle": collimator, "couch_angle": couch,
        "energy_mv": energies, "iso_x_mm": iso_x,
    }
    for column, values in asked.items():
        if values:
            beams = beams.filter(F.col(column).isin(list(values)))
    return beams


def planner_beams(beams: DataFrame, planner: DataFrame, all_if_none: bool = False) -> DataFrame:
    """Planner-selected beams; patients without a selection keep none, or all on the plan path."""
    chosen = beams.join(planner.select("patient_id", "beam_id"), ["patient_id", "beam_id"], "left_semi")
    if not all_if_none:
        return chosen
    unlisted = beams.join(planner.select("patient_id").distinct(), "patient_id", "left_anti")
    return chosen.unionByName(unlisted)


def iso_match(beams: DataFrame, planner: DataFrame, iso: list[str]) -> DataFrame:
    """Beams that share an iso centre with a planner beam; not applied to patients without one."""
    centres = beams.join(planner.select("patient_id", "beam_id"), ["patient_id", "beam_id"], "left_semi").select(
        "patient_id", *iso
    ).distinct()
    matched = beams.join(centres, ["patient_id", *iso], "left_semi")
    return matched.unionByName(beams.join(centres.select("patient_id").distinct(), "patient_id", "left_anti").select(*matched.columns))


def beam_dedup(beams: DataFrame, fingerprint: list[str], iso: list[str], position: str = "beam_id") -> DataFrame:
    """First beam in input order per fingerprint, iso centres rounded half-even to 2 decimals."""
    keyed = beams.select("*", *[F.bround(F.col(c), 2).alias(f"_{c}") for c in iso])
    keys = [*fingerprint, *[f"_{c}" for c in iso]]
    first = keyed.groupBy(*keys).agg(F.min_by(F.struct(*beams.columns), position).alias("_row"))
    return first.select("_row.*")


def cohort_filter(
    patients: DataFrame, structures: DataFrame, beams: DataFrame, site: str | None = None, patient_ids=None,
    min_ptv_cc: float | None = None, max_patients: int | None = None, **beam_filters,
) -> DataFrame:
    """Patients that pass every filter and have a matching beam, with their matching beam count.

    Each patient is judged on its own; the first `max_patients` in list order are
    kept when that is asked for.
    """
    p = patients
    if site:
        p = p.filter(F.lower(disease_site(F.col("name"))).contains(site.lower()))
    if patient_ids:
        p = p.filter(F.col("name").isin(list(patient_ids)))
    target = structures.filter(F.col("structure").contains("PTV")).groupBy("patient_id").agg(
        F.min_by("volume_cc", "position").alias("ptv_vol_cc")
    )
    p = p.join(target, "patient_id", "left")
    if min_ptv_cc is not None:
        p = p.filter(F.col("ptv_vol_cc") >= min_ptv_cc)
    matching = beam_filter(beams, **beam_filters).groupBy("patient_id").agg(F.count(F.lit(1)).alias("num_matching_beams"))
    found = p.join(matching, "patient_id").select("patient_id", "name", "ptv_vol_cc", "num_matching_beams")
    if max_patients is not None:
        found = found.orderBy(*natural_order(F.col("name"))).limit(max_patients)
    return found


def download_manifest(patients: DataFrame, beams: DataFrame | None = None, mode: str = "planner") -> DataFrame:
    """Paths a selection needs: static files, the DICOM folder and two files per beam."""
    root = F.concat(F.lit("data/"), F.col("name"), F.lit("/"))
    fixed = [*STATIC_FILES, "DicomFiles/**"]
    if mode == "all":
        fixed += ["Beams/Beam_*_Data.h5", "Beams/Beam_*_MetaData.json"]
    paths = patients.select("name", F.explode(F.array(*[F.lit(f) for f in fixed])).alias("file")).select(
        "name", F.concat(root, F.col("file")).alias("path")
    )
    if mode in ("none", "all") or beams is None:
        return paths
    stem = F.concat(root, F.lit("Beams/Beam_"), F.col("beam_id").cast("string"))
    pair = F.array(F.concat(stem, F.lit("_Data.h5")), F.concat(stem, F.lit("_MetaData.json")))
    return paths.unionByName(
        beams.join(patients, "patient_id").select("name", F.explode(pair).alias("path"))
    )


def missing_files(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    return manifest.join(existing.select("path"), "path", "left_anti")


def size_tier(volumes: DataFrame, tiers: list[tuple[str, float, float]]) -> DataFrame:
    """Half-open volume range to tier; unknown, empty or uncovered volumes are medium."""
    v = F.col("ptv_volume_cc")
    chosen = F.lit("medium")
    for tier, low, high in reversed(tiers):
        chosen = F.when((v > 0) & (v >= low) & (v < high), tier).otherwise(chosen)
    return volumes.withColumn("tier", chosen)


def beam_attributes(beams: DataFrame, beam_ids: list[int], columns: list[str]) -> DataFrame:
    """Attributes of the listed beams in list order; an id may be listed twice."""
    spark = beams.sparkSession
    wanted = rows(spark, "position long, beam_id long", list(enumerate(beam_ids)))
    return F.broadcast(wanted).join(beams, "beam_id").select("position", "patient_id", "beam_id", *columns).orderBy("position")


def spaced_angles(patients: DataFrame, beams: DataFrame) -> DataFrame:
    """Beams at six gantry angles 60 degrees apart; the start (0..55 step 5) is a fixed rule of the patient number."""
    start = (F.col("patient_id") * 7 + 42) % 12 * 5
    angles = patients.select(
        "patient_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (start + 60 * k) % 360)).alias("gantry_angle")
    )
    return beams.join(angles, ["patient_id", "gantry_angle"], "left_semi")
