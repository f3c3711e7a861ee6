"""Results that grow with the product of two tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions import salted
from dosefold.operators import geometry as ge


def _beams(spark, patients):
    base = spark.range(patients).coalesce(1).select(F.col("id").alias("patient_id"), F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("beam_id"))
    turned = base.select("*", (F.col("beam_id") * 45).alias("gantry_angle"), (F.col("patient_id") % 7).alias("couch_angle"), F.lit(5).alias("collimator_angle"))
    return ge.with_rotation(turned).withColumns({"iso_x": F.col("patient_id") * 1.5, "iso_y": F.lit(2.0), "iso_z": F.lit(-1.0)})


def _lattice(spark, n):
    k = F.col("id")
    return spark.range(n).coalesce(1).select((k % 2).alias("beam_id"), k.alias("beamlet_id"), (k % 10 * 2.5).alias("x_mm"), (F.floor(k / 10) * 2.5).alias("y_mm"))


def test_shared_beamlets_meet_all_patients_in_many_tasks(spark):
    """Few bytes meet, so by their size the rows would be made in one task."""
    beams, lattice = _beams(spark, 40), _lattice(spark, 3000)
    found = ge.source_and_beamlet_points(beams, lattice)
    sizes = [n for _, n in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40 * 3000 and len(sizes) >= 8 and max(sizes) < 40 * 3000 / 3
    axes = [f"{p}_{a}" for p in ("source", "target") for a in "xyz"]
    plain = ge._with_points(beams.join(lattice, "beam_id"), 1000.0)
    rows = ["patient_id", "beam_id", "beamlet_id", *axes]
    assert sorted(found.select(rows).collect()) == sorted(plain.select(rows).collect())


def test_blocks_are_bounded_and_hold_every_row(spark, monkeypatch):
    monkeypatch.setattr(salted, "BLOCK", 7)
    many = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("x"))
    met, blocks = salted.block_join(spark.range(5).select((F.col("id") % 2).alias("k"), F.col("id").alias("y")), many, ["k"], ["y"], ["x"])
    assert met.agg(F.max(F.size(blocks))).first()[0] == 7
    pairs = met.select("y", F.inline(blocks)).collect()
    assert sorted((p["y"], p["x"]) for p in pairs) == sorted((y, x) for y in range(5) for x in range(300) if x % 2 == y % 2)


def test_patch_of_rays_known_to_miss_is_made_without_a_join(spark):
    """Misses among the rays and rays given as missed get the same cells; no ray is marched twice for its misses."""
    rays = _beams(spark, 3).join(_lattice(spark, 30), "beam_id")
    rays = ge._with_points(rays, 1000.0).withColumn("entry_mm", F.when(F.col("beamlet_id") % 3 == 0, 995.0))
    body = spark.createDataFrame([(p, x, y, z) for p in range(3) for x in range(-9, 9) for y in range(-9, 9) for z in range(-6, 6)], "patient_id long, ix long, iy long, iz long")
    place = ((0.0, 0.0, 0.0), (5.0, 5.0, 5.0), (60.0, 11.0, 9.0), (4, 2, 2), 970.0)
    whole = ge.ray_patch(rays, body, *place)
    apart = ge.ray_patch(rays.filter("entry_mm IS NOT NULL"), body, *place, missed=rays.filter("entry_mm IS NULL"))
    found = sorted(map(tuple, whole.collect()))
    assert found == sorted(map(tuple, apart.select(whole.columns).collect())) and len(found) == 3 * 30 * 16
    misses = [r for r in whole.join(rays.filter("entry_mm IS NULL").select("patient_id", "beam_id", "beamlet_id"), ["patient_id", "beam_id", "beamlet_id"]).collect()]
    assert len(misses) == 3 * 20 * 16 and all(r.outside_mm == r.d1_mm and r.inside_mm == 0 for r in misses)
    assert any(r[-1] > 0 for r in found)
    text = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in text and text.count("Generate") == 2  # the beams and the places


def test_large_beamlet_table_is_not_broadcast(spark, monkeypatch):
    """Its file is small for its rows, so Spark would send tables of it through the driver at any size of the file below the threshold."""
    from dosefold.plans import load_all
    from dosefold.sources import star_schema

    found = []
    for limit in (10**9, 10):
        monkeypatch.setattr(star_schema, "SHARED_ROWS", limit)
        t = star_schema.StarSchema(spark, "/root/testdata/sf0.001")
        joins = [t.own_beamlet.join(t.fluence, "beamlet_id"), t.own_beamlet.join(t.fluence.filter("plan_id = 'A'"), "beamlet_id"), t.own_beamlet.join(t.unit_cell, "beamlet_id")]
        plans = [j._jdf.queryExecution().executedPlan().toString() for j in joins]
        assert all(("BroadcastExchange" in p) == (limit > 10) for p in plans)
        found.append(sorted(load_all()[0]["interior_boundary_split_plans"](spark, "/root/testdata/sf0.001").collect()))
    assert found[0] == found[1] and found[0]


def test_matrix_files_do_not_grow_with_patients(spark, tmp_path):
    import os

    import pyarrow.parquet as pq

    from dosefold.sources import metadata as io

    def saved(patients):
        k, path = F.col("id"), f"{tmp_path}/{patients}"
        df = spark.range(patients * 40).select((k % patients).alias("patient_id"), (k % 4).alias("beam_id"), k.alias("voxel_id"), k.alias("beamlet_id"), (k % 7).cast("double").alias("a"))
        df = df.withColumn("variant", F.explode(F.array(F.lit("full"), F.lit("sparse"))))
        io.save_matrix(df, path)
        for full in (True, False):
            read = io.load_matrix(spark, path, full, [1, 3])
            want = df.filter((F.col("beam_id") % 2 == 1) & (F.col("variant") == ("full" if full else "sparse")))
            assert sorted(read.select(want.columns).collect()) == sorted(want.collect()) and read.count()
        own = io.load_matrix(spark, path, True, patient_id=3)
        assert sorted(r.voxel_id for r in own.collect()) == [v for v in range(patients * 40) if v % patients == 3]
        one = [f for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
        for d, _, names in os.walk(path):
            for f in names:
                if f.endswith(".parquet"):
                    rows = pq.ParquetFile(f"{d}/{f}").read(["patient_id"])["patient_id"].to_pylist()
                    assert rows == sorted(rows)
        return len(one)

    most = 2 * 4 * io.PATIENT_GROUPS  # variants, beams, groups
    assert saved(5) <= saved(60) <= most < 2 * 4 * 60
