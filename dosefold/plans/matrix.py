"""Influence-matrix queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dosefold.functions.numeric import snap
from dosefold.operators import grids
from dosefold.operators import matrix as im
from dosefold.plans.evaluation import RX, S6
from dosefold.plans.registry import query

DOWN = (4, 3, 1)


def bev(t):
    return im.bev_mask(t.beamlet, t.contour)


def columns(t):
    return im.contiguous_ids(bev(t))


@query("dose_from_fluence", "SELECT plan_id, patient_id, voxel_id, dose_gy FROM o_dose")
def dose_from_fluence(t):
    return t.dose


@query("beamlet_finest_grid", "SELECT beam_id, row, col, beamlet_id FROM o_cells")
def beamlet_finest_grid(t):
    return im.finest_grid(t.sized_beamlet)


@query("bev_mask", "SELECT beam_id, beamlet_id, row_idx, col_idx FROM o_bev")
def bev_mask(t):
    return bev(t).select("beam_id", "beamlet_id", "row_idx", "col_idx")


@query("beamlet_contiguous_ids", "SELECT beam_id, beamlet_id, column_id FROM o_cols")
def beamlet_contiguous_ids(t):
    return columns(t)


@query("bev_compact_grid", """
o_sig AS (SELECT beam_id, row, string_agg(col || ':' || beamlet_id, ',' ORDER BY col) AS sig, count(*) AS n FROM o_cells GROUP BY 1, 2),
o_kept AS (SELECT * FROM (SELECT *, lag(sig) OVER (PARTITION BY beam_id ORDER BY row) AS past FROM o_sig) WHERE past IS NULL OR past <> sig),
o_part AS (SELECT a.beam_id, a.row FROM o_kept a WHERE EXISTS (SELECT 1 FROM o_cells x JOIN o_cells y USING (beam_id, beamlet_id)
  WHERE x.beam_id = a.beam_id AND x.row = a.row AND y.row = a.row - 1) ),
o_rows AS (SELECT beam_id, row, row_number() OVER (PARTITION BY beam_id ORDER BY row) - 1 AS r FROM o_kept k
  WHERE NOT EXISTS (SELECT 1 FROM o_part p WHERE p.beam_id = k.beam_id AND p.row = k.row))
SELECT c.beam_id, r.r AS row, c.col // 2 AS col, c.beamlet_id FROM o_cells c JOIN o_rows r ON r.beam_id = c.beam_id AND r.row = c.row
WHERE c.col % 2 = 0""")
def bev_compact_grid(t):
    return im.compact_grid(im.finest_grid(t.sized_beamlet))


@query("beamlet_info", """SELECT c.column_id, b.beam_id, b.beamlet_id, b.x_mm, b.y_mm, cast(2.5 as double) AS width_mm, cast(2.5 as double) AS height_mm
FROM o_cols c JOIN v_beamlet b USING (beam_id, beamlet_id) WHERE c.column_id IN (0, 7, 31, 100)""")
def beamlet_info(t):
    sized = t.beamlet.select("beam_id", "beamlet_id", "x_mm", "y_mm", F.lit(2.5).alias("width_mm"), F.lit(2.5).alias("height_mm"))
    return im.beamlet_info(columns(t), sized, [0, 7, 31, 100])


@query("influence_select", """SELECT i.patient_id, c.beam_id, i.voxel_id, c.column_id, cast(i.a_int as double) AS a
FROM v_influence i JOIN o_cols c USING (beamlet_id)""")
def influence_select(t):
    return im.influence_select(t.influence, columns(t)).select("patient_id", "beam_id", "voxel_id", "column_id", "a")


BLOCK_SQL = """SELECT i.patient_id, b.beam_id, b.row_idx // {r} AS block_row, b.col_idx // {c} AS block_col, i.voxel_id, cast(sum(i.a_int) as double) AS a
FROM v_influence i JOIN {src} b USING (beamlet_id) GROUP BY 1, 2, 3, 4, 5"""


@query("beamlet_downsample", BLOCK_SQL.format(r=2, c=2, src="v_beamlet"))
def beamlet_downsample(t):
    return im.beamlet_downsample(t.influence, im.beamlet_blocks(t.unit_cell, 5.0, 5.0))


@query("beamlet_downsample_full_blocks", """o_full AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY beam_id, row_idx // 2, col_idx // 4) AS n FROM v_beamlet) WHERE n >= 8)
""" + BLOCK_SQL.format(r=2, c=4, src="o_full"))
def beamlet_downsample_full_blocks(t):
    return im.beamlet_downsample(t.influence, im.beamlet_blocks(t.unit_cell, 10.0, 5.0, remove_corners=True))


def voxel_map(t):
    ct = t.ct_voxel.select("patient_id", "ix", "iy", "iz", F.col("dose_voxel").alias("voxel_id"))
    return grids.downsample_map(ct, DOWN, (25, 20, 3))


VMAP_IDS = """o_ids AS (SELECT *, dense_rank() OVER (PARTITION BY patient_id ORDER BY block_id) - 1 AS bid FROM o_vmap)"""


@query("voxel_downsample_map", f"""{VMAP_IDS} SELECT patient_id, voxel_id, bid AS block_id, {S6.format('share')} AS share FROM o_ids""")
def voxel_downsample_map(t):
    return voxel_map(t).withColumn("share", snap(F.col("share")))


@query("voxel_downsample_matrix", f"""{VMAP_IDS} SELECT i.patient_id, o.bid AS block_id, i.beamlet_id, {S6.format('sum(o.share * i.a_int)')} AS a
FROM v_influence i JOIN o_ids o USING (patient_id, voxel_id) GROUP BY 1, 2, 3""")
def voxel_downsample_matrix(t):
    return im.voxel_downsample(t.influence, voxel_map(t), ["beamlet_id"]).withColumn("a", snap(F.col("a")))


@query("downsampled_plan", f"""{VMAP_IDS} SELECT i.patient_id, b.beam_id, b.row_idx // 2 AS block_row, b.col_idx // 2 AS block_col, o.bid AS block_id,
{S6.format('sum(o.share * i.a_int)')} AS a FROM v_influence i JOIN o_ids o USING (patient_id, voxel_id) JOIN v_beamlet b USING (beamlet_id) GROUP BY 1, 2, 3, 4, 5""")
def downsampled_plan(t):
    coarse = im.beamlet_downsample(t.influence, im.beamlet_blocks(t.unit_cell, 5.0, 5.0))
    r = im.voxel_downsample(coarse, voxel_map(t), ["beam_id", "block_row", "block_col"])
    return r.withColumn("a", snap(F.col("a")))


@query("open_field_dose", f"""o_raw AS (SELECT v.patient_id, v.voxel_id, coalesce(sum(i.a_int), 0) AS raw FROM v_voxel v LEFT JOIN v_influence i USING (patient_id, voxel_id) GROUP BY 1, 2)
SELECT patient_id, voxel_id, {S6.format('''cast(raw - min(raw) OVER (PARTITION BY patient_id) as double) / cast(max(raw) OVER (PARTITION BY patient_id) - min(raw) OVER (PARTITION BY patient_id) as double) * 72.0''')} AS open_field_gy FROM o_raw""")
def open_field_dose(t):
    return im.open_field_dose(t.influence, t.voxel, RX).withColumn("open_field_gy", snap(F.col("open_field_gy")))


@query("sparsify_threshold", """SELECT patient_id, voxel_id, beamlet_id, cast(a_int as double) AS a
FROM (SELECT *, max(a_int) OVER (PARTITION BY patient_id) AS top FROM v_influence) WHERE a_int >= cast(top as double) * 30.0::double * 0.01::double""")
def sparsify_threshold(t):
    return im.sparsify_threshold(t.influence, 30.0)


@query("sparsify_absolute", "SELECT patient_id, voxel_id, beamlet_id, cast(a_int as double) AS a FROM v_influence WHERE a_int > 12")
def sparsify_absolute(t):
    return im.sparsify_threshold(t.influence, threshold_abs=12.0, strict=True)


@query("sparsify_rmr", f"""
o_small AS (SELECT *, cast(coalesce(sum(a_int) OVER (PARTITION BY patient_id, voxel_id ORDER BY beamlet_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as double) AS b0,
   cast(sum(a_int) OVER (PARTITION BY patient_id, voxel_id) as double) AS mass FROM v_influence WHERE a_int <= 20),
o_rows AS (SELECT DISTINCT patient_id, voxel_id, mass, cast(ceil(mass / 20) as bigint) AS k FROM o_small),
o_draw AS (SELECT *, ('0x' || substr(md5('0|' || patient_id || '|' || voxel_id || '|' || d), 1, 13))::bigint / 4503599627370496.0::double AS u
  FROM (SELECT *, unnest(range(1, k + 1)) AS d FROM o_rows)),
o_hit AS (SELECT s.patient_id, s.voxel_id, s.beamlet_id, d.mass / d.k AS part FROM o_draw d JOIN o_small s
  ON s.patient_id = d.patient_id AND s.voxel_id = d.voxel_id AND s.b0 / s.mass <= d.u AND (s.b0 + s.a_int) / s.mass > d.u)
SELECT patient_id, voxel_id, beamlet_id, {S6.format('sum(part)')} AS a FROM (SELECT * FROM o_hit UNION ALL
SELECT patient_id, voxel_id, beamlet_id, a_int FROM v_influence WHERE a_int > 20) GROUP BY 1, 2, 3""")
def sparsify_rmr(t):
    return im.sparsify_randomised(t.influence, 20.0).withColumn("a", snap(F.col("a")))


@query("fluence_to_grid", "SELECT f.plan_id, c.beam_id, c.row, c.col, cast(f.intensity as double) AS intensity FROM o_cells c JOIN v_fluence f USING (beamlet_id)")
def fluence_to_grid(t):
    return im.fluence_to_grid(t.fluence, im.finest_grid(t.sized_beamlet)).select("plan_id", "beam_id", "row", "col", "intensity")


@query("grid_to_fluence", """SELECT plan_id, beam_id, beamlet_id, arg_max(intensity + col % 2, row * 100000 + col) AS intensity
FROM (SELECT f.plan_id, c.*, cast(f.intensity as double) AS intensity FROM o_cells c JOIN v_fluence f USING (beamlet_id)) GROUP BY 1, 2, 3""")
def grid_to_fluence(t):
    grid = im.fluence_to_grid(t.fluence, im.finest_grid(t.sized_beamlet)).withColumn(
        "intensity", F.col("intensity") + F.col("col") % 2
    )
    return im.grid_to_fluence(grid, ["plan_id", "beam_id"])


@query("fluence_transfer", """
o_mr AS (SELECT beam_id, max(row_idx) AS mr FROM v_beamlet GROUP BY 1),
o_fine AS (SELECT b.beam_id, b.beamlet_id, 2 * b.row_idx + i.i AS row, 2 * b.col_idx + j.j AS col, b.beamlet_id * 4 + i.i * 2 + j.j AS fine_id
  FROM v_beamlet b CROSS JOIN (VALUES (0), (1)) i(i) CROSS JOIN (VALUES (0), (1)) j(j))
SELECT f.plan_id, c.beam_id, c.fine_id AS beamlet_id, cast(f.intensity as double) AS intensity FROM o_fine c JOIN v_fluence f USING (beamlet_id)""")
def fluence_transfer(t):
    cells = t.unit_cell.select(
        "beam_id", "beamlet_id", F.explode(F.array(*[F.lit(q).cast("long") for q in range(4)])).alias("q"), "row", "col"
    ).select("beam_id", "beamlet_id", (F.col("row") * 2 + F.floor(F.col("q") / 2)).alias("row"),
             (F.col("col") * 2 + F.col("q") % 2).alias("col"), "q")
    fine = cells.select("beam_id", (F.col("beamlet_id") * 4 + F.col("q")).alias("beamlet_id"), "row", "col")
    return im.fluence_transfer(t.fluence, cells.drop("q"), fine)


@query("column_group_sum", "SELECT i.patient_id, i.voxel_id, b.row_idx AS group_id, cast(sum(i.a_int) as double) AS a FROM v_influence i JOIN v_beamlet b USING (beamlet_id) GROUP BY 1, 2, 3")
def column_group_sum(t):
    return im.column_group_sum(t.influence, t.beamlet.select("beamlet_id", F.col("row_idx").alias("group_id")))


@query("column_tail_zero", """SELECT patient_id, voxel_id, beamlet_id, cast(a_int as double) AS a
FROM (SELECT *, max(a_int) OVER (PARTITION BY patient_id, beamlet_id) AS top FROM v_influence) WHERE a_int > cast(top as double) * 0.5""")
def column_tail_zero(t):
    return im.column_tail_zero(t.influence, 0.5)


@query("matrix_compare", f"""o_s AS (SELECT *, CASE WHEN a_int >= cast(max(a_int) OVER (PARTITION BY patient_id) as double) * 30.0::double * 0.01::double THEN 0 ELSE a_int END AS d FROM v_influence)
SELECT patient_id, cast(max(d) as double) AS max_abs_diff, {S6.format('cast(sum(d) as double) / count(*)')} AS mean_abs_diff,
 {S6.format('sqrt(cast(sum(d * d) as double)) / sqrt(cast(sum(a_int * a_int) as double))')} AS relative_norm FROM o_s GROUP BY 1""")
def matrix_compare(t):
    r = im.matrix_compare(t.influence, im.sparsify_threshold(t.influence, 30.0), ["patient_id", "voxel_id", "beamlet_id"])
    return r.select("patient_id", "max_abs_diff", snap(F.col("mean_abs_diff")).alias("mean_abs_diff"), snap(F.col("relative_norm")).alias("relative_norm"))


def _d90(dose_name):
    """D90 of the target for a dose table, written over sorted points."""
    return f"""SELECT patient_id, plan_id, max(CASE WHEN 100 * y >= 90 AND 100 * y2 < 90 THEN CASE WHEN 100 * y = 90 THEN x ELSE x + (90 - 100 * y) * (x2 - x) / (100 * y2 - 100 * y) END
  ELSE 0 END) AS d90 FROM (
  SELECT patient_id, plan_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (
    SELECT d.patient_id, d.plan_id, d.dose_gy AS x, s.frac * (1 - cast(coalesce(sum(o.vol_u) OVER (PARTITION BY d.patient_id, d.plan_id ORDER BY d.dose_gy, d.voxel_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as double) / cast(sum(o.vol_u) OVER (PARTITION BY d.patient_id, d.plan_id) as double)) AS y
    FROM {dose_name} d JOIN o_ov o USING (patient_id, voxel_id) JOIN o_struct s ON s.patient_id = d.patient_id AND s.structure = o.structure WHERE o.structure = 'PTV'
    UNION ALL SELECT d.patient_id, d.plan_id, max(d.dose_gy) + cast(0.01 as double), 0 FROM {dose_name} d JOIN o_ov o USING (patient_id, voxel_id) WHERE o.structure = 'PTV' GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY patient_id, plan_id ORDER BY x, y DESC)) GROUP BY 1, 2"""


@query("dose_correction_delta", f"""
o_sp AS (SELECT *, a_int >= cast(max(a_int) OVER (PARTITION BY patient_id) as double) * 30.0::double * 0.01::double AS keep FROM v_influence),
o_sd2 AS (SELECT p.plan_id, v.patient_id, v.voxel_id, cast(coalesce(d.t, 0) as double) * cast(0.01 as double) AS dose_gy
  FROM v_voxel v CROSS JOIN (SELECT DISTINCT plan_id FROM v_fluence) p
  LEFT JOIN (SELECT f.plan_id, i.patient_id, i.voxel_id, sum(i.a_int * f.intensity) AS t FROM o_sp i JOIN v_fluence f USING (beamlet_id) WHERE keep GROUP BY 1, 2, 3) d
    ON d.plan_id = p.plan_id AND d.patient_id = v.patient_id AND d.voxel_id = v.voxel_id),
o_n1 AS ({_d90('o_dose')}), o_n2 AS ({_d90('o_sd2')})
SELECT a.patient_id, a.plan_id, a.voxel_id,
 {S6.format('(a.dose_gy / nullif(n1.d90 / 60, 0) - b.dose_gy / nullif(n2.d90 / 60, 0)) / 30')} AS delta_gy,
 {S6.format('(b.dose_gy / 30 + (a.dose_gy / nullif(n1.d90 / 60, 0) - b.dose_gy / nullif(n2.d90 / 60, 0)) / 30) * 30')} AS corrected_gy
FROM o_dose a JOIN o_sd2 b USING (patient_id, plan_id, voxel_id) JOIN o_n1 n1 USING (patient_id, plan_id) JOIN o_n2 n2 USING (patient_id, plan_id)""")
def dose_correction_delta(t):
    sparse = im.dose_from_fluence(
        im.sparsify_threshold(t.influence, 30.0), t.fluence, t.voxel, plan_ids=["A", "B"], scale=0.01
    )
    r = im.dose_correction(t.dose, sparse, t.opt_voxel, t.structure, RX, 30)
    return r.select("patient_id", "plan_id", "voxel_id", snap(F.col("delta_gy")).alias("delta_gy"), snap(F.col("corrected_gy")).alias("corrected_gy"))


@query("first_column_lookup", """o_w AS (SELECT beam_id, beamlet_id FROM v_beamlet UNION ALL SELECT DISTINCT beam_id, cast(-5 as bigint) FROM v_beamlet)
SELECT w.beam_id, w.beamlet_id, coalesce(min(c.col), -1)::double AS first_col FROM o_w w LEFT JOIN
(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY beam_id, beamlet_id ORDER BY row, col) AS k FROM o_cells) WHERE k = 1) c USING (beam_id, beamlet_id) GROUP BY 1, 2""")
def first_column_lookup(t):
    wanted = t.beamlet.select("beam_id", "beamlet_id").unionByName(
        t.beamlet.select("beam_id").distinct().withColumn("beamlet_id", F.lit(-5).cast("long"))
    )
    return im.first_column_lookup(im.finest_grid(t.sized_beamlet), wanted, default=-1.0)
