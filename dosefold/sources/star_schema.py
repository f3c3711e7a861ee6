"""Planning-data tables derived from the order/lineitem star schema.

Each property is a lazy DataFrame over whole tables; `ORACLE_VIEWS` states the
same tables as SQL text for the independent check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dosefold.functions.salted import grown

VOXELS_PER_PATIENT = 1500
#: Rows of the matrix that one task adds up.
TASK_ROWS = 1 << 19
#: Rows of the beamlet table up to which a join with it may be a broadcast.
SHARED_ROWS = 1 << 21
GRID = (25, 20, 3)


class StarSchema:
    """Patients, voxels, masks, matrix and plans read from one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def voxel(self) -> DataFrame:
        key = F.col("o_orderkey").cast("long")
        return self.table("orders").select(
            F.floor(key / 1500).alias("patient_id"),
            (key % 1500).alias("voxel_id"),
            (key % 25).alias("ix"),
            F.floor((key % 500) / 25).alias("iy"),
            F.floor((key % 1500) / 500).alias("iz"),
            (F.floor(F.col("o_totalprice")).cast("long") % 4071 - 1000).alias("hu"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("vol_u"),
            F.col("o_orderpriority").alias("prio"),
            F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def tasks(self) -> int:
        """Tasks for the rows of the matrix, from the row counts that the files tell: a task's share, and so its memory, does not grow with the table."""
        return max(self.spark.sparkContext.defaultParallelism, -(-self.table("lineitem").count() // TASK_ROWS))

    @cached_property
    def entry(self) -> DataFrame:
        key = F.col("l_orderkey").cast("long")
        return self.table("lineitem").select(
            F.floor(key / 1500).alias("patient_id"), (key % 1500).alias("voxel_id"),
            F.col("l_partkey").cast("long").alias("beamlet_id"), "l_quantity",
        )

    @cached_property
    def influence(self) -> DataFrame:
        """Entries of one voxel and beamlet added up; few share one, so they are dealt before any sum."""
        return self.entry.repartition(self.tasks, "patient_id", "voxel_id").groupBy("patient_id", "voxel_id", "beamlet_id").agg(
            F.sum("l_quantity").cast("double").alias("a")
        )

    @cached_property
    def own_beamlet(self) -> DataFrame:
        """The beamlets that a patient's matrix has."""
        return self.entry.select("patient_id", "beamlet_id").repartition(self.tasks, "patient_id", "beamlet_id").distinct()

    @cached_property
    def part(self) -> DataFrame:
        """The beamlets' table.

        Its file packs a key and a number into a few bytes, of which Spark takes a
        share for the columns read: far less than the rows need in memory, and plans
        multiply them. From SHARED_ROWS rows (the files tell) it asks for joins by
        shuffle, or all of it would go through the driver to every executor.
        """
        part = self.table("part")
        return grown(part) if part.count() > SHARED_ROWS else part

    @cached_property
    def beamlet(self) -> DataFrame:
        key = F.col("p_partkey").cast("long")
        local = F.floor(key / 8)
        return self.part.select(
            key.alias("beamlet_id"),
            (key % 8).alias("beam_id"),
            local.alias("local_id"),
            (local % 10).alias("col_idx"),
            F.floor(key / 80).alias("row_idx"),
            ((local % 10) * 2.5 - 11.25).cast("double").alias("x_mm"),
            (F.floor(key / 80) * 2.5).cast("double").alias("y_mm"),
        )

    @cached_property
    def fluence(self) -> DataFrame:
        """Two plans per beamlet from one scan of the part table."""
        size = F.col("p_size").cast("long")
        plans = F.array(
            F.struct(F.lit("A").alias("plan_id"), size.alias("intensity")),
            F.struct(F.lit("B").alias("plan_id"), (51 - size).alias("intensity")),
        )
        return self.part.select(
            F.col("p_partkey").cast("long").alias("beamlet_id"), F.inline(plans)
        ).select("plan_id", "beamlet_id", F.col("intensity").cast("double").alias("intensity"))

    @cached_property
    def structure_voxel(self) -> DataFrame:
        """Overlapping masks; every voxel row is read once and fans out to its masks."""
        prio, status = F.col("prio"), F.col("status")
        members = F.array(
            F.lit("BODY"),
            F.when(prio == "1-URGENT", "PTV"),
            F.when((prio == "1-URGENT") & (status == "F"), "GTV"),
            F.when(prio == "2-HIGH", "CORD"),
            F.when(prio == "3-MEDIUM", "HEART"),
            F.when(prio == "4-NOT SPECIFIED", "LUNG_L"),
            F.when(prio == "5-LOW", "LUNG_R"),
            F.when(F.col("ix").between(8, 14) & F.col("iy").between(6, 12), "BOX"),
        )
        return self.voxel.select(
            F.explode(F.array_compact(members)).alias("structure"),
            "patient_id", "voxel_id", "ix", "iy", "iz", "vol_u",
        )

    @cached_property
    def beam(self) -> DataFrame:
        supp, nation = F.col("s_suppkey").cast("long"), F.col("s_nationkey").cast("long")
        return self.table("supplier").select(
            supp.alias("beam_id"),
            nation.alias("patient_id"),
            (supp * 5 % 360).alias("gantry_angle"),
            (nation % 4 * 90).alias("collimator_angle"),
            F.lit(0).cast("long").alias("couch_angle"),
            F.when(nation % 2 == 0, "6").otherwise("10").alias("energy_mv"),
            (F.floor("s_acctbal").cast("double") / 10.0).alias("iso_x_mm"),
            (supp % 6 == 0).alias("is_planner"),
        )

    @cached_property
    def scenario(self) -> DataFrame:
        key = F.col("l_orderkey").cast("long")
        return (
            self.table("lineitem")
            .groupBy(
                F.floor(key / 1500).alias("patient_id"),
                (key % 1500).alias("voxel_id"),
                F.col("l_returnflag").alias("scenario"),
            )
            .agg(F.sum("l_quantity").cast("double").alias("dose_gy"))
        )

    @cached_property
    def predicted(self) -> DataFrame:
        key = F.col("o_orderkey").cast("long")
        base = F.floor(F.col("o_totalprice") / 80).cast("long")
        return self.table("orders").select(
            F.floor(key / 1500).alias("patient_id"),
            (key % 1500).alias("voxel_id"),
            base.alias("true_cgy"),
            (base + F.col("o_custkey").cast("long") % 201 - 100).alias("pred_cgy"),
        )

    @cached_property
    def in_box(self) -> DataFrame:
        """Dose voxels: those with at least one matrix entry."""
        key = F.col("l_orderkey").cast("long")
        return self.table("lineitem").select(
            F.floor(key / 1500).alias("patient_id"), (key % 1500).alias("voxel_id")
        ).distinct()

    @cached_property
    def ct_voxel(self) -> DataFrame:
        """CT grid with the dose-voxel id, NULL outside the calculation box."""
        box = self.in_box.select("patient_id", "voxel_id", F.col("voxel_id").alias("dose_voxel"))
        return self.voxel.join(box, ["patient_id", "voxel_id"], "left")

    @cached_property
    def opt_voxel(self) -> DataFrame:
        """Structure members inside the calculation box with integer volume weights."""
        return self.structure_voxel.join(self.in_box, ["patient_id", "voxel_id"], "left_semi").select(
            "patient_id", "structure", "voxel_id",
            F.col("vol_u").cast("double").alias("weight"),
            (F.col("vol_u") / 1e6).alias("volume_cc"),
        )

    @cached_property
    def structure(self) -> DataFrame:
        """Volume and fraction inside the box, one row per patient and structure."""
        box = self.in_box.withColumn("hit", F.lit(1))
        return (
            self.structure_voxel.join(box, ["patient_id", "voxel_id"], "left")
            .groupBy("patient_id", "structure")
            .agg(
                (F.sum("vol_u") / 1e6).alias("volume_cc"),
                (F.count("hit") / F.count(F.lit(1))).alias("frac_in_box"),
            )
        )

    @cached_property
    def contour(self) -> DataFrame:
        """One target outline per beam, a constant ring joined to the beams present."""
        ring = [(-8.0, -1.0), (8.0, -1.0), (8.0, 9.0), (0.0, 14.0), (-8.0, 9.0)]
        points = F.array(
            *[F.struct(F.lit(i).alias("seq"), F.lit(x).alias("x_mm"), F.lit(y).alias("y_mm")) for i, (x, y) in enumerate(ring)]
        )
        return self.beamlet.select("beam_id").distinct().select(
            "beam_id", F.lit("PTV").alias("structure"), F.lit(0).alias("segment"), F.inline(points)
        )

    @cached_property
    def sized_beamlet(self) -> DataFrame:
        """Beamlets spread to 5 mm cells, with one narrow column per row."""
        short = F.col("col_idx") == 3
        return self.beamlet.select(
            "beam_id", "beamlet_id", "row_idx", "col_idx", (F.col("x_mm") * 2).alias("x_mm"),
            (F.col("y_mm") * 2 + F.when(short, 1.25).otherwise(0.0)).alias("y_mm"),
            F.lit(5.0).alias("width_mm"), F.when(short, 2.5).otherwise(5.0).alias("height_mm"),
        )

    @cached_property
    def unit_cell(self) -> DataFrame:
        """One 2.5 mm cell per beamlet on its own row and column."""
        return self.beamlet.select("beam_id", F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "beamlet_id")

    @cached_property
    def dose(self) -> DataFrame:
        from dosefold.operators.matrix import dose_from_fluence

        return dose_from_fluence(
            self.influence, self.fluence, self.voxel, plan_ids=["A", "B"], scale=0.01
        )

    @cached_property
    def structure_dose(self) -> DataFrame:
        """Dose of each structure's voxels with weights: the input of the evaluation operators."""
        return self.opt_voxel.join(self.dose, ["patient_id", "voxel_id"])


ORACLE_VIEWS = {
    "v_voxel": """
select cast(floor(o_orderkey / 1500.0) as bigint) as patient_id, cast(o_orderkey % 1500 as bigint) as voxel_id,
       cast(o_orderkey % 25 as bigint) as ix, cast(floor((o_orderkey % 500) / 25.0) as bigint) as iy,
       cast(floor((o_orderkey % 1500) / 500.0) as bigint) as iz,
       cast(floor(o_totalprice) as bigint) % 4071 - 1000 as hu,
       cast(round(o_totalprice * 100) as bigint) as vol_u,
       o_orderpriority as prio, o_orderstatus as status
from orders""",
    "v_influence": """
select cast(floor(l_orderkey / 1500.0) as bigint) as patient_id, cast(l_orderkey % 1500 as bigint) as voxel_id,
       cast(l_partkey as bigint) as beamlet_id, cast(sum(l_quantity) as bigint) as a_int
from lineitem group by 1, 2, 3""",
    "v_beamlet": """
select cast(p_partkey as bigint) as beamlet_id, cast(p_partkey % 8 as bigint) as beam_id,
       cast(floor(p_partkey / 8.0) as bigint) as local_id,
       cast(floor(p_partkey / 8.0) as bigint) % 10 as col_idx,
       cast(floor(p_partkey / 80.0) as bigint) as row_idx,
       cast((cast(floor(p_partkey / 8.0) as bigint) % 10) * 2.5 - 11.25 as double) as x_mm,
       cast(cast(floor(p_partkey / 80.0) as bigint) * 2.5 as double) as y_mm
from part""",
    "v_fluence": """
select 'A' as plan_id, cast(p_partkey as bigint) as beamlet_id, cast(p_size as bigint) as intensity from part
union all
select 'B', cast(p_partkey as bigint), cast(51 - p_size as bigint) from part""",
    "v_structure_voxel": """
select 'BODY' as structure, patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel
union all select 'PTV', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '1-URGENT'
union all select 'GTV', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '1-URGENT' and status = 'F'
union all select 'CORD', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '2-HIGH'
union all select 'HEART', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '3-MEDIUM'
union all select 'LUNG_L', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '4-NOT SPECIFIED'
union all select 'LUNG_R', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel where prio = '5-LOW'
union all select 'BOX', patient_id, voxel_id, ix, iy, iz, vol_u from v_voxel
  where ix between 8 and 14 and iy between 6 and 12""",
    "v_beam": """
select cast(s_suppkey as bigint) as beam_id, cast(s_nationkey as bigint) as patient_id,
       cast((s_suppkey * 5) % 360 as bigint) as gantry_angle,
       cast((s_nationkey % 4) * 90 as bigint) as collimator_angle,
       cast(0 as bigint) as couch_angle, case when s_nationkey % 2 = 0 then '6' else '10' end as energy_mv,
       cast(floor(s_acctbal) as double) / 10.0 as iso_x_mm, s_suppkey % 6 = 0 as is_planner
from supplier""",
    "v_scenario": """
select cast(floor(l_orderkey / 1500.0) as bigint) as patient_id, cast(l_orderkey % 1500 as bigint) as voxel_id,
       l_returnflag as scenario, cast(sum(l_quantity) as double) as dose_gy
from lineitem group by 1, 2, 3""",
    "v_predicted": """
select cast(floor(o_orderkey / 1500.0) as bigint) as patient_id, cast(o_orderkey % 1500 as bigint) as voxel_id,
       cast(floor(o_totalprice / 80.0) as bigint) as true_cgy,
       cast(floor(o_totalprice / 80.0) as bigint) + cast(o_custkey % 201 as bigint) - 100 as pred_cgy
from orders""",
    # derived views shared by the oracles
    "o_box": "select distinct patient_id, voxel_id from v_influence",
    "o_ov": """
select s.structure, s.patient_id, s.voxel_id, s.ix, s.iy, s.iz, s.vol_u
from v_structure_voxel s join o_box b on s.patient_id = b.patient_id and s.voxel_id = b.voxel_id""",
    "o_struct": """
select s.structure, s.patient_id, count(*) as n, count(b.voxel_id) as n_box,
       cast(sum(s.vol_u) as double) / 1e6 as volume_cc,
       cast(count(b.voxel_id) as double) / count(*) as frac
from v_structure_voxel s left join o_box b on s.patient_id = b.patient_id and s.voxel_id = b.voxel_id
group by 1, 2""",
    "o_dose": """
select p.plan_id, v.patient_id, v.voxel_id, cast(coalesce(d.t, 0) as double) * cast(0.01 as double) as dose_gy
from v_voxel v cross join (select distinct plan_id from v_fluence) p
left join (select f.plan_id, i.patient_id, i.voxel_id, sum(i.a_int * f.intensity) as t
           from v_influence i join v_fluence f on i.beamlet_id = f.beamlet_id group by 1, 2, 3) d
  on d.plan_id = p.plan_id and d.patient_id = v.patient_id and d.voxel_id = v.voxel_id""",
    "o_sd": """
select o.structure, o.patient_id, o.voxel_id, o.vol_u, d.plan_id, d.dose_gy
from o_ov o join o_dose d on o.patient_id = d.patient_id and o.voxel_id = d.voxel_id""",
    "o_pt": """
select structure, patient_id, plan_id, voxel_id, vol_u, dose_gy,
       coalesce(sum(vol_u) over (partition by structure, patient_id, plan_id order by dose_gy, voxel_id
                        rows between unbounded preceding and 1 preceding), 0) as below,
       sum(vol_u) over (partition by structure, patient_id, plan_id) as total
from o_sd""",
    "o_curve": """
select p.structure, p.patient_id, p.plan_id, p.voxel_id, p.dose_gy as x,
       s.frac * (1 - cast(p.below as double) / cast(p.total as double)) as y
from o_pt p join o_struct s on s.structure = p.structure and s.patient_id = p.patient_id
union all
select p.structure, p.patient_id, p.plan_id, null, max(p.dose_gy) + cast(0.01 as double), cast(0 as double)
from o_pt p group by 1, 2, 3""",
    "o_seg": """
select *, lead(x) over w as x2, lead(y) over w as y2
from o_curve
window w as (partition by structure, patient_id, plan_id order by x, y desc)""",
    "o_edges": """
select b.beam_id, e.* from (select distinct beam_id from v_beamlet) b cross join
 (values (-8.0::double,-1.0::double,8.0::double,-1.0::double),(8.0,-1.0,8.0,9.0),(8.0,9.0,0.0,14.0),(0.0,14.0,-8.0,9.0),(-8.0,9.0,-8.0,-1.0)) e(x1,y1,x2,y2)""",
    "o_bev": """
select b.* from v_beamlet b join (
  select beam_id, row_idx, min(col_idx) as c1, max(col_idx) as c2 from (
    select b.beam_id, b.row_idx, b.col_idx, b.beamlet_id,
      sum(case when (e.y1 > b.y_mm) <> (e.y2 > b.y_mm) and b.x_mm < (e.x2 - e.x1) * (b.y_mm - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 then 1 else 0 end) as crossings,
      min(pow(b.x_mm - e.x1 - u * (e.x2 - e.x1), 2) + pow(b.y_mm - e.y1 - u * (e.y2 - e.y1), 2)) as gap2
    from v_beamlet b join o_edges e using (beam_id),
    lateral (select greatest(0.0, least(1.0, ((b.x_mm - e.x1) * (e.x2 - e.x1) + (b.y_mm - e.y1) * (e.y2 - e.y1))
      / (pow(e.x2 - e.x1, 2) + pow(e.y2 - e.y1, 2)))) as u) l
    group by 1, 2, 3, 4) where crossings % 2 = 1 or gap2 < 9.0 group by 1, 2) r
 on r.beam_id = b.beam_id and r.row_idx = b.row_idx and b.col_idx between r.c1 and r.c2""",
    "o_cols": "select beam_id, beamlet_id, row_number() over (order by beam_id, beamlet_id) - 1 as column_id from o_bev",
    "o_cells": """
select b.beam_id, 2 * (m.mr - b.row_idx) + i.i as row, 2 * b.col_idx + j.j as col, b.beamlet_id
from v_beamlet b join (select beam_id, max(row_idx) as mr from v_beamlet group by 1) m using (beam_id)
cross join (values (0), (1)) i(i) cross join (values (0), (1)) j(j) where not (b.col_idx = 3 and i.i = 1)""",
    "o_vmap": """
select patient_id, voxel_id, block_id, cast(n as double) / sum(n) over (partition by patient_id, block_id) as share,
  n, sum(n) over (partition by patient_id, block_id) as total from (
  select v.patient_id, v.voxel_id, v.iz * 10000 + v.iy // 3 * 100 + v.ix // 4 as block_id, count(*) as n
  from v_voxel v join o_box b using (patient_id, voxel_id) where v.ix < 24 and v.iy < 18 group by 1, 2, 3)""",
}
