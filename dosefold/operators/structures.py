"""Structure (mask) algebra on sparse voxel tables.

A mask is (patient_id, ix, iy, iz); a structure table adds the column `structure`.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.functions import headers as hd
from dosefold.functions import runs as rl
from dosefold.functions.numeric import rows, scan_code
from dosefold.functions.prefix import running_before
from dosefold.functions.regions import label_slice, merge_labels
from dosefold.session import cut_lineage

CELL = ["patient_id", "ix", "iy", "iz"]
INFINITE_MM = 500.0


def mask_of(structures: DataFrame, name: str) -> DataFrame:
    return structures.filter(F.col("structure") == name).select(*CELL)


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*CELL).unionByName(second.select(*CELL)).distinct()


def intersect(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*CELL).join(second.select(*CELL), CELL, "left_semi")


def subtract(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(*CELL).join(second.select(*CELL), CELL, "left_anti")


def margin_steps(margin_mm: float, resolution_xyz_mm: tuple[float, float, float]) -> tuple[int, int]:
    """Kernel steps in 3-D and the half-width of the in-plane steps that follow (half-even rounding)."""
    nx, _, nz = (max(round(margin_mm / r), 1) for r in resolution_xyz_mm)
    iterations = max(1, int(nx / nz))
    steps = max(1, round(nx / iterations))
    return steps, (iterations - 1) * steps


def expand(
    mask: DataFrame, margin_mm: float, resolution_xyz_mm: tuple[float, float, float], size: tuple[int, int, int]
) -> DataFrame:
    """Grow a mask by a margin inside the grid; margin 0 keeps it."""
    if margin_mm < 0:
        raise ValueError(f"Invalid margin {margin_mm}")
    if margin_mm == 0:
        return mask.select(*CELL)
    k, m = margin_steps(margin_mm, resolution_xyz_mm)
    keys = ["patient_id"]
    if k >= max(size):  # steps reach every cell from any: the whole grid of each patient with a mask
        return whole_grid(mask, size)
    grown = rl.to_runs(mask, keys)
    for step in rl.passes(k):
        grown = rl.dilate(grown, keys, rl.ball(step), size)
    for step in rl.passes(m):
        grown = rl.dilate(grown, keys, rl.flat(step), size)
    return rl.to_voxels(grown, keys).select(*CELL)


def whole_grid(mask: DataFrame, size: tuple[int, int, int]) -> DataFrame:
    """Every cell of the grid for each patient that has a cell of the mask."""
    nx, ny, nz = size
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    owners = mask.select("patient_id").distinct()
    return owners.select("patient_id", axis(nz).alias("iz")).select("*", axis(ny).alias("iy")).select("*", axis(nx).alias("ix")).select(*CELL)


def shrink(
    mask: DataFrame, margin_mm: float, resolution_xyz_mm: tuple[float, float, float], size: tuple[int, int, int] | None = None
) -> DataFrame:
    """Erode a mask by the same step rule; cells beyond the grid count as empty, so a margin as long as the grid leaves nothing."""
    k, m = margin_steps(margin_mm, resolution_xyz_mm)
    keys = ["patient_id"]
    if size is not None and k >= max(size):
        return mask.select(*CELL).limit(0)
    left = rl.to_runs(mask, keys)
    for step in rl.passes(k):
        left = rl.erode(left, keys, rl.ball(step))
    for step in rl.passes(m):
        left = rl.erode(left, keys, rl.flat(step))
    return rl.to_voxels(left, keys).select(*CELL)


TOKEN = re.compile(r"\s*(?:([A-Za-z0-9][A-Za-z0-9\-_.$^]*)|([+\-|&()]))")


def _tokens(expression: str) -> list[str]:
    found, at = [], 0
    text = expression.strip()
    while at < len(text):
        hit = TOKEN.match(text, at)
        if not hit:
            raise ValueError(f"cannot read expression {expression!r}")
        found.append(hit.group(1) or hit.group(2))
        at = hit.end()
    return found


def expression_names(expression: str) -> list[str]:
    return sorted({
        t for t in _tokens(expression) if t not in "+-|&()" and t != "inf" and not re.fullmatch(r"[0-9.]+", t)
    })


def evaluate_expression(
    structures: DataFrame, expression: str, resolution_xyz_mm: tuple[float, float, float] | None = None, size: tuple[int, int, int] | None = None,
    headers: DataFrame | None = None,
) -> DataFrame:
    """Fold a structure expression strictly left to right into one lazy mask plan.

    `+ number` grows, `- number` shrinks (`inf` is 500 mm); `+ - & |` on names are
    union, difference, intersection, union. A minus inside a name needs no spaces.
    With `headers` each patient's margins follow its own spacing and size.
    """
    tokens = _tokens(expression)

    def grown(mask: DataFrame, margin: float) -> DataFrame:
        return expand(mask, margin, resolution_xyz_mm, size) if headers is None else hd.expand(mask, margin, headers)

    def shrunk(mask: DataFrame, margin: float) -> DataFrame:
        return shrink(mask, margin, resolution_xyz_mm, size) if headers is None else hd.shrink(mask, margin, headers)

    def operand(at: int):
        token = tokens[at]
        if token == "(":
            value, after = fold(at + 1)
            return value, after + 1
        if token == "inf":
            return INFINITE_MM, at + 1
        if re.fullmatch(r"[0-9.]+", token):
            return float(token), at + 1
        return mask_of(structures, token), at + 1

    def fold(at: int):
        value, at = operand(at)
        while at < len(tokens) and tokens[at] != ")":
            sign = tokens[at]
            right, at = operand(at + 1)
            if isinstance(right, float):
                if sign == "+":
                    value = grown(value, right)
                elif sign == "-":
                    value = shrunk(value, right)
                else:
                    raise ValueError(f"{sign} needs a structure on its right")
            elif sign in "+|":
                value = union(value, right)
            elif sign == "-":
                value = subtract(value, right)
            else:
                value = intersect(value, right)
        return value, at

    return fold(0)[0]


def optimization_structures(
    structures: DataFrame, definitions: list[tuple[str, str]], resolution_xyz_mm=None, size=None, headers: DataFrame | None = None
) -> DataFrame:
    """New structures from definitions, clipped to BODY.

    Definitions are taken in order: each may use the structures that earlier ones
    made. A definition is skipped for patients that already have the name (from an
    earlier definition too) or lack one of the structures it mentions, and
    altogether when it cannot be read. A made structure that is used again is
    written to the checkpoint folder once.
    """
    given = structures.select("patient_id", "structure").distinct()
    made: dict[str, DataFrame] = {}
    owners: dict[str, DataFrame] = {}
    cut: set[str] = set()
    for name, definition in definitions:
        try:
            needed = sorted({*expression_names(definition), "BODY"})
            for used in needed:
                if used in made and used not in cut:
                    made[used], owners[used] = cut_lineage(made[used]), cut_lineage(owners[used])
                    cut.add(used)
            there, source = given, structures.select("structure", *CELL)
            for used in needed:
                if used in made:
                    there = there.unionByName(owners[used])
                    source = source.unionByName(made[used])
            mask = evaluate_expression(source, definition, resolution_xyz_mm, size, headers)
        except (ValueError, IndexError):
            continue
        able = (
            there.filter(F.col("structure").isin(needed)).groupBy("patient_id").agg(F.count_distinct("structure").alias("n"))
            .filter(F.col("n") == len(needed)).select("patient_id")
        )
        taken = given.filter(F.col("structure") == name).select("patient_id")
        if name in owners:
            taken = taken.unionByName(owners[name].select("patient_id"))
        own = able.join(taken, "patient_id", "left_anti")
        cells = intersect(mask, mask_of(source, "BODY")).join(own, "patient_id", "left_semi").select(F.lit(name).alias("structure"), *CELL)
        own = own.select("patient_id", F.lit(name).alias("structure"))
        cut.discard(name)
        made[name] = made[name].unionByName(cells) if name in made else cells
        owners[name] = owners[name].unionByName(own) if name in owners else own
    if not made:
        return structures.select("structure", *CELL).limit(0)
    return reduce(DataFrame.unionByName, made.values())


def structure_volume(structures: DataFrame, ct: DataFrame, voxel_volume_mm3: float) -> DataFrame:
    """Volume in cc and fraction inside the calculation box (0 when empty).

    `ct` holds `voxel_id`, NULL outside the box.
    """
    return (
        structures.select("structure", *CELL).join(ct.select(*CELL, "voxel_id"), CELL, "left")
        .groupBy("patient_id", "structure")
        .agg(F.count(F.lit(1)).alias("n"), F.count("voxel_id").alias("inside"))
        .select(
            "patient_id", "structure", (F.col("n") * voxel_volume_mm3 / 1000).alias("volume_cc"),
            (F.col("inside") / F.col("n")).alias("frac_in_box"),
        )
    )


def structure_opt_voxels(
    structures: DataFrame, ct: DataFrame, voxel_volume_mm3: float, include_zero: bool = False
) -> DataFrame:
    """Dose voxels of each structure weighed by their CT cells in cc; voxel 0 only on request."""
    mapped = ct.filter(F.col("voxel_id").isNotNull())
    if not include_zero:
        mapped = mapped.filter("voxel_id > 0")
    return (
        structures.select("structure", *CELL).join(mapped.select(*CELL, "voxel_id"), CELL)
        .groupBy("patient_id", "structure", "voxel_id")
        .agg((F.count(F.lit(1)) * voxel_volume_mm3 / 1000).alias("volume_cc"))
    )


def drop_structures(structures: DataFrame, names: list[str]) -> DataFrame:
    return structures.filter(~F.col("structure").isin(names))


def resolve_names(requests: DataFrame, structures: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Actual structure name per patient and requested name, case-insensitive with aliases; NULL if absent."""
    request = F.upper("requested")
    wanted = F.coalesce(_alias(request, aliases), request)
    known = structures.select("patient_id", "structure").distinct().withColumn("_key", F.upper("structure"))
    first = known.groupBy("patient_id", "_key").agg(F.min("structure").alias("actual"))
    return requests.withColumn("_key", wanted).join(first, ["patient_id", "_key"], "left").drop("_key")


def _alias(name: Column, aliases: dict[str, str]) -> Column:
    if not aliases:
        return F.lit(None).cast("string")
    pairs = [F.lit(part) for pair in aliases.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def derived_structure(structures: DataFrame, own: str, parts: list[str], minus: str | None = None) -> DataFrame:
    """A structure under its own name where a patient has it, else the union of parts less `minus`."""
    has_own = structures.filter(F.col("structure") == own).select("patient_id").distinct()
    built = structures.filter(F.col("structure").isin(parts)).select(*CELL).distinct()
    if minus is not None:
        built = subtract(built, mask_of(structures, minus))
    return mask_of(structures, own).unionByName(built.join(has_own, "patient_id", "left_anti"))


def label_map(structures: DataFrame, ordered: list[tuple[str, int]], target: str = "PTV") -> DataFrame:
    """One organ label per cell, later organs overwrite earlier ones; the target has its own channel."""
    order = rows(
        structures.sparkSession, "structure string, label long, priority long",
        [(name, label, place) for place, (name, label) in enumerate(ordered)],
    )
    labels = structures.join(F.broadcast(order), "structure", "left").filter(
        F.col("label").isNotNull() | (F.col("structure") == target)
    )
    return labels.groupBy(*CELL).agg(
        F.coalesce(F.max_by("label", "priority"), F.lit(0)).alias("label"),
        F.max((F.col("structure") == target).cast("long")).alias("target"),
    )


def voxel_membership(structures: DataFrame, ct: DataFrame, centers: DataFrame) -> DataFrame:
    """Names of all structures that hold a dose voxel, with the voxel centre."""
    members = structures.select("structure", *CELL).join(
        ct.filter(F.col("voxel_id").isNotNull()).select(*CELL, "voxel_id"), CELL
    )
    named = members.groupBy("patient_id", "voxel_id").agg(
        F.array_join(F.array_sort(F.collect_set("structure")), ",").alias("structures")
    )
    return centers.join(named, ["patient_id", "voxel_id"], "left")


def boundary_voxels(structures: DataFrame) -> DataFrame:
    """Mask cells with a face neighbour outside the mask."""
    keys = ["patient_id", "structure"]
    mask = structures.select("structure", *CELL)
    inner = rl.to_voxels(rl.erode(rl.to_runs(mask, keys), keys, rl.FACES), keys)
    return mask.join(inner, ["structure", *CELL], "left_anti")


#: Slices of the first slabs; each level of slabs holds so many of the level before.
SLAB = 32


def connected_regions(structures: DataFrame) -> DataFrame:
    """Face-connected regions of each mask, numbered in scan order of their first cell.

    Runs of a slice are joined into parts in one task (a slice is bounded by the
    scanner). From then on only parts and the pairs of them that touch across a
    slice border count: pairs inside a slab of SLAB slices are merged by one task
    per slab, then those inside slabs of SLAB slabs, and so on. So the graph
    shrinks at each level, and the number of levels is the logarithm of the
    slices, whatever the shape of a region.
    """
    keys = ["patient_id", "structure"]
    runs = rl.to_runs(structures, keys).withColumn("node", scan_code(F.col("iz"), F.col("iy"), F.col("x1")))
    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    typed = [f"{c} {kinds[c]}" for c in [*keys, "iz", "iy", "x1", "x2", "node"]]
    shaped = runs.select(*keys, "iz", "iy", "x1", "x2", "node")
    labelled = cut_lineage(shaped.groupBy(*keys, "iz").applyInArrow(label_slice, ", ".join([*typed, "label long"])))
    below = labelled.select(*keys, (F.col("iz") - 1).alias("iz"), "iy", F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("label").alias("b"))
    edges = cut_lineage(labelled.join(below, [*keys, "iz", "iy"]).filter("x1 <= u2 AND x2 >= u1").select(*keys, "iz", F.col("label").alias("a"), "b").distinct())
    last = edges.agg(F.max("iz")).first()[0]
    label_kinds = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "label long", "root long"])
    named, slab = labelled.withColumnRenamed("label", "region_node"), 1
    while last is not None and last + 1 >= slab:
        slab *= SLAB
        inside = F.floor(F.col("iz") / slab) == F.floor((F.col("iz") + 1) / slab)
        marked = edges.filter(inside).select(*keys, F.floor(F.col("iz") / slab).alias("_slab"), "a", "b")
        merged = cut_lineage(
            marked.groupBy(*keys, "_slab").applyInArrow(_merge_only(keys), label_kinds)
        )
        named = _renamed(named, merged, keys, "region_node")
        edges = _renamed(_renamed(edges.filter(~inside), merged, keys, "a"), merged, keys, "b").distinct()
        if last + 1 >= slab:
            edges = cut_lineage(edges)
    named = cut_lineage(named)
    regions = named.select(*keys, F.col("region_node").alias("label")).distinct().withColumn("_one", F.lit(1))
    numbered = running_before(regions, keys, F.shiftright("label", 30), ["label"], "_one", "number").select(
        *keys, F.col("label").alias("region_node"), (F.col("number") + 1).cast("long").alias("region")
    )
    return rl.to_voxels(named.join(numbered, [*keys, "region_node"]), [*keys, "region"])


def _merge_only(keys: list[str]):
    return lambda table: merge_labels(table.select([*keys, "a", "b"]))


def _renamed(df: DataFrame, merged: DataFrame, keys: list[str], column: str) -> DataFrame:
    """`column` replaced by the root of its label, where it has one."""
    roots = merged.select(*keys, F.col("label").alias(column), "root")
    return df.join(roots, [*keys, column], "left").withColumn(column, F.coalesce("root", column)).drop("root")
