"""Dose and dose-volume evaluation.

Input of most operators is a *structure dose* table: one row per (group keys,
structure, voxel) with `dose_gy` and a volume `weight`, and a small *structure*
table with `volume_cc` and `frac_in_box` per structure.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosefold.functions.numeric import literal_structs
from dosefold.functions.prefix import exact_quantiles, ordered_by_dose, weight_curve

KEYS = ["patient_id", "plan_id", "structure"]
TERMINAL_GY = 0.01
ISODOSE_LEVELS = [0.3, 0.5, 0.7, 0.9, 1.0, 1.1]


def _with_fraction(df: DataFrame, structures: DataFrame) -> DataFrame:
    shared = [c for c in ("patient_id", "structure") if c in df.columns]
    return df.join(
        structures.select(*shared, F.coalesce("frac_in_box", F.lit(1.0)).alias("frac")), shared
    )


def dvh(sd: DataFrame, structures: DataFrame, keys: list[str] = KEYS, weighted: bool = True) -> DataFrame:
    """Cumulative dose-volume curve, one point per voxel plus the terminal zero point.

    The unweighted form counts voxels and starts at one. A structure without voxels
    has the single point (0, 0) when `structures` carries all keys.
    """
    if not weighted:
        sd = sd.withColumn("weight", F.lit(1.0))
        structures = structures.withColumn("frac_in_box", F.lit(1.0))
    ranked = _with_fraction(ordered_by_dose(sd, keys), structures)
    point = F.struct("voxel_id", F.col("dose_gy").alias("x"), (F.col("frac") * (1 - F.col("below") / F.col("total"))).alias("y"))
    last = F.struct(
        F.lit(None).cast("long").alias("voxel_id"), (F.col("top") + TERMINAL_GY).alias("x"), F.lit(0.0).alias("y")
    )
    # the first voxel of a group also emits the group's terminal point
    points = ranked.select(
        *keys, F.inline(F.when(F.col("below") == 0, F.array(point, last)).otherwise(F.array(point)))
    )
    if set(keys) <= set(structures.columns):
        empty = structures.select(*keys).join(sd.select(*keys).distinct(), keys, "left_anti").select(
            *keys, F.lit(None).cast("long").alias("voxel_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
        )
        points = points.unionByName(empty)
    return points


def curve_corners(sd: DataFrame, structures: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The same curve with tied doses folded: y at the first and at the last voxel of each dose."""
    return _with_fraction(weight_curve(sd, keys), structures).select(
        *keys, F.col("dose_gy").alias("x"), "w", "total", "frac", "top",
        (F.col("frac") * (1 - F.col("below") / F.col("total"))).alias("y_first"),
        (F.col("frac") * (1 - (F.col("below") + F.col("w") - F.col("w_last")) / F.col("total"))).alias("y_last"),
    )


CORNER = {"x", "w", "total", "frac", "top", "y_first", "y_last"}


def _dose_parts(v: Column) -> list[Column]:
    """Aggregates that bracket volume `v` (percent) on curve corners."""
    above = 100 * F.col("y_first") >= v
    return [
        F.max(F.when(above, F.col("x"))).alias("lo_x"),
        F.max_by(F.when(above, F.col("y_last")), F.when(above, F.col("x"))).alias("lo_y"),
        F.min(F.when(~above, F.col("x"))).alias("hi_x"),
        F.min_by(F.when(~above, F.col("y_first")), F.when(~above, F.col("x"))).alias("hi_y"),
    ]


def _dose_value(v: Column) -> Column:
    x2 = F.coalesce(F.col("hi_x"), F.col("top") + TERMINAL_GY)
    y1 = 100 * F.col("lo_y")
    y2 = 100 * F.coalesce(F.col("hi_y"), F.lit(0.0))
    between = F.col("lo_x") + (v - y1) * (x2 - F.col("lo_x")) / (y2 - y1)
    return (
        F.when((v > 100.1) | (v > 100 * F.col("frac")), 0.0).when(v < 0, F.col("top") + TERMINAL_GY)
        .when(v >= y1, F.col("lo_x")).otherwise(between)
    )


def _volume_parts(at: Column, x: Column) -> list[Column]:
    """Aggregates that bracket dose `at`."""
    return [
        F.coalesce(F.sum(F.when(x <= at, F.col("w"))), F.lit(0.0)).alias("upto"),
        F.min(x).alias("bottom"), F.max(F.when(x <= at, x)).alias("x1"),
        F.max_by(F.when(x <= at, F.col("w")), F.when(x <= at, x)).alias("w1"), F.min(F.when(x > at, x)).alias("x2"),
    ]


def _volume_value(at: Column) -> Column:
    y1 = F.col("frac") * (1 - (F.col("upto") - F.col("w1")) / F.col("total"))
    x2 = F.coalesce("x2", F.col("top") + TERMINAL_GY)
    y2 = F.when(F.col("x2").isNull(), 0.0).otherwise(F.col("frac") * (1 - F.col("upto") / F.col("total")))
    between = 100 * y1 + (at - F.col("x1")) * (100 * y2 - 100 * y1) / (x2 - F.col("x1"))
    return F.when(at > F.col("top") + TERMINAL_GY, 0.0).when(at < F.col("bottom"), 100 * F.col("frac")).otherwise(between)


def curve_metrics(sd: DataFrame, structures: DataFrame, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Any mix of D(v), V(d), max and mean requests from one curve and one aggregate.

    `requests`: structure (and patient_id where it matters), metric in D, V, max,
    mean, and `value`; other columns identify the request. Adds `raw`.
    """
    asked = _requests(curve_corners(_asked_only(sd, requests), structures, keys), requests, "value")
    extra = [c for c in asked.columns if c not in {*keys} | CORNER]
    v = F.col("value")
    found = asked.groupBy(*keys, *extra).agg(
        F.max("frac").alias("frac"), F.max("top").alias("top"), F.max("total").alias("total"),
        F.sum(F.col("w") * F.col("x")).alias("weighted"), *_dose_parts(v), *_volume_parts(v, F.col("x")),
    )
    raw = (
        F.when(F.col("metric") == "D", _dose_value(v)).when(F.col("metric") == "V", _volume_value(v))
        .when(F.col("metric") == "max", F.col("top"))
        .when(F.col("metric") == "mean", F.col("weighted") / F.col("total") * F.col("frac"))
    )
    return found.select(*keys, *extra, raw.alias("raw"))


def _asked_only(sd: DataFrame, values) -> DataFrame:
    """Voxels of the structures that a request table names: no curve is made of the others."""
    shared = [c for c in ("patient_id", "structure") if isinstance(values, DataFrame) and c in values.columns and c in sd.columns]
    return sd.join(values.select(*shared).distinct(), shared, "left_semi") if "structure" in shared else sd


def _requests(df: DataFrame, values, column: str) -> DataFrame:
    """Attach requested values: a literal list fans out per row, a table joins on shared columns."""
    if isinstance(values, DataFrame):
        return df.join(values, [c for c in values.columns if c in df.columns])
    return df.withColumn(column, F.explode(F.array(*[F.lit(float(v)) for v in values])))


def dose_at_volume(sd: DataFrame, structures: DataFrame, volumes, keys: list[str] = KEYS) -> DataFrame:
    """D(v): dose reached by `volume_perc` percent of the volume, linear between curve points.

    The bracketing points come from two conditional aggregates, so no window
    spans a structure.
    """
    asked = _requests(curve_corners(_asked_only(sd, volumes), structures, keys), volumes, "volume_perc")
    extra = [c for c in asked.columns if c not in {*keys} | CORNER]
    v = F.col("volume_perc")
    found = asked.groupBy(*keys, *extra).agg(F.max("frac").alias("frac"), F.max("top").alias("top"), *_dose_parts(v))
    return found.select(*keys, *extra, _dose_value(v).alias("dose_at_volume_gy"))


def volume_at_dose(sd: DataFrame, structures: DataFrame, doses, keys: list[str] = KEYS) -> DataFrame:
    """V(d): percent of the volume at `at_dose_gy` or more; pure hash aggregation, no ordering."""
    distinct = sd.groupBy(*keys, "dose_gy").agg(F.sum("weight").alias("w"))
    asked = _requests(distinct, doses, "at_dose_gy")
    extra = [c for c in asked.columns if c not in {*keys, "dose_gy", "w"}]
    at = F.col("at_dose_gy")
    found = _with_fraction(
        asked.groupBy(*keys, *extra).agg(
            F.sum("w").alias("total"), F.max("dose_gy").alias("top"), *_volume_parts(at, F.col("dose_gy"))
        ),
        structures,
    )
    return found.select(*keys, *extra, _volume_value(at).alias("volume_at_dose_perc"))


def dose_statistics(sd: DataFrame, structures: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Maximum dose and volume-weighted mean times the calc-box fraction; 0 for empty structures.

    A structure without voxels gets its zeros in every plan its patient has a dose for.
    """
    stats = sd.groupBy(*keys).agg(
        F.max("dose_gy").alias("max_dose_gy"),
        (F.sum(F.col("weight") * F.col("dose_gy")) / F.sum("weight")).alias("mean"),
    )
    shared = [c for c in keys if c in structures.columns]
    plans = sd.select(*[c for c in keys if c != "structure"]).distinct()
    every = structures.select(*shared).distinct().join(plans, [c for c in shared if c != "structure"])
    empty = every.select(*keys).join(stats, keys, "left_anti").select(*keys, F.lit(0.0).alias("max_dose_gy"), F.lit(0.0).alias("mean"))
    return _with_fraction(stats.unionByName(empty), structures).select(
        *keys, "max_dose_gy", (F.col("mean") * F.col("frac")).alias("mean_dose_gy")
    )


def conformity(grid_dose: DataFrame, target: DataFrame, threshold_gy: float, out: str = "conformity_index") -> DataFrame:
    """(V_iso and target)^2 / (V_target * V_iso) by voxel counts; NULL when either is empty."""
    hit = (F.col("dose_gy") >= threshold_gy).cast("long")
    marked = grid_dose.join(
        target.select("patient_id", "voxel_id", F.lit(1).cast("long").alias("inside")),
        ["patient_id", "voxel_id"], "left",
    )
    inside = F.coalesce("inside", F.lit(0))
    counts = marked.groupBy("patient_id", "plan_id").agg(
        F.sum(hit).alias("n_iso"), F.sum(inside).alias("n_target"), F.sum(hit * inside).alias("n_both")
    )
    denominator = F.col("n_target") * F.col("n_iso")
    return counts.select(
        "patient_id", "plan_id",
        F.when(denominator > 0, F.col("n_both") * F.col("n_both") / denominator).alias(out),
    )


def conformity_on_cells(ct: DataFrame, dose: DataFrame, target: DataFrame, threshold_gy: float, out: str = "conformity_index") -> DataFrame:
    """The same by CT cells, where several cells share a dose voxel (`voxel_id` of `ct`, NULL outside the map).

    Each dose voxel counts with its cells, and with those of them in the target;
    target cells outside the map have no dose but belong to the target.
    """
    cell = ["patient_id", "ix", "iy", "iz"]
    inside = target.select(*cell).distinct()
    shares = ct.filter(F.col("voxel_id").isNotNull()).select(*cell, "voxel_id").join(inside.withColumn("inside", F.lit(1)), cell, "left").groupBy(
        "patient_id", "voxel_id").agg(F.count(F.lit(1)).alias("n"), F.count("inside").alias("n_in"))
    hit = F.col("dose_gy") >= threshold_gy
    counts = dose.join(shares, ["patient_id", "voxel_id"]).groupBy("patient_id", "plan_id").agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("n_iso"), F.coalesce(F.sum(F.when(hit, F.col("n_in"))), F.lit(0)).alias("n_both"))
    whole = inside.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_target"))
    both = counts.join(whole, "patient_id", "left").withColumn("n_target", F.coalesce("n_target", F.lit(0)))
    denominator = F.col("n_target") * F.col("n_iso")
    return both.select("patient_id", "plan_id", F.when(denominator > 0, F.col("n_both") * F.col("n_both") / denominator).alias(out))


def homogeneity(target_dose: DataFrame) -> DataFrame:
    """(P98 - P2) / P50 of the target dose with linear percentiles."""
    p = exact_quantiles(
        target_dose, ["patient_id", "plan_id"], "dose_gy", {"p2": 0.02, "p50": 0.5, "p98": 0.98}
    )
    return p.select(
        "patient_id", "plan_id",
        F.when(F.col("p50") != 0, (F.col("p98") - F.col("p2")) / F.col("p50")).alias("homogeneity_index"),
    )


def biologically_effective_dose(dose: DataFrame, fractions: int, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    d = F.col("dose_gy") / fractions
    return dose.withColumn("bed_gy", fractions * (d + d * d / (alpha / beta)))


def normalize_dose(
    dose: DataFrame, sd: DataFrame, structures: DataFrame, prescription_gy: float,
    structure: str = "PTV", volume_perc: float = 90.0,
) -> DataFrame:
    """Scale each plan so that D(volume_perc) of `structure` equals the prescription."""
    scalar = dose_at_volume(sd.filter(F.col("structure") == structure), structures, [volume_perc]).select(
        "patient_id", "plan_id", (F.col("dose_at_volume_gy") / prescription_gy).alias("norm_factor")
    )
    return dose.join(scalar, ["patient_id", "plan_id"]).withColumn(
        "dose_norm_gy", F.when(F.col("norm_factor") != 0, F.col("dose_gy") / F.col("norm_factor"))
    )


def scaled_dvh(points: DataFrame, structures: DataFrame, prescription_gy: float) -> DataFrame:
    """DVH points in Gy and percent of prescription, percent volume and cc."""
    return points.join(
        structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"]
    ).select(
        "patient_id", "plan_id", "structure", "voxel_id", F.col("x").alias("dose_gy"),
        (F.col("x") / prescription_gy * 100).alias("dose_perc"),
        (F.col("y") * 100).alias("volume_perc"), (F.col("y") * F.col("volume_cc")).alias("volume_cc"),
    )


def robust_dvh(scenario_dose: DataFrame, structures: DataFrame) -> DataFrame:
    """Dose band over scenarios: min, max and mean dose of each rank."""
    keys = ["patient_id", "structure", "scenario"]
    ranked = ordered_by_dose(scenario_dose.withColumn("weight", F.lit(1)), keys).withColumn(
        "rank", (F.col("below") + 1).cast("long")
    )
    kept = structures.filter("frac_in_box > 0").select("patient_id", "structure")
    return (
        ranked.join(kept, ["patient_id", "structure"], "left_semi")
        .groupBy("patient_id", "structure", "rank")
        .agg(
            F.min("dose_gy").alias("dose_min_gy"), F.max("dose_gy").alias("dose_max_gy"),
            F.avg("dose_gy").alias("dose_mean_gy"),
        )
    )


def isodose_volumes(sd: DataFrame, prescription_gy: float, keys: list[str] = KEYS) -> DataFrame:
    """Volume at or above each isodose level; levels are a fixed list, so they fan out in one aggregate."""
    totals = sd.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("dose_gy") >= level * prescription_gy, F.col("volume_cc")).otherwise(0.0)).alias(f"v{i}")
            for i, level in enumerate(ISODOSE_LEVELS)
        ]
    )
    pairs = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.col(f"v{i}").alias("volume_cc"))
            for i, level in enumerate(ISODOSE_LEVELS)
        ]
    )
    return totals.select(*keys, F.inline(pairs))


def _tail_side(sd: DataFrame, requests: DataFrame, structures: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels with the weight before them on the side each request counts from."""
    asked = _with_fraction(ordered_by_dose(_asked_only(sd, requests), keys), structures).join(requests, "structure")
    share = F.col("volume_perc") / F.col("frac")
    return asked.withColumn("share_perc", share)


def low_dose_voxels(sd: DataFrame, structures: DataFrame, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Voxels that carry a dose-volume bound (requests: request_id, structure, volume_perc, bound_type).

    Upper bounds take the coldest voxels until 100-p percent of the volume, lower
    bounds the hottest until p percent; the crossing voxel is included.
    """
    t = _tail_side(sd, requests, structures, keys)
    lower = F.col("bound_type") == "lower"
    before = F.when(lower, F.col("total") - F.col("below") - F.col("weight")).otherwise(F.col("below"))
    target = F.when(lower, F.col("share_perc")).otherwise(100 - F.col("share_perc"))
    first = F.when(lower, F.col("below") + F.col("weight") >= F.col("total")).otherwise(F.col("below") <= 0)
    return t.filter(first | (before / F.col("total") * 100 < target)).select(
        "request_id", *keys, "voxel_id", "dose_gy"
    )


def tail_mean(sd: DataFrame, structures: DataFrame, requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Weighted mean of the hottest (upper) or coldest (lower) tail, at least one voxel."""
    t = _tail_side(sd, requests, structures, keys)
    lower = F.col("bound_type") == "lower"
    upto = F.when(lower, F.col("below") + F.col("weight")).otherwise(F.col("total") - F.col("below"))
    fraction = F.when(lower, 1 - F.col("share_perc") / 100).otherwise(F.col("share_perc") / 100)
    member = upto <= fraction * F.col("total")
    w = F.when(member, F.col("weight"))
    grouped = t.groupBy("request_id", *keys).agg(
        (F.sum(w * F.col("dose_gy")) / F.sum(w)).alias("mean"),
        F.max("dose_gy").alias("hot"), F.min("dose_gy").alias("cold"), F.first("bound_type").alias("bound_type"),
    )
    fallback = F.when(F.col("bound_type") == "lower", F.col("cold")).otherwise(F.col("hot"))
    return grouped.select("request_id", *keys, F.coalesce("mean", fallback).alias("tail_mean_gy"))


def dose_difference(dose: DataFrame, opt_voxels: DataFrame, first: str, second: str) -> DataFrame:
    """Per structure: largest, mean and signed mean voxel-wise difference of two plans."""
    pairs = dose.filter(F.col("plan_id").isin(first, second)).groupBy("patient_id", "voxel_id").agg(
        (
            F.max(F.when(F.col("plan_id") == second, F.col("dose_gy")))
            - F.max(F.when(F.col("plan_id") == first, F.col("dose_gy")))
        ).alias("diff_gy")
    )
    return (
        opt_voxels.join(pairs, ["patient_id", "voxel_id"])
        .groupBy("patient_id", "structure")
        .agg(
            F.max(F.abs("diff_gy")).alias("max_abs_diff_gy"), F.avg(F.abs("diff_gy")).alias("mean_abs_diff_gy"),
            F.avg("diff_gy").alias("mean_diff_gy"),
        )
    )


#: Bins to either side of a dose beyond which its sigmoid is 1 or 0, to 2e-14.
KERNEL_BINS = 32
#: Bins of dose that one task folds for a group.
BLOCK_BINS = 64


def smoothed_dvh(labelled: DataFrame, keys: list[str], n_bins: int = 351, top_gy: float = 70.0, together: list[str] | None = None) -> DataFrame:
    """Sigmoid-smoothed curve: mean of 1/(1+exp(-(d-b)/w)) over the voxels of each label.

    Bins are multiples of w, so a dose of k whole bins and a rest f gives the bin
    k + j the value 1/(1+exp(j-f)): one exp for all bins. Only the doses are
    shuffled, dealt by group and block of bins. There a task folds equal doses, then
    sums each dose's share of the bins near it to one row per bin that the block
    reaches; the bins far below a dose count it whole, by a cumulative sum over
    bins. A null dose counts as a voxel with value 0. The result is dealt by
    `together` (some of `keys`; all by default).
    """
    width = top_gy / (n_bins - 1)
    place = F.col("dose_gy") / width
    part = [*keys, "_block"]
    tasks = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = labelled.select(*keys, "dose_gy", F.floor(place / BLOCK_BINS).alias("_block")).repartition(tasks, *part)
    cells = dealt.groupBy(*part, "dose_gy").agg(F.count(F.lit(1)).alias("n")).select(
        *part, "n", F.floor(place).cast("long").alias("k"), F.exp(F.floor(place) - place).alias("_e"))
    # one step per bin near a dose, and a last one for the bins that count it whole
    steps = [(j, math.exp(j)) for j in range(-KERNEL_BINS, KERNEL_BINS + 2)]
    whole, none = F.col("j") > KERNEL_BINS, F.lit(0).cast("long")
    # bin -1, below all, takes the voxels that no bin counts whole
    far = F.when(F.col("k") > KERNEL_BINS, F.least(F.col("k") - KERNEL_BINS - 1, F.lit(n_bins - 1).cast("long"))).otherwise(F.lit(-1).cast("long"))
    reached = cells.select(*part, "n", "k", "_e", F.inline(literal_structs(["j", "w"], steps))).select(
        *part, F.when(whole, far).otherwise(F.col("k") + F.col("j")).alias("bin"),
        F.when(whole, 0.0).otherwise(F.col("n") / (1.0 + F.col("w") * F.col("_e"))).alias("near"),
        F.when(whole, F.col("n")).otherwise(none).alias("whole"),
    ).filter(F.col("bin").between(-1, n_bins - 1))
    sums = [F.sum(c).alias(c) for c in ("near", "whole")]
    folded = reached.groupBy(*part, "bin").agg(*sums).drop("_block").repartition(*(together or keys)).groupBy(*keys, "bin").agg(*sums)
    group = Window.partitionBy(*keys)
    along = group.orderBy("bin")
    after = F.sum("whole").over(group) - F.sum("whole").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = folded.select(
        *keys, F.col("bin").alias("_at"), "near", "whole", after.alias("_after"), F.sum("whole").over(group).alias("_size"),
        F.when(F.lag("bin").over(along).isNull(), F.least(F.col("bin"), none)).otherwise(F.col("bin")).alias("_from"),
        (F.coalesce(F.lead("bin").over(along), F.lit(n_bins).cast("long")) - 1).alias("_to"),
    )
    # a row stands for the empty bins up to the next one too, the first also for those before it
    every = rows.select("*", F.explode(F.sequence("_from", "_to")).alias("bin")).filter(F.col("bin") >= 0)
    here = F.col("_after") + F.col("whole")
    value = F.when(F.col("bin") == F.col("_at"), F.col("near") + here).when(F.col("bin") < F.col("_at"), here).otherwise(F.col("_after"))
    return every.select(*keys, "bin", (F.col("bin") * width).alias("bin_gy"), (value / F.col("_size")).alias("volume_frac"))


def structure_dose_summary(sd: DataFrame, structures: DataFrame, dose_gy: float = 20.0, volume_perc: float = 95.0) -> DataFrame:
    """Flagship report: max, mean, V(dose) and D(volume) per patient, plan and structure from one curve."""
    v, at = F.lit(float(volume_perc)), F.lit(float(dose_gy))
    found = curve_corners(sd, structures).groupBy(*KEYS).agg(
        F.max("frac").alias("frac"), F.max("top").alias("top"), F.max("total").alias("total"),
        F.sum(F.col("w") * F.col("x")).alias("weighted"), *_dose_parts(v), *_volume_parts(at, F.col("x")),
    )
    return found.select(
        *KEYS, F.col("top").alias("max_dose_gy"), (F.col("weighted") / F.col("total") * F.col("frac")).alias("mean_dose_gy"),
        _volume_value(at).alias("volume_at_dose_perc"), _dose_value(v).alias("dose_at_volume_gy"),
    )
