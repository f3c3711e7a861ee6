"""Clinical criteria and scorecards as long tables.

A criteria table has one row per limit or goal: patient_id, criterion_id, type,
structure, parameters (dose_value, dose_unit, volume_value, volume_unit, coldest),
bound_key such as `limit_dose_gy`, bound_value as text, bound_type and weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosefold.functions.salted import salted_join
from dosefold.operators import evaluation as ev

FORMULA = r"^\s*([0-9]*\.?[0-9]+)\s*\*\s*prescription_gy\s*$"
NUMBER = r"^\s*[-+]?[0-9]*\.?[0-9]+\s*$"
PARAMETERS = ["structure", "dose_value", "dose_unit", "volume_value", "volume_unit", "coldest"]
DEFAULT_WEIGHT = 5.0


def number_or_formula(text: Column, prescription_gy: float | Column) -> Column:
    """A number, or `factor*prescription_gy`; any other text is NULL. Nothing is evaluated."""
    rx = prescription_gy if isinstance(prescription_gy, Column) else F.lit(float(prescription_gy))
    return (
        F.when(text.rlike(NUMBER), text.try_cast("double"))
        .when(F.trim(text) == "prescription_gy", rx)
        .when(text.rlike(FORMULA), F.regexp_extract(text, FORMULA, 1).try_cast("double") * rx)
    )


def resolve_bound(criteria: DataFrame, prescription_gy: float) -> DataFrame:
    """`bound_gy` for dose bounds: formulas and Gy as they are, percent of prescription scaled."""
    text = F.col("bound_value")
    value = number_or_formula(text, prescription_gy)
    formula = text.contains("prescription_gy")
    return criteria.withColumn(
        "bound_gy",
        F.when(formula | F.col("bound_key").contains("gy"), value)
        .when(F.col("bound_key").contains("dose_perc"), value * prescription_gy / 100),
    )


def criteria_list(criteria: DataFrame, prescription_gy: float, kind: str | None = None) -> DataFrame:
    """Bounds that are usable: not negative and a number or prescription formula.

    Only max_dose and mean_dose can be asked for by type; a criterion without a
    usable bound disappears with its rows.
    """
    if kind is not None:
        criteria = criteria.filter((F.col("type") == kind) & F.col("type").isin("max_dose", "mean_dose"))
    return criteria.filter(number_or_formula(F.col("bound_value"), prescription_gy) >= 0)


def _identity(df: DataFrame) -> DataFrame:
    return df.withColumn("_same", F.to_json(F.struct("type", *PARAMETERS)))


def criterion_upsert(criteria: DataFrame, updates: DataFrame) -> DataFrame:
    """Change bounds of criteria that exist, append those that do not.

    A criterion exists when type, parameters and one bound key agree; then only
    keys it already has are changed.
    """
    old, new = _identity(criteria), _identity(updates)
    keys = ["patient_id", "_same", "bound_key"]
    changed = old.join(new.select(*keys, F.col("bound_value").alias("_new")), keys, "left").withColumn(
        "bound_value", F.coalesce("_new", "bound_value")
    )
    known = new.join(old.select(*keys), keys, "left_semi").select("patient_id", "_same").distinct()
    added = new.join(known, ["patient_id", "_same"], "left_anti")
    return changed.select(*criteria.columns).unionByName(added.select(*criteria.columns))


def to_gy_and_percent(criteria: DataFrame, structures: DataFrame, prescription_gy: float) -> DataFrame:
    """Dose-volume criteria with doses in Gy and volumes in percent, cold volumes complemented."""
    df = criteria.filter(F.col("type").isin("dose_volume_V", "dose_volume_D")).join(
        structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"]
    )
    is_d = F.col("type") == "dose_volume_D"
    value = number_or_formula(F.col("bound_value"), prescription_gy)
    key = F.col("bound_key")
    formula = F.col("bound_value").contains("prescription_gy")
    bound = (
        F.when(formula, value)
        .when(is_d & key.contains("perc"), value / 100 * prescription_gy)
        .when(~is_d & key.contains("volume_cc"), value / F.col("volume_cc") * 100)
        .otherwise(value)
    )
    dose = F.when(F.col("dose_unit") == "perc", F.col("dose_value") / 100 * prescription_gy).otherwise(F.col("dose_value"))
    volume = F.when(F.col("volume_unit") == "cc", F.col("volume_value") / F.col("volume_cc") * 100).otherwise(F.col("volume_value"))
    cold = F.coalesce("coldest", F.lit(False))
    return df.select(
        "patient_id", "criterion_id", "type", "structure", "bound_type", "weight",
        F.when(is_d, F.regexp_replace(key, "perc", "gy")).otherwise(F.regexp_replace(key, "volume_cc", "volume_perc")).alias("bound_key"),
        F.when(~is_d & cold, 100 - bound).otherwise(bound).alias("bound"),
        F.when(~is_d, dose).alias("dose_gy"),
        F.when(is_d, F.when(cold, 100 - volume).otherwise(volume)).alias("volume_perc"),
    )


def cold_to_hot(criteria: DataFrame, structures: DataFrame, prescription_gy: float) -> DataFrame:
    """Complement cold volumes in their own unit, so the hot-volume rules apply; others unchanged."""
    df = criteria.join(structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"], "left")
    cold = F.coalesce("coldest", F.lit(False))
    value = number_or_formula(F.col("bound_value"), prescription_gy)
    is_v, is_d = F.col("type") == "dose_volume_V", F.col("type") == "dose_volume_D"
    bound = (
        F.when(cold & is_v & F.col("bound_key").contains("volume_perc"), 100 - value)
        .when(cold & is_v & F.col("bound_key").contains("volume_cc") & (F.col("volume_cc") > 0), F.col("volume_cc") - value)
        .otherwise(value)
    )
    volume = (
        F.when(cold & is_d & (F.col("volume_unit") == "perc"), 100 - F.col("volume_value"))
        .when(cold & is_d & (F.col("volume_unit") == "cc") & (F.col("volume_cc") > 0), F.col("volume_cc") - F.col("volume_value"))
        .otherwise(F.col("volume_value"))
    )
    return df.withColumn("bound", bound).withColumn("volume_value", volume)


def dvh_table(
    criteria: DataFrame, structures: DataFrame, prescription_gy: float, overrides: DataFrame | None = None
) -> DataFrame:
    """One row per usable limit (constraint) and goal of dose-volume criteria.

    Overrides replace a criterion that exists and are appended otherwise.
    Structures that are missing or have no voxels give no row.
    """
    if overrides is not None:
        old, new = _identity(criteria), _identity(overrides)
        keys = ["patient_id", "_same"]
        hit = new.join(old.select(*keys, "bound_key"), [*keys, "bound_key"], "left_semi").select(*keys).distinct()
        criteria = old.join(hit, keys, "left_anti").drop("_same").unionByName(new.drop("_same"))
    present = structures.filter("frac_in_box > 0")
    usable = criteria_list(criteria, prescription_gy)
    table = to_gy_and_percent(usable, present, prescription_gy)
    is_d = F.col("type") == "dose_volume_D"
    goal = F.col("bound_key").startswith("goal")
    return table.select(
        "patient_id", "criterion_id", "structure",
        F.when(is_d, F.col("bound")).otherwise(F.col("dose_gy")).alias("dose_gy"),
        F.when(is_d, F.col("volume_perc")).otherwise(F.col("bound")).alias("volume_perc"),
        F.when(goal, "goal").otherwise("constraint").alias("dvh_type"),
        F.coalesce("bound_type", F.lit("upper")).alias("bound_type"),
        F.when(goal, F.coalesce("weight", F.lit(DEFAULT_WEIGHT))).alias("weight"),
    )


def max_tolerance(table: DataFrame, criteria: DataFrame, prescription_gy: float) -> DataFrame:
    """Largest max-dose limit of the structure or of `name_...` variants, else 1.5 times the prescription."""
    limits = resolve_bound(
        criteria_list(criteria.filter((F.col("type") == "max_dose") & F.col("bound_key").startswith("limit")), prescription_gy),
        prescription_gy,
    ).select("patient_id", F.col("structure").alias("name"), "bound_gy")
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "_"))
    by_prefix = limits.select("patient_id", F.explode(prefixes).alias("structure"), "bound_gy").groupBy(
        "patient_id", "structure").agg(F.max("bound_gy").alias("found"))
    return table.join(by_prefix, ["patient_id", "structure"], "left").withColumn(
        "max_tol_gy", F.coalesce("found", F.lit(1.5 * prescription_gy))
    ).drop("found")


def dvh_table_filter(table: DataFrame, structures: DataFrame) -> DataFrame:
    """Drop rows whose volume over the calc-box fraction is at least 100 or at most 0."""
    share = F.col("volume_perc") / F.col("frac_in_box")
    return (
        table.join(structures.select("patient_id", "structure", "frac_in_box"), ["patient_id", "structure"])
        .filter((share < 100) & (share > 0)).drop("frac_in_box")
    )


def round2(value: Column) -> Column:
    return F.rint(value * 100) / 100


def criteria_report(
    criteria: DataFrame, sd: DataFrame, structures: DataFrame, prescription_gy: float, plans: list[str]
) -> DataFrame:
    """One row per criterion with limit and goal text and one value column per plan.

    Each metric answers all its criteria in one pass over the dose table.
    """
    usable = cold_to_hot(criteria_list(criteria, prescription_gy), structures, prescription_gy)
    unit = F.when(F.col("bound_key").endswith("gy") | F.col("bound_value").contains("prescription_gy"), "Gy").when(
        F.col("bound_key").endswith("cc"), "cc").otherwise("%")
    text = F.concat(round2(F.col("bound")).cast("string"), unit)
    # parameters are the same on every row of a criterion
    listed = usable.groupBy("patient_id", "criterion_id", "type", "structure", "dose_value", "dose_unit", "volume_value", "volume_unit").agg(
        F.max(F.when(F.col("bound_key").startswith("limit"), text)).alias("limit"),
        F.max(F.when(F.col("bound_key").startswith("goal"), text)).alias("goal"),
        F.max(F.when(F.col("bound_key").startswith("limit"), F.col("bound"))).alias("limit_value"),
        F.max(F.when(F.col("bound_key").startswith("goal"), F.col("bound"))).alias("goal_value"),
    ).join(structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"])
    rx = prescription_gy
    dose_gy = F.when(F.col("dose_unit") == "perc", F.col("dose_value") * rx / 100).otherwise(F.col("dose_value"))
    volume_perc = F.when(F.col("volume_unit") == "cc", F.col("volume_value") / F.col("volume_cc") * 100).otherwise(F.col("volume_value"))
    key = ["patient_id", "structure", "criterion_id"]
    metric = (
        F.when(F.col("type") == "dose_volume_V", "V").when(F.col("type") == "dose_volume_D", "D")
        .when(F.col("type") == "max_dose", "max").when(F.col("type") == "mean_dose", "mean")
    )
    asked = listed.select(*key, metric.alias("metric"), F.when(metric == "V", dose_gy).otherwise(volume_perc).alias("value"))
    values = ev.curve_metrics(sd, structures, asked.filter("metric IS NOT NULL")).select(*key, "plan_id", "raw")
    first = F.coalesce("limit", "goal")
    is_v = F.col("type") == "dose_volume_V"
    shown = (
        F.when(is_v & first.endswith("cc"), F.col("raw") * F.col("volume_cc") / 100)
        .when(~is_v & first.endswith("%"), F.col("raw") / rx * 100)
        .otherwise(F.col("raw"))
    )
    unit_of = F.when(F.col("dose_unit") == "perc", "%").otherwise("Gy")
    vol_unit = F.when(F.col("volume_unit") == "cc", "cc").otherwise("%")
    label = (
        F.when(F.col("type") == "max_dose", "Max Dose").when(F.col("type") == "mean_dose", "Mean Dose")
        .when(is_v, F.concat(F.lit("V("), round2(F.col("dose_value")).cast("string"), unit_of, F.lit(")")))
        .otherwise(F.concat(F.lit("D("), round2(F.col("volume_value")).cast("string"), vol_unit, F.lit(")")))
    )
    wide = (
        values.join(listed, key).withColumn("shown", round2(shown)).withColumn("constraint", label)
        .groupBy("patient_id", "criterion_id", "constraint", "structure", "limit", "goal", "limit_value", "goal_value")
        .pivot("plan_id", plans).agg(F.first("shown"))
    )
    return wide.dropna(subset=plans)


def criteria_status(report: DataFrame, plans: list[str]) -> DataFrame:
    """green / orange / red per criterion and plan; limit below goal means a lower bound."""
    pairs = F.array(*[F.struct(F.lit(p).alias("plan_id"), F.col(p).alias("value")) for p in plans])
    v, limit, goal = F.col("value"), F.col("limit_value"), F.col("goal_value")
    lower = limit < goal
    status = (
        F.when(limit.isNotNull() & goal.isNotNull() & lower, F.when(v < limit, "red").when(v < goal, "orange").otherwise("green"))
        .when(limit.isNotNull() & goal.isNotNull(), F.when(v <= goal, "green").when(v <= limit, "orange").otherwise("red"))
        .when(goal.isNotNull(), F.when(v <= goal, "green").otherwise("orange"))
        .when(limit.isNotNull(), F.when(v <= limit, "green").otherwise("red"))
        .otherwise("grey")
    )
    return report.select("*", F.inline(pairs)).withColumn("status", status)


def interpolate_score(value: Column, points: Column) -> Column:
    """Piecewise linear score through sorted points (x, score), clamped at both ends; NULL stays NULL."""
    ordered = F.array_sort(points)
    under = F.filter(ordered, lambda p: p["x"] <= value)
    over = F.filter(ordered, lambda p: p["x"] > value)
    a, b = F.try_element_at(under, F.lit(-1)), F.try_element_at(over, F.lit(1))
    return (
        F.when(value.isNull(), F.lit(None).cast("double"))
        .when(F.size(under) == 0, F.element_at(ordered, 1)["score"])
        .when(F.size(over) == 0, F.element_at(ordered, -1)["score"])
        .otherwise(a["score"] + (value - a["x"]) * (b["score"] - a["score"]) / (b["x"] - a["x"]))
    )


def score_metrics(
    items: DataFrame, sd: DataFrame, grid_dose: DataFrame, members: DataFrame, structures: DataFrame, prescription_gy: float,
    plan_ids: list[str], ct: DataFrame | None = None,
) -> DataFrame:
    """Metric value and status of each scorecard item and plan.

    The conformation number counts dose voxels, or with `ct` (CT cells with their
    voxel_id, NULL outside the map) CT cells; `members` then has the cells too.

    Items are keyed by patient with `structure` already resolved (NULL if absent):
    patient_id, item_id, structure, metric, input_value, input_unit, points.
    """
    base = items.withColumn("plan_id", F.explode(F.array(*[F.lit(p) for p in plan_ids]))).join(
        structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"], "left"
    )
    found = items.filter(F.col("structure").isNotNull()).join(
        structures.select("patient_id", "structure", "volume_cc"), ["patient_id", "structure"]
    )
    key = ["patient_id", "structure", "item_id"]
    percent = F.when(F.col("metric").isin("DoseAtSubVolume") | (F.col("input_unit") == "CC"),
                     100.0 * F.col("input_value") / F.col("volume_cc")).otherwise(F.col("input_value"))
    unit_ok = (F.col("metric") == "DoseAtSubVolume") | F.col("input_unit").isin("%", "CC")
    kind = (
        F.when(F.col("metric").isin("DoseAtVolume", "DoseAtSubVolume") & unit_ok, "D").when(F.col("metric") == "VolumeAtDose", "V")
        .when(F.col("metric") == "MeanDose", "mean")
    )
    asked = found.select(*key, kind.alias("kind"), F.when(kind == "D", percent).otherwise(F.col("input_value")).alias("value"))
    curve = ev.curve_metrics(
        sd, structures, asked.filter("kind IS NOT NULL").withColumnRenamed("kind", "metric")
    ).select(*key, "plan_id", "raw")
    asked_c = found.filter("metric = 'ConformationNumber'").select(*key, F.col("input_value").alias("ri"))
    hit = (F.col("dose_gy") >= F.col("ri")).cast("long")
    if ct is None:
        weighed, covered = grid_dose.withColumn("_n", F.lit(1)), members.withColumn("_n", F.lit(1))
        sizes = None
    else:
        cell = ["patient_id", "ix", "iy", "iz"]
        mapped = ct.filter(F.col("voxel_id").isNotNull()).select(*cell, "voxel_id")
        weighed = grid_dose.join(mapped.groupBy("patient_id", "voxel_id").agg(F.count(F.lit(1)).alias("_n")), ["patient_id", "voxel_id"])
        own = members.join(asked_c.select("patient_id", "structure").distinct(), ["patient_id", "structure"], "left_semi").select("structure", *cell).distinct()
        covered = own.join(mapped, cell).groupBy("patient_id", "structure", "voxel_id").agg(F.count(F.lit(1)).alias("_n"))
        sizes = own.groupBy("patient_id", "structure").agg(F.count(F.lit(1)).alias("tv"))
    iso = salted_join(weighed, asked_c, ["patient_id"], ["voxel_id"]).groupBy(*key, "plan_id").agg(F.sum(hit * F.col("_n")).alias("v_ri"))
    inside = salted_join(covered, asked_c, ["patient_id", "structure"], ["voxel_id"]).join(grid_dose, ["patient_id", "voxel_id"]).groupBy(
        *key, "plan_id").agg(F.sum("_n").alias("tv"), F.sum(hit * F.col("_n")).alias("tv_ri"))
    if sizes is not None:
        inside = inside.drop("tv").join(sizes, ["patient_id", "structure"])
    cn = iso.join(inside, [*key, "plan_id"]).select(
        *key, "plan_id",
        F.when((F.col("tv") > 0) & (F.col("v_ri") > 0), F.col("tv_ri") * F.col("tv_ri") / (F.col("tv") * F.col("v_ri"))).alias("raw"),
    )
    values = curve.unionByName(cn)
    known = ["VolumeAtDose", "DoseAtVolume", "MeanDose", "DoseAtSubVolume", "ConformationNumber"]
    status = (
        F.when(F.col("structure").isNull(), "missing_structure")
        .when(~F.col("metric").isin(known), F.concat(F.lit("unsupported_metric:"), F.col("metric")))
        .when((F.col("metric") == "DoseAtVolume") & ~F.coalesce(F.col("input_unit").isin("%", "CC"), F.lit(False)), "metric_error")
        .otherwise("ok")
    )
    value = F.when(F.col("metric") == "DoseAtSubVolume", 100.0 * F.col("raw") / prescription_gy).otherwise(F.col("raw"))
    scored = base.join(values, [*key, "plan_id"], "left").withColumn("status", status)
    return scored.withColumn("metric_value", F.when(F.col("status") == "ok", value)).withColumn(
        "score", interpolate_score(F.col("metric_value"), F.col("points"))
    ).drop("raw", "volume_cc")


def total_score(scored: DataFrame) -> DataFrame:
    return scored.groupBy("patient_id", "plan_id").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total_score"))


def rescale_scorecard(items: DataFrame, old_rx: float, new_rx: float) -> DataFrame:
    """Move Gy inputs and Gy score points to another prescription, each scaled once."""
    ratio = new_rx / old_rx
    gy_input = F.coalesce(F.col("input_unit") == "Gy", F.lit(False))
    return items.withColumn(
        "input_value", F.when(gy_input, F.col("input_value") * ratio).otherwise(F.col("input_value"))
    ).withColumn(
        "points",
        F.when(
            F.col("output_unit") == "Gy",
            F.transform("points", lambda p: F.struct((p["x"] * ratio).alias("x"), p["score"].alias("score"))),
        ).otherwise(F.col("points")),
    )


def constraint_violation(
    sd: DataFrame, structures: DataFrame, limits: DataFrame, distance_limits: DataFrame, dose: DataFrame, threshold_gy: float
) -> DataFrame:
    """Worst excess per plan over max, mean and distance limits.

    `limits`: structure, kind (max or mean), limit_gy; `distance_limits`: limit per voxel.
    """
    stats = ev.dose_statistics(sd, structures).join(
        structures.select("patient_id", "structure", "frac_in_box"), ["patient_id", "structure"]
    ).join(limits, "structure")
    mean = F.col("mean_dose_gy") / F.col("frac_in_box")
    excess = F.when(F.col("kind") == "max", F.col("max_dose_gy") - F.col("limit_gy")).otherwise(
        mean - F.col("limit_gy") / F.col("frac_in_box")
    )
    by_structure = stats.select("patient_id", "plan_id", F.col("kind"), excess.alias("excess"))
    far = dose.join(distance_limits, ["patient_id", "voxel_id"]).select(
        "patient_id", "plan_id", F.lit("distance").alias("kind"), (F.col("dose_gy") - F.col("limit_gy")).alias("excess")
    )
    return by_structure.unionByName(far).groupBy("patient_id", "plan_id", "kind").agg(
        F.greatest(F.max("excess"), F.lit(0.0)).alias("worst_excess_gy")
    ).withColumn("violated", F.col("worst_excess_gy") > threshold_gy)


def max_dose_vector(opt_voxels: DataFrame, limits: DataFrame, fractions: int) -> DataFrame:
    """Tightest per-fraction max-dose limit of each voxel; GTV and CTV limits are not applied."""
    used = limits.filter((F.col("kind") == "max") & ~F.col("structure").isin("GTV", "CTV"))
    return opt_voxels.join(used, "structure").groupBy("patient_id", "voxel_id").agg(
        (F.min("limit_gy") / fractions).alias("limit_per_fraction_gy")
    )


def definition_dedup(definitions: DataFrame, fields: list[str], position: str) -> DataFrame:
    """First of each set of equal definitions, compared as canonical JSON."""
    keyed = definitions.withColumn("_json", F.to_json(F.struct(*sorted(fields))))
    return keyed.groupBy("_json").agg(F.min_by(F.struct(*definitions.columns), position).alias("_row")).select("_row.*")


def prescription(protocols: DataFrame) -> DataFrame:
    return protocols.withColumn("prescription_gy", F.col("pres_per_fraction_gy") * F.col("num_of_fractions"))
