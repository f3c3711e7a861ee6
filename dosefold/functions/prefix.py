"""Cumulative sums that never put one whole group into one task.

A plain ``sum() over (partition by group order by x)`` sorts a complete group in
one task. Here the order key is first cut into coarse buckets: bucket totals are
pre-aggregated, cumulated over the few buckets of a group, and added to a window
that only spans one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group (equal values folded) that one window may hold.
GROUP_ROWS = 1 << 17
VOXEL_CHUNK = 65536
#: Cells that a large group is counted in, for each GROUP_ROWS of its rows.
CELLS = 16


INT_MIN = -(2**31)


def _shared_sum(df: DataFrame, value: str) -> Column:
    """Sum of `value` that depends on all columns, so none is pruned (every hash is at least INT_MIN)."""
    return F.sum(F.when(F.hash(*df.columns) >= INT_MIN, F.col(value)))


def running_before(
    df: DataFrame, keys: list[str], bucket: Column | list[str], order: list[str], value: str, out: str, totals: bool = False
) -> DataFrame:
    """Add `out`: the sum of `value` over rows strictly before this one.

    `bucket` (a column, or names of columns that sort alike) must be non-decreasing
    along `order`, and `order` unique within keys. With `totals`, the group's sum
    and its largest first order column come along as `total` and `top`, read off the
    bucket table.

    The bucket totals and the detail rows come from the same input. `_shared_sum`
    reads every column, so both sides ask for the same shuffle and Spark reuses it
    instead of computing the input twice. The rows are summed inside their bucket
    before they meet its base: the join finds them dealt and sorted.
    """
    marked, names = (df, list(bucket)) if isinstance(bucket, list) else (df.withColumn("_bucket", bucket), ["_bucket"])
    over_buckets = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    extra = [F.sum("_total").over(group).alias("total"), F.max("_top").over(group).alias("top")] if totals else []
    bases = (
        marked.groupBy(*keys, *names)
        .agg(_shared_sum(df, value).alias("_total"), F.max(order[0]).alias("_top"))
        .select(*keys, *names, F.coalesce(F.sum("_total").over(over_buckets), F.lit(0)).alias("_base"), *extra)
    )
    inside = Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(bases, [*keys, *names])
        .withColumn(out, F.col("_base") + F.col("_inside"))
        .drop("_inside", "_base", *([] if isinstance(bucket, list) else names))
    )


def running_min_before(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str) -> DataFrame:
    """Add `out`: the smallest `value` of earlier rows, NULL on the first; bucketed like `running_before`."""
    marked = df.withColumn("_bucket", bucket)
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        marked.groupBy(*keys, "_bucket").agg(F.min(value).alias("_low"))
        .select(*keys, "_bucket", F.min("_low").over(over_buckets).alias("_base"))
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(bases, [*keys, "_bucket"])
        .withColumn(out, F.least("_base", F.min(value).over(inside)))
        .drop("_bucket", "_base")
    )


def even_buckets(df: DataFrame, keys: list[str], value: str, large: int | None = None, cells: int = 1024, parts: int = 256) -> DataFrame:
    """`df` with `even`, a bucket number that never falls along `value`, of about equal counts in large groups.

    A group of at most `large` rows (GROUP_ROWS) is one bucket. A larger one is counted in `cells`
    equal steps between its ends; running counts cut the cells into `parts` buckets,
    and a cell that holds more than a bucket is cut again by equal steps. So the
    cuts follow the data, whatever the scale of `value`, and depend on counts alone:
    a task that is run again cuts alike.
    """
    large = GROUP_ROWS if large is None else large
    return _cut(df, _large_ends(df, keys, value, large), keys, value, large, cells, parts).fillna(0, ["even"])


def _large_ends(df: DataFrame, keys: list[str], value: str, large: int) -> DataFrame:
    """Ends and rows of the groups with more than `large` rows."""
    v = F.col(value).cast("double")
    rows = F.count(F.when(F.hash(*df.columns) >= INT_MIN, 1))  # reads all columns, so that the shuffle of `df` is shared
    return df.groupBy(*keys).agg(F.min(v).alias("_e_lo"), F.max(v).alias("_e_hi"), rows.alias("_e_n")).filter(F.col("_e_n") > large)


def _cut(df: DataFrame, ends: DataFrame, keys: list[str], value: str, large: int, cells: int, parts: int) -> DataFrame:
    """Even buckets of the groups in `ends`, NULL for the others.

    A row of `ends` stands for more than `large` rows and gets at most CELLS cells for as many, so both tables are sent whole.
    """
    v, steps = F.col(value).cast("double"), F.least(F.ceil(F.col("_e_n") * CELLS / large), F.lit(cells))
    scaled = F.when(F.col("_e_hi") > F.col("_e_lo"), (v - F.col("_e_lo")) / (F.col("_e_hi") - F.col("_e_lo")) * steps).when(F.col("_e_n").isNotNull(), 0.0)
    placed = df.join(F.broadcast(ends), keys, "left").withColumn("_e_at", scaled).withColumn("_e_cell", F.least(F.floor("_e_at"), steps - 1))
    counts = placed.filter("_e_cell IS NOT NULL").groupBy(*keys, "_e_cell").agg(F.count(F.lit(1)).alias("_e_c"), F.max("_e_n").alias("_e_n"))
    before = F.coalesce(F.sum("_e_c").over(Window.partitionBy(*keys).orderBy("_e_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    share = F.ceil(F.col("_e_n") / parts)
    cuts = counts.select(*keys, "_e_cell", F.floor(before / share).alias("_e_b"), F.ceil(F.col("_e_c") / share).alias("_e_pieces"))
    piece = F.when(F.col("_e_pieces") > 1, 1 + F.least(F.floor((F.col("_e_at") - F.col("_e_cell")) * F.col("_e_pieces")), F.col("_e_pieces") - 1)).otherwise(0)
    even = (F.shiftleft(F.col("_e_b"), 32) + piece).cast("long")
    return placed.join(F.broadcast(cuts), [*keys, "_e_cell"], "left").select(*df.columns, even.alias("even"))


def weight_curve(
    df: DataFrame, keys: list[str], dose: str = "dose_gy", weight: str = "weight", last: bool = True
) -> DataFrame:
    """One row per distinct dose: its weight, the weight below it and its last voxel's weight,
    with the group's `total` weight and `top` dose. `w_last` is left out on request.

    Ties collapse in the map-side aggregate, so a dose shared by most voxels
    (zero, typically) costs one row.
    """
    parts = [F.sum(weight).alias("w")] + ([F.max_by(weight, "voxel_id").alias("w_last")] if last else [])
    distinct = df.groupBy(*keys, dose).agg(*parts)
    return running_before(even_buckets(distinct, keys, dose), keys, F.col("even"), [dose], "w", "below", totals=True).drop("even")


def ordered_by_dose(df: DataFrame, keys: list[str], dose: str = "dose_gy", weight: str = "weight") -> DataFrame:
    """Per voxel, `below`: weight of the voxels before it in (dose, voxel_id) order, with `total` and `top`.

    The rows are shuffled once, by group and bucket. A group of at most GROUP_ROWS
    rows is one bucket and needs nothing more. A larger one is cut by even buckets,
    a dose that alone has more than GROUP_ROWS voxels by chunks of voxel_id too; the
    sums before its buckets are a small table, at most a few rows for GROUP_ROWS.
    """
    df = df.dropna(subset=[*keys, dose])
    cut = _cut(df, _large_ends(df, keys, dose, GROUP_ROWS), keys, dose, GROUP_ROWS, 1024, 256)
    hot = cut.filter("even IS NOT NULL").groupBy(*keys, dose).count().filter(F.col("count") > GROUP_ROWS)
    hot = hot.groupBy(*keys).agg(F.collect_list(dose).alias("_hot"))
    tied = F.array_contains("_hot", F.col(dose))
    # along the dose 0 below the first dose of many voxels, 1 at it, 2 between it and the next, 3 at that
    side = 2 * F.size(F.filter("_hot", lambda h: h < F.col(dose))) + F.when(tied, 1).otherwise(0)
    names = ["even", "_side", "_chunk"]
    placed = cut.join(F.broadcast(hot), keys, "left").withColumn(
        "_side", F.when(F.col("_hot").isNull(), 0).otherwise(side)
    ).withColumn("_chunk", F.when(tied, F.floor(F.col("voxel_id") / VOXEL_CHUNK)).otherwise(0)).drop("_hot")
    group = Window.partitionBy(*keys)
    before = group.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.filter("even IS NOT NULL").groupBy(*keys, *names).agg(F.sum(weight).alias("_sum"), F.max(dose).alias("_max")).select(
        *keys, *names, F.sum("_sum").over(before).alias("_base"), F.sum("_sum").over(group).alias("_total"), F.max("_max").over(group).alias("_top"))
    along = Window.partitionBy(*keys, *names).orderBy(dose, "voxel_id")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.coalesce(F.sum(weight).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = placed.select("*", inside.alias("_inside"), F.sum(weight).over(whole).alias("_all"), F.max(dose).over(whole).alias("_last"))
    return ranked.join(F.broadcast(bases), [*keys, *names], "left").select(
        *df.columns, (F.coalesce("_base", F.lit(0)) + F.col("_inside")).alias("below"),
        F.coalesce("_total", "_all").alias("total"), F.coalesce("_top", "_last").alias("top"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linear-interpolated exact quantiles per group, one column per entry of `quantiles`.

    Equal values are counted first and ranked by even buckets, so no large group's
    values are held by one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_before(even_buckets(counts, keys, value), keys, F.col("even"), [value], "_n", "_below")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    at = ranked.join(sizes, keys)
    picks = []
    for name, q in quantiles.items():
        place = (F.col("_size") - 1) * q
        for end, index in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("_below") <= index) & (index < F.col("_below") + F.col("_n"))
            picks.append(F.max(F.when(held, F.col(value))).alias(f"_{name}_{end}"))
    found = at.groupBy(*keys).agg(F.max("_size").alias("_size"), *picks)
    out = []
    for name, q in quantiles.items():
        place = (F.col("_size") - 1) * q
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, *out)
