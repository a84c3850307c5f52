"""Distributed prefix sums, ranks and exact quantiles.

A cumulative window without a partition key would bring every row to one task, and
one partitioned by a hot group would bring that group to one task. Here rows are
cut into key ranges inside each group, summed inside each range, and shifted by the
total of the ranges before. Only the range totals (a fixed number per group) meet
in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import search_left
from .joins import join_keys

BUCKET = "_bucket"
GROUP = "_group"


# A range gets at least this many cells.
RANGE_CELLS = 1000


def place(cells: DataFrame, by, key: str, touch: Column | None = None) -> DataFrame:
    """Add ``_bucket`` (key range of the row inside its group) and, with groups, ``_group``.

    ``_group`` packs the group columns in a struct, so that later joins and windows share one hash partitioning and NULL
    groups match. With ``n`` shuffle partitions the ``n`` largest groups get ranges by their share of these groups' cells,
    ``ceil(n * share)``; the ends come from a mergeable quantile sketch of the cells. Any further group has less than one
    n-th of the cells, is one range and needs no ends. So ``n`` groups have about ``n`` ends in all: that table is broadcast,
    and no row is dealt by its group. Ends steer balance only, any split gives the same result. ``touch`` names the payload, so that the sketch reads
    the same columns as the main path and Spark reuses the shuffle that built the cells.
    """
    by = list(by)
    n = max(2, int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    x = F.col(key).cast("double")
    probs = [i / n for i in range(1, n)]
    seen = x if touch is None else F.when(touch >= 0, x)
    sketch = F.coalesce(F.array_distinct(F.percentile_approx(seen, probs, 20 * n)), F.array().cast("array<double>"))
    summary = [sketch.alias("_sketch"), F.count(seen).alias("_cells")]
    if by:
        cells = cells.withColumn(GROUP, F.struct(*by))
        large = cells.groupBy(GROUP).agg(*summary).orderBy(F.desc("_cells")).limit(n)
        packed = large.agg(F.sum("_cells").alias("_all"), F.collect_list(F.struct(GROUP, "_sketch", "_cells")).alias("_g"))  # n entries
        sketches = packed.select("_all", F.inline("_g"))
    else:
        sketches = cells.agg(*summary).withColumn("_all", F.col("_cells"))  # one row
    ranges = F.least(F.ceil(n * F.col("_cells") / F.when(F.col("_all") > 0, F.col("_all"))), F.floor(F.col("_cells") / RANGE_CELLS))
    spread = sketches.withColumn("_ranges", ranges).where(F.col("_ranges") > 1)
    if not by:
        spread = sketches.withColumn("_ranges", F.greatest(F.coalesce(ranges, F.lit(1)), F.lit(1)))
    # Of n - 1 ends keep those nearest to equal shares.
    ends = F.filter("_sketch", lambda e, i: F.floor((i + 1) * F.col("_ranges") / n) > F.floor(i * F.col("_ranges") / n))
    spread = spread.select(*([GROUP] if by else []), ends.alias("_ends"))
    placed = cells.join(F.broadcast(spread), GROUP, "left") if by else cells.crossJoin(F.broadcast(spread))
    return placed.withColumn(BUCKET, F.when(F.col("_ends").isNull(), 0).otherwise(search_left(F.col("_ends"), x))).drop("_ends")


def running(df: DataFrame, order, sums: dict, before: bool = False, whole: dict | None = None) -> DataFrame:
    """Add running sums to a placed frame.

    ``sums`` maps a new column to the summed column; ``before`` leaves the current
    row out; ``whole`` maps a new column to a column whose group total is added.
    ``order`` sorts inside a range and must agree with the range key.
    """
    whole = whole or {}
    group = [GROUP] if GROUP in df.columns else []
    keys = group + [BUCKET]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in {**sums, **whole}.items()])
    ahead = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*group)
    shift = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(every).alias(n) for n in whole])
    if not group:
        shift = F.broadcast(shift)  # one row per range
    joined = df.join(shift, keys)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1 if before else 0)
    out = joined.withColumns({
        n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{n}") for n, c in sums.items()})
    return out.drop(*[f"_o_{n}" for n in sums])


def rank_cells(df: DataFrame, by, value: str, weight: str | None = None) -> DataFrame:
    """One row per group and distinct value: size and the rank numbers it gets.

    ``n``: rows with the value, ``below``: rows with a smaller value, ``size``: rows
    in the group, ``avg_rank``: average-tie rank, ``min_rank``: first-of-ties rank.
    """
    by = list(by)
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(count.alias("n"))
    placed = place(cells, by, value, F.col("n"))
    out = running(placed, [value], {"below": "n"}, before=True, whole={"size": "n"})
    return out.select(*by, value, "n", "size", "below",
                      (F.col("below") + (F.col("n") + 1) / 2.0).alias("avg_rank"),
                      (F.col("below") + 1).alias("min_rank"))


def row_numbers(df: DataFrame, by, key: str, order, name: str = "position") -> DataFrame:
    """``row_number`` inside each group without bringing a group to one task.

    ``key`` is the numeric leading sort key and ``order`` the full sort.
    """
    placed = place(df.withColumn("_one", F.lit(1).cast("long")), by, key)
    return running(placed, order, {name: "_one"}).drop("_one", BUCKET, GROUP)


def quantiles(df: DataFrame, value: str, probs, by=()) -> DataFrame:
    """Exact linear-interpolation quantiles: columns ``by``, ``prob_no``, ``prob``, ``value``.

    Works on value counts with running totals, so memory does not grow with the
    number of distinct values as it does in the built-in exact percentile.
    """
    by = list(by)
    cells = rank_cells(df, by, value)
    spots = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"))
                                for i, p in enumerate(probs)])).alias("_q")
    at = F.col("_q.p") * (F.col("size") - 1)
    low = F.floor(at)
    high = F.least(low + 1, F.col("size") - 1)

    def holds(spot):
        return (F.col("below") <= spot) & (spot < F.col("below") + F.col("n"))

    hit = cells.select("*", spots).where(holds(low) | holds(high))
    picked = hit.groupBy(*by, "_q", "size").agg(
        F.max(F.when(holds(low), F.col(value))).alias("_lo"),
        F.max(F.when(holds(high), F.col(value))).alias("_hi"))
    return picked.select(*by, F.col("_q.i").alias("prob_no"), F.col("_q.p").alias("prob"),
                         (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (at - low)).alias("value"))


def median(df: DataFrame, value: str, by=(), name: str = "median") -> DataFrame:
    return quantiles(df, value, [0.5], by).select(*by, F.col("value").alias(name))


def group_sizes(df: DataFrame, by, value: str) -> DataFrame:
    """Rows with and without a value, per group."""
    return df.groupBy(*by).agg(F.count(value).alias("n_present"),
                               F.count_if(F.col(value).isNull()).alias("n_missing"))
