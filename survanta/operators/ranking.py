"""Rank methods inside each dataset and across datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_keys
from .lineage import cut_lineage
from .metric_tables import KEYS, long_form
from .prefix import group_sizes, rank_cells, row_numbers
from .tasks import TASKS

BLOCKS = {m.column[:-5]: task for task, cfg in TASKS.items() for m in cfg.metrics}
HIGHER = {m.column[:-5] for cfg in TASKS.values() for m in cfg.metrics if m.direction == "higher"}


def metric_ranks(df: DataFrame, metrics=None) -> DataFrame:
    """``dataset, method, metric, value, rank``: average-tie ranks, best first, NULL last.

    A metric without any value in a dataset is left out for that dataset.
    """
    columns = [f"{m}_mean" for m in (metrics or BLOCKS) if f"{m}_mean" in df.columns]
    best_low = F.when(F.col("metric").isin(*HIGHER), -F.col("value")).otherwise(F.col("value"))
    long = long_form(df, columns).withColumn("_v", best_low)
    by = ["dataset", "metric"]
    sizes = group_sizes(long, by, "_v").where(F.col("n_present") > 0)
    cells = rank_cells(long, by, "_v").select(*by, "_v", "avg_rank")
    seen = join_keys(join_keys(long, sizes, by), cells, by + ["_v"], "left")
    rank = F.coalesce("avg_rank", F.col("n_present") + (F.col("n_missing") + 1) / 2.0)
    return seen.select(*KEYS, "metric", "value", rank.alias("rank"))


def blocks(df: DataFrame) -> DataFrame:
    """Per-dataset rank table: every metric and rank, block sums and positions, overall position.

    Positions count from 1 by rank sum; ties are ordered by method.
    """
    ranks = metric_ranks(df)
    metrics = [m for m in BLOCKS if f"{m}_mean" in df.columns]
    tasks = [t for t in TASKS if any(BLOCKS[m] == t for m in metrics)]
    of = lambda c, m: F.max(F.when(F.col("metric") == m, F.col(c)))
    block = {t: F.sum(F.when(F.col("metric").isin(*[m for m in metrics if BLOCKS[m] == t]), F.col("rank"))) for t in tasks}
    wide = ranks.groupBy(*KEYS).agg(
        *[of("value", m).alias(f"{m}_mean") for m in metrics], *[of("rank", m).alias(f"{m}_rank") for m in metrics],
        *[c.alias(f"{t}_rank_sum") for t, c in block.items()], F.sum("rank").alias("overall_rank_sum"))
    wide = cut_lineage(wide)  # read by every range of the positions below
    scores = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"{t}_rank_sum").alias("s"))
                                 for t in tasks + ["overall"]])).alias("_b")
    long = wide.select(*KEYS, scores).select(*KEYS, "_b.t", "_b.s").where(F.col("s").isNotNull())
    placed = row_numbers(long, ["dataset", "t"], "s", ["s", "method"])
    positions = placed.groupBy(*KEYS).agg(*[
        F.max(F.when(F.col("t") == t, F.col("position"))).alias(f"{t}_position") for t in tasks + ["overall"]])
    return cut_lineage(join_keys(wide, positions, KEYS))


def diagnostics(df: DataFrame, piecewise: DataFrame | None = None) -> DataFrame:
    """One row per dataset: rows, present and missing metrics per block, interval-model rows."""
    present = {m: F.count(f"{m}_mean") > 0 if f"{m}_mean" in df.columns else F.lit(False) for m in BLOCKS}
    names = lambda t, want: F.concat_ws(", ", *[
        F.when(F.first(F.lit(1)).isNotNull() & (present[m] == want), F.lit(f"{m.upper()}_mean")) for m in BLOCKS if BLOCKS[m] == t])
    out = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), *[
        names(t, want).alias(f"{t}_{'present' if want else 'missing'}") for t in TASKS for want in (True, False)])
    out = out.withColumn("status", F.lit("ok"))
    if piecewise is None:
        return out.withColumns({"piecewise_rows": F.lit(0).cast("long"), "piecewise_methods": F.lit(0).cast("long")})
    extra = piecewise.groupBy("dataset").agg(F.count(F.lit(1)).alias("_r"), F.count_distinct("method").alias("_m"))
    return join_keys(out, extra, ["dataset"], "left").withColumns({
        "piecewise_rows": F.coalesce("_r", F.lit(0)), "piecewise_methods": F.coalesce("_m", F.lit(0))}).drop("_r", "_m")


def overall(table: DataFrame, task: str) -> DataFrame:
    """Leaderboard of one task over all datasets: mean rank sum, mean position, overall position."""
    g = table.where(F.col(f"{task}_rank_sum").isNotNull()).groupBy("method").agg(
        F.count_distinct("dataset").alias("datasets"), F.avg(f"{task}_rank_sum").alias("avg_ranksum"),
        F.avg(f"{task}_position").alias("avg_position"))
    out = row_numbers(g, [], "avg_ranksum", ["avg_ranksum", "avg_position", "method"], "overall_position")
    return out.select(F.lit(task.upper()).alias("task"), *g.columns, "overall_position")


def overall_all(table: DataFrame) -> DataFrame:
    """Leaderboard over all tasks: mean of the median positions per task."""
    tasks = [t for t in TASKS if f"{t}_position" in table.columns]
    # A method has at most one position per dataset and task.
    g = table.groupBy("method").agg(F.count_distinct("dataset").alias("datasets"), *[
        F.median(f"{t}_position").alias(f"{t}_median") for t in tasks])
    got = F.array_compact(F.array(*[f"{t}_median" for t in tasks]))
    mean = F.try_divide(F.aggregate(got, F.lit(0.0), lambda a, x: a + x), F.size(got))
    g = g.withColumn("mean_task_median", mean).withColumns(
        {"avg_ranksum": F.col("mean_task_median"), "avg_position": F.col("mean_task_median")})
    out = row_numbers(g, [], "mean_task_median", ["mean_task_median", "method"], "overall_position")
    return out.select(F.lit("ALL").alias("task"), *g.columns, "overall_position")


def leaderboards(df: DataFrame, piecewise: DataFrame | None = None) -> dict[str, DataFrame]:
    """All leaderboard tables by name, ready for ``store.write_tables``."""
    full = df if piecewise is None else df.unionByName(piecewise, allowMissingColumns=True)
    table = blocks(full)
    tasks = [t for t in TASKS if f"{t}_rank_sum" in table.columns]
    keep = KEYS + [f"{t}_{x}" for t in tasks + ["overall"] for x in ("rank_sum", "position")]
    return {"diagnostics": diagnostics(full, piecewise), "per_dataset": table, "long_per_dataset": table.select(*keep),
            **{f"overall_{t}": overall(table, t) for t in tasks}, "overall_all": overall_all(table)}
