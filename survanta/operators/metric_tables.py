"""Metric tables: one row per ``dataset, method`` with ``<metric>_mean`` columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_keys

KEYS = ["dataset", "method"]


def norm(c):
    return F.lower(F.trim(c))


def metric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.endswith("_mean")]


def ensure_columns(df: DataFrame, columns, type_: str = "double") -> DataFrame:
    """Add missing columns as NULL."""
    return df.withColumns({c: F.lit(None).cast(type_) for c in columns if c not in df.columns})


def normalize_methods(df: DataFrame, allowed=None) -> DataFrame:
    """Trimmed methods with a lower-case key; optionally only ``allowed`` methods."""
    out = df.withColumn("method", F.trim("method")).withColumn("method_norm", norm(F.col("method")))
    if allowed is None:
        return out
    if isinstance(allowed, DataFrame):
        return out.join(allowed, "method", "left_semi")
    return out.where(F.col("method").isin(list(allowed)))


def long_form(df: DataFrame, columns=None, ids=KEYS) -> DataFrame:
    """``ids, metric, value`` with the metric's short lower-case name."""
    columns = columns or metric_columns(df)
    cells = F.explode(F.array(*[F.struct(F.lit(c[:-5]).alias("metric"), F.col(c).cast("double").alias("value"))
                                for c in columns])).alias("_c")
    return df.select(*ids, cells).select(*ids, "_c.metric", "_c.value")


def wide_form(long: DataFrame, metrics, ids=KEYS) -> DataFrame:
    """Inverse of :func:`long_form`; ``metrics`` fixes the columns, so no pre-scan is needed."""
    return long.groupBy(*ids).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_mean") for m in metrics])


def lookup(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Value of each wanted ``dataset, method, metric`` (case and blanks ignored), NULL if absent."""
    long = long_form(df).withColumns({"_m": norm(F.col("method"))})
    cells = long.groupBy("dataset", "_m", "metric").agg(F.min_by("value", "method").alias("value"))
    keyed = wanted.withColumns({"_m": norm(F.col("method")), "metric": norm(F.col("metric"))})
    return join_keys(keyed, cells, ["dataset", "_m", "metric"], "left").drop("_m")


def missing(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted ``dataset, method, metric`` cells that the table does not hold."""
    have = long_form(df).where(F.col("value").isNotNull()).select(
        "dataset", norm(F.col("method")).alias("_m"), "metric")
    keyed = wanted.withColumns({"_m": norm(F.col("method")), "metric": norm(F.col("metric"))})
    return join_keys(keyed, have, ["dataset", "_m", "metric"], "left_anti").drop("_m")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fill only NULL cells of known methods and append unknown methods."""
    columns = list(dict.fromkeys([c for c in old.columns + new.columns if c not in KEYS + ["method_norm"]]))
    types = {**dict(new.dtypes), **dict(old.dtypes)}
    cast = lambda df, side: df.select(
        F.col("dataset").alias(f"{side}_d"), F.col("method").alias(f"{side}_m"),
        *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(f"{side}_{c}") for c in columns])
    a, b = cast(old, "a"), cast(new, "b")
    both = a.join(b, (F.col("a_d") == F.col("b_d")) & (norm(F.col("a_m")) == norm(F.col("b_m"))), "full_outer")
    return both.select(F.coalesce("a_d", "b_d").alias("dataset"), F.coalesce("a_m", "b_m").alias("method"),
                       *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in columns])


def get_or_compute(df: DataFrame, wanted: DataFrame, compute) -> DataFrame:
    """Serve wanted cells from the table; call ``compute(missing)`` only for absent ones.

    ``compute`` gets the missing ``dataset, method, metric`` rows and returns a metric
    table; the updated table is returned.
    """
    gaps = missing(df, wanted)
    return df if gaps.isEmpty() else upsert(df, compute(gaps))


def available_metrics(*tables: DataFrame) -> DataFrame:
    """Metric names with any value in any of the tables, per dataset."""
    parts = [long_form(t, ids=["dataset"]).where(F.col("value").isNotNull()).select("dataset", "metric") for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def active_metrics(df: DataFrame, metrics, by=("dataset",)) -> DataFrame:
    """``available`` and ``missing`` metric keys of a task, per group, in task order."""
    known = [(m, F.count(m.column if m.column in df.columns else F.lit(None)) > 0) for m in metrics]
    agg = df.groupBy(*by).agg(*[c.alias(f"_a{i}") for i, (_, c) in enumerate(known)])
    pick = lambda want: F.array_compact(F.array(*[
        F.when(F.col(f"_a{i}") == want, F.lit(m.key)) for i, (m, _) in enumerate(known)]))
    return agg.select(*by, pick(True).alias("available"), pick(False).alias("missing"))


def rows_with_metrics(df: DataFrame, metrics, by=("dataset",)) -> DataFrame:
    """Rows holding any of the metrics; groups where no row does keep all rows."""
    has = F.coalesce(*[F.col(m.column) for m in metrics if m.column in df.columns]).isNotNull()
    any_ = df.groupBy(*by).agg(F.bool_or(has).alias("_any"))
    return join_keys(df, any_, by).where(has | ~F.col("_any")).drop("_any")


def keep_last(df: DataFrame, keys, order: str) -> DataFrame:
    """One row per key, the one with the highest ``order`` (later unions win)."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return last.select(*keys, "_r.*").select(*df.columns)


def comparison_points(df: DataFrame, selected: DataFrame, x: str, y: str) -> DataFrame:
    """Metric pair of each selected ``dataset, method`` and the names of missing metrics."""
    cells = df.select("dataset", "method", F.col(f"{x.lower()}_mean").alias("x"), F.col(f"{y.lower()}_mean").alias("y"),
                      F.lit(True).alias("_row"))
    out = join_keys(selected, cells, KEYS, "left")
    gap = F.concat_ws(", ", F.when(F.col("x").isNull(), F.lit(x)),
                      F.when(F.col("y").isNull() & F.lit(x.lower() != y.lower()), F.lit(y)))
    return out.select(*selected.columns, "x", "y", F.coalesce("_row", F.lit(False)).alias("has_row"), gap.alias("missing"))


def table_text(df: DataFrame, max_rows: int = 12, max_metrics: int = 12) -> DataFrame:
    """Preview text of each dataset's table: headline, metric list and its first rows as CSV."""
    columns = metric_columns(df)
    head = ["method"] + columns[:max_metrics]
    line = F.concat_ws(",", "method", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[:max_metrics]])
    firsts = df.select("dataset", "method", line.alias("line"))
    from pyspark.sql import Window
    order = Window.partitionBy("dataset").orderBy("method", "line")
    top = firsts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_rows)
    body = top.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("_n", "line"))).alias("_l"))
    sizes = df.groupBy("dataset").agg(F.count(F.lit(1)).alias("_rows"))
    text = F.concat(
        F.lit("Таблица результатов для датасета "), F.col("dataset"), F.lit(".\nСтрок: "), F.col("_rows").cast("string"),
        F.lit(". Метрики: " + ", ".join(columns[:18]) + ".\n" + ",".join(head) + "\n"),
        F.array_join(F.transform("_l", lambda r: r["line"]), "\n"), F.lit("\n"))
    return join_keys(sizes, body, ["dataset"]).select(
        F.concat(F.lit("tables/"), F.col("dataset")).alias("source"),
        F.concat(F.lit("Результаты "), F.col("dataset")).alias("title"), text.alias("text"))


def board_text(board: DataFrame, name: str, columns, max_rows: int = 16) -> DataFrame:
    """Preview text of a leaderboard, one sheet per task: headline, the columns' names and its first rows as CSV.

    ``columns`` are shown in their order; rows go by ``overall_position``, then ``method``.
    """
    from pyspark.sql import Window
    head = [c for c in columns if c in board.columns]
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in head])
    order = Window.partitionBy("task").orderBy("overall_position", "method", "_line")
    top = board.withColumn("_line", line).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_rows)
    body = top.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("_n", "_line"))).alias("_l"))
    sizes = board.groupBy("task").agg(F.count(F.lit(1)).alias("_rows"))
    text = F.concat(F.lit(f"Сводная таблица рангов {name}, лист "), F.col("task"), F.lit(".\nСтрок: "), F.col("_rows").cast("string"),
                    F.lit(". Колонки: " + ", ".join(head[:16]) + ".\n" + ",".join(head) + "\n"),
                    F.array_join(F.transform("_l", lambda r: r["_line"]), "\n"), F.lit("\n"))
    return join_keys(sizes, body, ["task"]).select(F.lit(f"tables/{name}").alias("source"), F.concat(F.lit("Таблица "), F.col("task")).alias("title"), text.alias("text"))
