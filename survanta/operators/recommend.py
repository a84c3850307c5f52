"""Score methods by task weights, explain the best ones, choose candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import format_number
from .joins import join_keys
from .lineage import cut_lineage
from .metric_tables import active_metrics, ensure_columns, keep_last, rows_with_metrics
from .prefix import rank_cells
from .tasks import ALL_METRICS, TASKS

# The wording of the explanations.
UP, DOWN, YES, NO, NONE_LINE = "выше лучше", "ниже лучше", "да", "нет", "- нет"
COMPACT = "%s: %s (%s, позиция %s)"
PLACE = "%d из %d"
PLAIN = "%s = %s (%s)"
GOAL = "Модель лучше всего подходит, чтобы {goal}: итоговая оценка по доступным метрикам %d/100."
ARGUMENTS = "Главные аргументы: "
BASIS = "Рекомендация основана на предрассчитанных таблицах и сравнении моделей внутри выбранного датасета."
VARIANT = ("Это Piecewise-вариант: %s строит интервальные классификаторы поверх %s, а times=%d выбран глобально "
           "для этой пары по всем датасетам.")
VARIANT_LINE = "- %s: глобально выбран times=%d для %s + %s."
TOP_LINE = "%d. %s — score %d/100. Метрики: %s."
HEADS = {"dataset": "Датасет: ", "task": "Задача: ", "best": "Рекомендованная модель: ", "score": "Итоговая оценка: %d/100",
         "have": "Доступные метрики: ", "lack": "Отсутствующие метрики: ", "pw": "Piecewise-варианты учтены: ",
         "context": "Piecewise-контекст:", "why": "Локальное объяснение:", "top": "Топ моделей:"}


def _spans(df: DataFrame, metrics, by) -> DataFrame:
    return df.groupBy(*by).agg(*[f(m.column).alias(f"_{p}_{m.key}") for m in metrics
                                 for p, f in (("lo", F.min), ("hi", F.max))])


def normalized(m) -> Column:
    """Metric scaled to 0..1, 1 is best; a constant metric gives 1, NULL stays NULL."""
    x, lo, hi = F.col(m.column), F.col(f"_lo_{m.key}"), F.col(f"_hi_{m.key}")
    way = (x - lo) if m.direction == "higher" else (hi - x)
    return F.when(x.isNull(), F.lit(None)).when(lo == hi, 1.0).otherwise(way / (hi - lo))


def _score(metrics) -> Column:
    gained = have = weight = F.lit(0.0)
    for m in metrics:
        n = normalized(m)
        active = F.col(f"_lo_{m.key}").isNotNull()
        gained = gained + F.coalesce(n, F.lit(0.0)) * m.weight
        have = have + F.when(n.isNotNull(), m.weight).otherwise(0.0)
        weight = weight + F.when(active, m.weight).otherwise(0.0)
    raw = F.coalesce(gained / F.nullif(have, F.lit(0.0)), F.lit(0.0))
    return raw * (0.8 + 0.2 * F.coalesce(have / F.nullif(weight, F.lit(0.0)), F.lit(0.0)))


def score(df: DataFrame, metrics, by=("dataset",), fallback=(), name: str = "score") -> DataFrame:
    """Weighted score of each row inside its group, lowered for missing metrics.

    Metrics without any value in the group do not count. When none of ``metrics``
    has one, ``fallback`` metrics are used instead. The ranges are one row per group,
    joined back; no window over the rows.
    """
    own = ensure_columns(df, [m.column for m in (*metrics, *fallback)])
    spans = _spans(own, tuple(dict.fromkeys((*metrics, *fallback))), by)
    joined = join_keys(own, spans, by)
    s = _score(metrics)
    if fallback:
        some = F.coalesce(*[F.col(f"_lo_{m.key}") for m in metrics]).isNotNull()
        s = F.when(some, s).otherwise(_score(fallback))
    return joined.select(*own.columns, s.alias(name))


def normalize(df: DataFrame, metrics, by=("dataset",)) -> DataFrame:
    """Add ``<metric>_norm`` columns: min-max by direction."""
    joined = join_keys(df, _spans(df, metrics, by), by)
    return joined.select(*df.columns, *[normalized(m).alias(f"{m.key.lower()}_norm") for m in metrics])


def positions(df: DataFrame, metrics, by=("dataset",)) -> DataFrame:
    """First-of-ties position of each method per metric and the number of methods having it."""
    by = list(by)
    cells = F.explode(F.array(*[F.struct(
        F.lit(i).alias("no"), F.lit(m.key).alias("metric"), F.lit(m.label).alias("label"), F.lit(m.direction).alias("direction"),
        F.col(m.column).alias("value"), (-F.col(m.column) if m.direction == "higher" else F.col(m.column)).alias("v"))
        for i, m in enumerate(metrics)])).alias("_c")
    long = df.select(*by, "method", cells).select(*by, "method", "_c.*")
    ranks = rank_cells(long, by + ["metric"], "v").select(*by, "metric", "v", F.col("min_rank").alias("position"))
    totals = long.groupBy(*by, "metric").agg(F.count("v").alias("total"), F.count_if(F.col("v").isNull()).alias("_none"))
    out = join_keys(join_keys(long, totals, by + ["metric"]), ranks, by + ["metric", "v"], "left")
    last = F.when(F.col("total") > 0, F.col("total") + 1)  # methods without the metric share the place after the last
    return out.select(*by, "method", "no", "metric", "label", "direction", "value",
                      F.coalesce("position", last).alias("position"), "total")


def top(scored: DataFrame, k: int = 3, by=("dataset",)) -> DataFrame:
    """Best ``k`` rows per group by score, ties by method, with ``place``."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "method")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def candidates(df: DataFrame, task: str, piecewise: DataFrame | None = None) -> DataFrame:
    """Rows to recommend from: base methods plus, for event tasks, the selected interval
    models; on equal names the interval row wins; rows without any task metric are left out."""
    metrics = TASKS[task].metrics
    rows = ensure_columns(df.where(F.trim("method") != ""), [m.column for m in metrics]).withColumn("_o", F.lit(0))
    if piecewise is not None and task == "classification":
        rows = rows.unionByName(piecewise.withColumn("_o", F.lit(1)), allowMissingColumns=True)
        rows = keep_last(rows, ["dataset", "method"], "_o")
    return rows_with_metrics(rows.drop("_o"), metrics)


def run(df: DataFrame, task: str, piecewise: DataFrame | None = None, k: int = 3) -> DataFrame:
    """Recommendation per dataset.

    Columns: dataset, task, recommended_method, score (0..100), available, missing,
    why (array), top_models (array of place, method, score, metric texts).
    Datasets without any metric of the task do not appear.
    """
    cfg = TASKS[task]
    rows = cut_lineage(candidates(df, task, piecewise))  # read by the score, the places and the metric lists
    active = active_metrics(rows, cfg.metrics).where(F.size("available") > 0)
    live = join_keys(rows, active, ["dataset"])
    best = top(score(live.select(*rows.columns), cfg.metrics), k)
    placed = join_keys(best.select("dataset", "method", "place", "score"),
                       positions(live.select(*rows.columns), cfg.metrics).where(F.col("total") > 0), ["dataset", "method"])
    text = format_number(F.col("value"))
    way = F.when(F.col("direction") == "higher", UP).otherwise(DOWN)
    compact = F.format_string(COMPACT, "label", text, way,
                              F.format_string(PLACE, "position", "total"))
    plain = F.format_string(PLAIN, "label", text, way)
    models = placed.groupBy("dataset", "method", "place", "score").agg(F.array_sort(F.collect_list(F.struct(
        "no", "position", compact.alias("compact"), plain.alias("plain")))).alias("_m"))
    models = models.withColumn("_pct", F.bround(F.col("score") * 100).cast("int"))
    strong = F.filter("_m", lambda m: m["position"] <= 3)
    strong = F.when(F.size(strong) > 0, F.slice(strong, 1, 3)).otherwise(F.slice("_m", 1, 2))
    why = F.array(
        F.format_string(GOAL.format(goal=cfg.goal), "_pct"),
        F.concat(F.lit(ARGUMENTS), F.array_join(F.transform(strong, lambda m: m["plain"]), ", "), F.lit(".")),
        F.lit(BASIS))
    p = labels.parse(F.col("method"))
    note = F.format_string(VARIANT, p["family"], p["base_model"], p["times"])
    why = F.when(p["family"].isNotNull(), F.concat(why, F.array(note))).otherwise(why)
    out = models.groupBy("dataset").agg(
        F.min_by("method", "place").alias("recommended_method"), F.min_by("_pct", "place").alias("score"),
        F.min_by(why, "place").alias("why"),
        F.array_sort(F.collect_list(F.struct("place", "method", F.col("_pct").alias("score"), F.transform(
            "_m", lambda m: m["compact"]).alias("metrics")))).alias("top_models"))
    return join_keys(out, active, ["dataset"]).withColumn("task", F.lit(task))


def facts(advice: DataFrame, variants: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """Plain-text facts of each recommendation, one text per dataset."""
    lines = advice
    if variants is not None:
        p = labels.parse(F.col("method"))
        item = F.format_string(VARIANT_LINE, "method", p["times"], p["family"], p["base_model"])
        order = Window.partitionBy("dataset").orderBy("method")
        some = variants.select("dataset", "method", item.alias("_l"), F.row_number().over(order).alias("_n")).where(F.col("_n") <= limit)
        lines = join_keys(advice, some.groupBy("dataset").agg(
            F.array_sort(F.collect_list(F.struct("_n", "_l"))).alias("_v")), ["dataset"], "left")
    else:
        lines = lines.withColumn("_v", F.lit(None).cast("array<struct<_n:int,_l:string>>"))
    listed = F.array_join(F.transform("_v", lambda v: v["_l"]), "\n")
    tops = F.array_join(F.transform("top_models", lambda m: F.format_string(
        TOP_LINE, m["place"], m["method"], m["score"], F.array_join(m["metrics"], "; "))), "\n")
    names = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(NO)
    task_label = F.create_map(*[F.lit(x) for t, c in TASKS.items() for x in (t, c.label)])
    text = F.concat_ws("\n", *[
        F.concat(F.lit(HEADS["dataset"]), "dataset"), F.concat(F.lit(HEADS["task"]), F.element_at(task_label, F.col("task"))),
        F.concat(F.lit(HEADS["best"]), "recommended_method"),
        F.format_string(HEADS["score"], "score"),
        F.concat(F.lit(HEADS["have"]), names("available")), F.concat(F.lit(HEADS["lack"]), names("missing")),
        F.concat(F.lit(HEADS["pw"]), F.when(F.col("_v").isNotNull(), YES).otherwise(NO)),
        F.lit(HEADS["context"]), F.coalesce(listed, F.lit(NONE_LINE)),
        F.lit(HEADS["why"]), F.array_join(F.transform("why", lambda w: F.concat(F.lit("- "), w)), "\n"),
        F.lit(HEADS["top"]), tops])
    return lines.select("dataset", "task", text.alias("text"))


def best_candidate(df: DataFrame, method_tasks: DataFrame, piecewise: DataFrame | None = None,
                   preferred: str | None = None) -> DataFrame:
    """Model to serve per dataset.

    The best row of each task (methods by ``method_tasks(method, task)``) and of each
    interval-model family competes by score, earlier category first on ties. A
    ``preferred`` method wins wherever it exists.
    """
    def scored(rows, task, category, order, by=("dataset",)):
        s = top(score(rows, TASKS[task].metrics, by, ALL_METRICS), 1, by)
        return s.select("dataset", F.lit(category).alias("category"), F.lit(task).alias("task"), "method", "score", F.lit(order).alias("_o"))

    parts = []
    for i, task in enumerate(TASKS):
        own = df.join(method_tasks.where(F.col("task") == task).select("method"), "method", "left_semi")
        parts.append(scored(own, task, task, i))
    if piecewise is not None:
        family = labels.parse(F.col("method"))["family"]
        for i, name in enumerate(("PiecewiseClassifWrapSA", "PiecewiseCensorAwareClassifWrapSA")):
            parts.append(scored(piecewise.where(family == name), "classification", name.lower(), 3 + i))
    if preferred is not None:
        parts.append(scored(df.where(F.trim("method") == preferred), "survival", "survival", -1))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    pick = F.struct((F.col("_o") < 0).alias("p"), F.col("score").alias("s"), (-F.col("_o")).alias("o"))
    best = every.groupBy("dataset").agg(F.max_by(F.struct("category", "task", "method", "score"), pick).alias("_b"))
    return best.select("dataset", "_b.*")
