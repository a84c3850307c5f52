"""Interval-model rows of metric tables: choose ``times``, pair with base models, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from .joins import join_keys
from .ranking import metric_ranks
from .recommend import score
from .tasks import TASKS

GROUP = ["family", "base_model"]


def parsed(df: DataFrame) -> DataFrame:
    """Only interval-model rows, with ``family``, ``base_model``, ``times``."""
    p = df.withColumn("_p", labels.parse(F.col("method"))).where(F.col("_p.times").isNotNull())
    return p.select("*", "_p.family", "_p.base_model", "_p.times").drop("_p")


def global_times(df: DataFrame, task: str = "classification") -> DataFrame:
    """``family, base_model, times``: one interval count per pair for all datasets.

    Highest mean score over datasets; counts seen in every dataset of the pair come
    first, then more datasets, then fewer intervals.
    """
    fallback = TASKS["classification"].metrics if task != "classification" else ()
    scored = parsed(score(df, TASKS[task].metrics, fallback=fallback))
    per = scored.groupBy(*GROUP, "times").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))
    seen = scored.groupBy(*GROUP).agg(F.count_distinct("dataset").alias("_all"))
    best = join_keys(per, seen, GROUP).groupBy(*GROUP).agg(F.max_by("times", F.struct(
        (F.col("n") == F.col("_all")).alias("full"), "mean", "n", (-F.col("times")).alias("few"))).alias("times"))
    return best


def extract(df: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """Interval-model rows to rank: the globally chosen ``times``, or the best row per pair and dataset."""
    rows = parsed(df)
    if times is not None:
        return join_keys(rows, times, GROUP + ["times"], "left_semi").select(*df.columns)
    return best_rows(rows).select(*df.columns)


def best_rows(rows: DataFrame) -> DataFrame:
    """First row per dataset and pair by rank sum over the event metrics, then fewer intervals."""
    metrics = [m.column[:-5] for m in TASKS["classification"].metrics if m.column in rows.columns]
    ranks = metric_ranks(rows, metrics).groupBy("dataset", "method").agg(F.sum("rank").alias("_rank"))
    keep = rows.columns
    best = join_keys(rows, ranks, ["dataset", "method"], "left").groupBy("dataset", *GROUP).agg(
        F.min_by(F.struct(*keep), F.struct(F.coalesce("_rank", F.lit(0.0)).alias("s"), "times", "method")).alias("_b"))
    return best.select("_b.*")


def variant_labels(df: DataFrame, wanted: DataFrame, task: str = "classification", default_times: int | None = None) -> DataFrame:
    """Label to use for each wanted ``dataset, family, base_model``.

    The globally chosen variant if the dataset has it; otherwise NULL, or with
    ``default_times`` a label to compute at run time.
    """
    chosen = global_times(df, task)
    named = join_keys(wanted, chosen, GROUP, "left").withColumn(
        "_label", labels.build(F.col("family"), F.col("base_model"), F.col("times")))
    have = df.select("dataset", F.col("method").alias("_label"), F.lit(True).alias("precomputed")).distinct()
    out = join_keys(named, have, ["dataset", "_label"], "left")
    label = F.when(F.col("precomputed"), F.col("_label"))
    if default_times is not None:
        label = F.coalesce(label, labels.build(F.col("family"), F.col("base_model"), F.coalesce("times", F.lit(default_times))))
    return out.select(*wanted.columns, label.alias("method"), F.coalesce("precomputed", F.lit(False)).alias("precomputed"))


def pairs(df: DataFrame) -> DataFrame:
    """Base model against its chosen interval variants, per dataset, scores 0..100."""
    metrics = TASKS["classification"].metrics
    scored = score(df, metrics).withColumn("score", F.col("score") * 100.0)
    cells = ["score"] + [m.column for m in metrics]
    short = {"score": "score", "auc_event_mean": "auc", "logloss_event_mean": "logloss", "rmse_event_mean": "rmse"}
    base = scored.withColumn("base_model", labels.base_of(F.col("method"))).where(F.col("base_model").isNotNull())
    base = base.select("dataset", "base_model", *[F.col(c).alias(f"base_{short[c]}") for c in cells])
    piece = join_keys(parsed(scored), global_times(df), GROUP + ["times"], "left_semi")
    piece = piece.select("dataset", *GROUP, "times", "method", labels.variant(F.col("method")).alias("variant"),
                         *[F.col(c).alias(f"piece_{short[c]}") for c in cells])
    out = join_keys(piece, base, ["dataset", "base_model"])
    return out.withColumn("delta_score", F.col("piece_score") - F.col("base_score"))


def summary(p: DataFrame) -> DataFrame:
    """Per family and model: datasets, mean scores, win rate in percent, chosen interval counts."""
    return p.groupBy(*GROUP).agg(
        F.count_distinct("dataset").alias("datasets"), F.avg("base_score").alias("base_score"),
        F.avg("piece_score").alias("piecewise_score"), F.avg("delta_score").alias("delta_score"),
        (F.avg((F.col("delta_score") > 0).cast("int")) * 100.0).alias("win_rate"),
        F.array_join(F.array_sort(F.collect_set("times")), ", ").alias("best_times"))


def cards(p: DataFrame, model: str = "DecisionTreeClassifier") -> DataFrame:
    """Headline numbers: gain and win rate of one model, best case, improved pairs."""
    own = F.when(F.col("base_model") == model, F.col("delta_score"))
    best = F.max_by(F.struct("dataset", "base_model", "times", "delta_score"), F.struct(
        "delta_score", "dataset", "base_model", "family"))
    return p.agg(
        F.coalesce(F.avg(own), F.lit(0.0)).alias("model_gain"),
        F.coalesce(F.avg((own > 0).cast("int")) * 100.0, F.lit(0.0)).alias("model_win_rate"),
        best.alias("_b"), F.count_if(F.col("delta_score") > 0).alias("improved"), F.count(F.lit(1)).alias("pairs")).select(
        "model_gain", "model_win_rate", F.col("_b.dataset").alias("best_dataset"), F.col("_b.base_model").alias("best_model"),
        F.col("_b.times").alias("best_times"), F.col("_b.delta_score").alias("best_gain"), "improved", "pairs")


def details(p: DataFrame, model: str = "DecisionTreeClassifier") -> DataFrame:
    """Dataset rows of one model with AUC and LogLoss changes in percent."""
    return p.where(F.col("base_model") == model).select(
        "dataset", "family", "times", "variant", "base_score", "piece_score", "delta_score",
        ((F.col("piece_auc") - F.col("base_auc")) * 100.0).alias("auc_delta"),
        F.when(F.col("base_logloss") != 0, (F.col("base_logloss") - F.col("piece_logloss")) / F.abs("base_logloss") * 100.0)
        .alias("logloss_reduction"))
