"""Tasks, their metrics, directions and weights; fixed values of the scoring rules."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Metric(NamedTuple):
    key: str
    direction: str
    weight: float
    label: str

    @property
    def column(self) -> str:
        return self.key.lower() + "_mean"


class Task(NamedTuple):
    label: str
    goal: str
    metrics: tuple


# Fixed values.
TASKS = {
    "classification": Task("Классификация события", "оценить вероятность наступления события", (
        Metric("AUC_EVENT", "higher", 0.45, "AUC события"),
        Metric("LOGLOSS_EVENT", "lower", 0.35, "LogLoss события"),
        Metric("RMSE_EVENT", "lower", 0.20, "RMSE события"))),
    "regression": Task("Прогноз времени", "предсказать ожидаемое время до события", (
        Metric("RMSE_TIME", "lower", 0.30, "RMSE времени"),
        Metric("R2_TIME", "higher", 0.25, "R2 времени"),
        Metric("MAPE_TIME", "lower", 0.15, "MAPE времени"),
        Metric("MEDAPE_TIME", "lower", 0.15, "MEDAPE времени"),
        Metric("SPEARMAN_TIME", "higher", 0.10, "Spearman времени"),
        Metric("RMSLE_TIME", "lower", 0.05, "RMSLE времени"))),
    "survival": Task("Анализ выживаемости", "оценить кривую выживаемости и риск во времени", (
        Metric("CI", "higher", 0.45, "C-index"),
        Metric("IBS", "lower", 0.35, "IBS"),
        Metric("AUPRC", "higher", 0.20, "AUPRC"))),
}

ALL_METRICS = tuple(m for t in TASKS.values() for m in t.metrics)


def config_table(spark: SparkSession) -> DataFrame:
    """``task, metric, direction, weight`` as a DataFrame."""
    rows = [(t, m.key, m.direction, m.weight) for t, cfg in TASKS.items() for m in cfg.metrics]
    return spark.createDataFrame(rows, "task string, metric string, direction string, weight double")
