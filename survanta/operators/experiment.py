"""Splits, cross-validation, grid search and the metric table of an experiment."""

from __future__ import annotations

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curve
from ..functions.arrays import doubles
from ..models.adapters import even_grid
from . import metrics as M
from .joins import join_keys
from .prefix import row_numbers
from .tasks import ALL_METRICS

HASH_MAX = float(1 << 48)


def row_hash(row_id: str, seed: int) -> Column:
    """48-bit number from the row id and the seed; the same in every run and engine."""
    text = F.concat(F.col(row_id).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def split(df: DataFrame, test: float = 0.33, seed: int = 42, strat: str | None = None,
          row_id: str = "row_id") -> DataFrame:
    """Add ``is_test``: the ``ceil(test * n)`` rows with the smallest hash (per stratum).

    A stratum with fewer than two rows turns stratification off.
    """
    by = [strat] if strat else []
    if strat:
        least = df.groupBy(strat).count().agg(F.min("count")).first()[0]
        if least is not None and least < 2:
            by = []
    hashed = df.withColumns({"_h": row_hash(row_id, seed), "_hd": row_hash(row_id, seed).cast("double")})
    placed = row_numbers(hashed, by, "_hd", ["_h", row_id], "_no")
    sizes = df.groupBy(*by).agg(F.ceil(F.lit(test) * F.count(F.lit(1))).alias("_take"))
    return join_keys(placed, sizes, by).withColumn("is_test", F.col("_no") <= F.col("_take")).drop(
        "_h", "_hd", "_no", "_take")


def fold(row_id: str, folds: int = 5, seed: int = 42) -> Column:
    """Fold number of a row; needs no shuffle."""
    return F.pmod(row_hash(row_id, seed), F.lit(folds)).cast("int")


def evaluate(model, test: DataFrame, grid, time: str = "time", cens: str = "cens", names=None) -> dict[str, float]:
    """Metrics of a fitted adapter on held-out rows. The event score is ``1 - mean(S)`` and the
    predicted time the expected time. Plain averages share one pass."""
    names = [n.upper() for n in (names or [m.key for m in ALL_METRICS])]
    g = doubles(grid)
    scored = model.survival(test.select(*test.columns), grid, "_sf")
    scored = scored.withColumns({"_score": curve.event_score(F.col("_sf")),
                                 "_pred": curve.expected_time(F.col("_sf"), g, model.from_origin)}).persist()
    y, t, p, s = F.col(cens), F.col(time), F.col("_pred"), F.col("_score")
    plain = {"LOGLOSS_EVENT": M.logloss_column(y, s), "RMSE_EVENT": M.rmse_column(y, s), "RMSE_TIME": M.rmse_column(t, p),
             "R2_TIME": M.r2_column(t, p), "MAPE_TIME": M.mape_column(t, p), "RMSLE_TIME": M.rmsle_column(t, p)}
    own = {"AUC_EVENT": lambda: M.auc(scored, cens, "_score"), "MEDAPE_TIME": lambda: M.medape(scored, time, "_pred"),
           "SPEARMAN_TIME": lambda: M.spearman(scored, time, "_pred"),
           "CI": lambda: M.concordance(scored.withColumn("_risk", -p), time, cens, "_risk"),
           "IBS": lambda: M.ibs(scored, time, cens, "_sf", grid),
           "AUPRC": lambda: M.auprc(scored, time, cens, "_sf", grid)}
    try:
        out = {}
        ask = [n for n in names if n in plain]
        if ask:
            out.update(scored.agg(*[plain[n].alias(n) for n in ask]).first().asDict())
        for n in names:
            if n in own:
                out[n] = own[n]().first()[0]
        return out
    finally:
        scored.unpersist()


@dataclass
class Method:
    """``make(**params)`` returns an adapter; ``grid`` maps a parameter to its values."""

    name: str
    make: object
    grid: dict = field(default_factory=dict)

    def settings(self):
        keys = list(self.grid)
        return [dict(zip(keys, v)) for v in itertools.product(*self.grid.values())] or [{}]


def run(df: DataFrame, features, methods, names, best: str, dataset: str = "dataset", folds: int = 5,
        repeats: int = 20, test: float = 0.33, seed: int = 42, row_id: str = "row_id", time: str = "time",
        cens: str = "cens", n_grid: int = 128, workers: int = 4) -> tuple[DataFrame, DataFrame]:
    """Grid search by cross-validation on the training part, then re-samples of the best setting.

    Returns the metric table (``dataset, method, params, <metric>_mean``) and the fold
    table (``method, params, fold, metric, value``). Fits are submitted from a few
    driver threads; Spark shares the cluster between their jobs.
    """
    spark = df.sparkSession
    direction = {m.key: m.direction for m in ALL_METRICS}[best.upper()]
    keep = list(dict.fromkeys([row_id, time, cens, *features]))
    end = float(df.agg(F.max(time)).first()[0])
    grid = even_grid(0.0, end, n_grid)
    train = split(df.select(*keep), test, seed, None, row_id).where(~F.col("is_test")).drop("is_test")
    folded = train.withColumn("_fold", fold(row_id, folds, seed)).persist()

    def fit_score(method, params, fit_rows, test_rows):
        model = method.make(**params).fit(fit_rows, features, time, cens)
        return evaluate(model, test_rows, grid, time, cens, names)

    def one_fold(job):
        method, params, k = job
        got = fit_score(method, params, folded.where(F.col("_fold") != k).drop("_fold"),
                        folded.where(F.col("_fold") == k).drop("_fold"))
        return [(method.name, json.dumps(params, default=str), k, n, None if v is None else float(v)) for n, v in got.items()]

    def resample(job):
        method, params, r = job
        parts = split(df.select(*keep), test, seed + 1 + r, None, row_id)
        got = fit_score(method, params, parts.where(~F.col("is_test")).drop("is_test"),
                        parts.where(F.col("is_test")).drop("is_test"))
        return [(method.name, json.dumps(params, default=str), n, None if v is None else float(v)) for n, v in got.items()]

    jobs = [(m, p, k) for m in methods for p in m.settings() for k in range(folds)]
    try:
        with ThreadPoolExecutor(workers) as pool:
            rows = [r for part in pool.map(one_fold, jobs) for r in part]
            fold_table = spark.createDataFrame(rows, "method string, params string, fold int, metric string, value double")
            # One row per setting and fold: the grid's size, not the data's.
            means = {}
            for name, params, _, metric, value in rows:
                if metric == best.upper() and value is not None:
                    means.setdefault((name, params), []).append(value)
            chosen = []
            for m in methods:
                ranked = [(sum(v) / len(v), p) for p in m.settings() if (v := means.get((m.name, json.dumps(p, default=str))))]
                if ranked:
                    top = max if direction == "higher" else min
                    chosen.append((m, top(ranked, key=lambda r: r[0])[1]))
            again = [(m, p, r) for m, p in chosen for r in range(repeats)]
            sampled = [r for part in pool.map(resample, again) for r in part]
    finally:
        folded.unpersist()
    long = spark.createDataFrame(sampled, "method string, params string, metric string, value double")
    table = long.groupBy(F.lit(dataset).alias("dataset"), "method", "params").agg(*[
        F.avg(F.when(F.col("metric") == n.upper(), F.col("value"))).alias(f"{n.lower()}_mean") for n in names])
    return table, fold_table
