"""Base learners: fit on a label column, then add a score column to any DataFrame.

A learner has ``fit(df, features, label) -> fitted`` and the fitted object has
``score(df, name) -> DataFrame``. For classifiers the score is the event
probability, for regressors the predicted value.
"""

from __future__ import annotations

import math
from copy import copy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

VECTOR = "_features"


def probability(df: DataFrame, proba: Column | None = None, raw: Column | None = None,
                prediction: Column | None = None) -> DataFrame:
    """Add ``proba`` from whatever a model offers.

    Class probability; else the sigmoid of its decision value; else its prediction,
    taken as is when all predictions are 0/1 and min-max scaled otherwise; else 0.5.
    """
    if proba is not None:
        return df.withColumn("proba", F.greatest(F.least(proba, F.lit(1.0)), F.lit(0.0)))
    if raw is not None:
        return df.withColumn("proba", 1.0 / (1.0 + F.exp(-raw)))
    if prediction is None:
        return df.withColumn("proba", F.lit(0.5))
    y = prediction.cast("double")
    span = df.agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"), F.bool_and(y.isin(0.0, 1.0)).alias("_flags"))
    scaled = F.when(F.col("_flags"), y).when(
        F.col("_hi") > F.col("_lo"), (y - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(span)).withColumn("proba", scaled).drop("_lo", "_hi", "_flags")


def assemble(df: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=VECTOR, handleInvalid="error").transform(df)


class Learner:
    """Shared parameter handling; ``copy_with`` is the re-parameterisation hook."""

    def copy_with(self, **params):
        other = copy(self)
        for k, v in params.items():
            setattr(other, k, v)
        return other


@dataclass
class GroupRate(Learner):
    """Mean label per group of ``by`` columns; unseen groups get the overall mean."""

    by: tuple = ()

    def fit(self, df, features, label):
        y = F.col(label).cast("double")
        overall = df.agg(F.avg(y).alias("_all"))
        groups = df.groupBy(*self.by).agg(F.avg(y).alias("_rate")) if self.by else None
        return _GroupRateModel(self.by, groups, overall)


@dataclass
class _GroupRateModel:
    by: tuple
    groups: DataFrame | None
    overall: DataFrame

    def score(self, df, name):
        out = df.crossJoin(F.broadcast(self.overall))
        if self.groups is None:
            return out.withColumnRenamed("_all", name)
        keys = {b: f"_k_{b}" for b in self.by}
        rates = self.groups.withColumnsRenamed(keys)
        same = [out[b].eqNullSafe(rates[k]) for b, k in keys.items()]
        return out.join(rates, same, "left").withColumn(
            name, F.coalesce("_rate", "_all")).drop("_rate", "_all", *keys.values())


@dataclass
class MLlib(Learner):
    """A pyspark.ml classifier or regressor. ``kind`` selects it, ``params`` are its settings."""

    kind: str
    params: dict = field(default_factory=dict)
    weight: str | None = None      # "balanced" or a weight column
    inverse_reg: float | None = None  # the C of the original grids: regParam = 1 / (C n)
    fourier: dict | None = None    # {"n": .., "seed": .., "gamma": ..}: approximate rbf kernel

    def fit(self, df, features, label):
        estimator = _ESTIMATORS[self.kind](**self.params)
        data = df.withColumn("_y", F.col(label).cast("double"))
        basis = None
        if self.fourier:
            basis = fourier_basis(data, features, **self.fourier)
        data = _vectorise(data, features, basis)
        if self.inverse_reg is not None or self.weight == "balanced":
            row = data.agg(F.count(F.lit(1)), F.sum("_y")).first()
            n, pos = row[0], row[1] or 0.0
            if self.inverse_reg is not None:
                estimator.setRegParam(1.0 / (self.inverse_reg * max(n, 1)))
            if self.weight == "balanced":
                w1, w0 = n / (2.0 * max(pos, 1.0)), n / (2.0 * max(n - pos, 1.0))
                data = data.withColumn("_w", F.when(F.col("_y") > 0, w1).otherwise(w0))
                estimator.setWeightCol("_w")
        if self.weight and self.weight != "balanced":
            estimator.setWeightCol(self.weight)
        model = estimator.setFeaturesCol(VECTOR).setLabelCol("_y").fit(data)
        return MLlibModel(model, tuple(features), basis)


def _vectorise(df, features, basis):
    if basis is None:
        return assemble(df, features)
    return df.withColumn(VECTOR, array_to_vector(basis.column(features)))


@dataclass
class MLlibModel:
    model: object
    features: tuple
    basis: object = None

    def score(self, df, name):
        before = df.columns
        out = self.model.transform(_vectorise(df, self.features, self.basis))
        if "probability" in out.columns and "probability" not in before:
            s = probability(out, proba=vector_to_array("probability")[1])
        elif "rawPrediction" in out.columns and "rawPrediction" not in before:
            s = probability(out, raw=vector_to_array("rawPrediction")[1])
        else:
            s = out.withColumn("proba", F.col("prediction"))
        return s.select(*before, F.col("proba").alias(name))


_ESTIMATORS = {
    "logistic_regression": C.LogisticRegression,
    "linear_svc": C.LinearSVC,
    "gradient_boosting_classifier": C.GBTClassifier,
    "elastic_net": R.LinearRegression,
    "gradient_boosting_regressor": R.GBTRegressor,
}


@dataclass
class FourierBasis:
    """Random Fourier features: an explicit map whose dot product approximates the rbf kernel."""

    weights: list
    shifts: list
    centre: list

    def column(self, features) -> Column:
        w, b, c = np.array(self.weights), np.array(self.shifts), np.array(self.centre)

        @pandas_udf("array<double>")
        def lift(x: pd.Series) -> pd.Series:
            z = (np.stack(x.to_numpy()) - c) @ w + b
            return pd.Series(list(np.sqrt(2.0 / w.shape[1]) * np.cos(z)))

        return lift(F.array(*[F.col(f).cast("double") for f in features]))


def fourier_basis(df: DataFrame, features, n: int = 100, seed: int = 42, gamma: float | str = "scale") -> FourierBasis:
    """Draw the map. ``gamma='scale'`` is 1 / (features x variance), variance over all cells."""
    p = len(features)
    row = df.agg(*[F.avg(f) for f in features], *[F.avg(F.col(f) * F.col(f)) for f in features]).first()
    mean = [float(v) for v in row[:p]]
    if gamma == "scale":
        var = sum(float(v) for v in row[p:]) / p - (sum(mean) / p) ** 2
        gamma = 1.0 / (p * var) if var > 0 else 1.0
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(p, n)) * math.sqrt(2.0 * gamma)
    b = rng.uniform(0.0, 2.0 * math.pi, size=n)
    return FourierBasis(w.tolist(), b.tolist(), mean)


@dataclass
class SVR(Learner):
    """Epsilon-insensitive regression by distributed subgradient sums.

    Minimises ``|w|^2 / (2 C n) + mean(max(0, |y - xw - b| - epsilon))`` on
    standardised features with a decreasing step and an average of the later
    iterates. Each step is one aggregate over the data. The rbf kernel uses random
    Fourier features and is approximate.
    """

    C: float = 1.0
    epsilon: float = 0.1
    kernel: str = "linear"
    steps: int = 60
    n_fourier: int = 50
    seed: int = 42

    def fit(self, df, features, label):
        basis = fourier_basis(df, features, self.n_fourier, self.seed) if self.kernel == "rbf" else None
        x = basis.column(features) if basis else F.array(*[F.col(f).cast("double") for f in features])
        data = df.select(x.alias("x"), F.col(label).cast("double").alias("y")).persist()
        try:
            p = self.n_fourier if basis else len(features)
            cell = [F.get("x", F.lit(j)) for j in range(p)]
            stat = data.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y"),
                            *[F.avg(c) for c in cell], *[F.stddev_pop(c) for c in cell]).first()
            n, y0, ysd = stat[0], float(stat[1]), float(stat[2] or 0.0) or 1.0
            mean = np.array(stat[3:3 + p], float)
            sd = np.array([v or 1.0 for v in stat[3 + p:]], float)
            eps = self.epsilon / ysd
            w, b = np.zeros(p), 0.0
            keep_w, keep_b, kept = np.zeros(p), 0.0, 0
            for it in range(1, self.steps + 1):
                # xw + b in original coordinates keeps the expression short.
                raw = w / sd
                guess = F.lit(float(b - (raw * mean).sum()))
                for j in range(p):
                    guess = guess + cell[j] * float(raw[j])
                err = (F.col("y") - y0) / ysd - guess
                sign = F.when(err > eps, 1.0).when(err < -eps, -1.0).otherwise(0.0)
                row = data.select("x", sign.alias("s")).agg(
                    F.avg("s"), *[F.avg(F.col("s") * c) for c in cell]).first()
                s0 = float(row[0])
                g = (np.array(row[1:], float) - mean * s0) / sd
                step = 1.0 / math.sqrt(it)
                w = w + step * (g - w / (self.C * n))
                b = b + step * s0
                if it > self.steps // 2:
                    keep_w, keep_b, kept = keep_w + w, keep_b + b, kept + 1
            w, b = keep_w / kept, keep_b / kept
        finally:
            data.unpersist()
        raw = w / sd * ysd
        return LinearModel(tuple(features), raw.tolist(), float(y0 + ysd * b - (raw * mean).sum()), basis)


@dataclass
class LinearModel:
    features: tuple
    weights: list
    intercept: float
    basis: object = None

    def score(self, df, name):
        x = self.basis.column(self.features) if self.basis else F.array(
            *[F.col(f).cast("double") for f in self.features])
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        dot = F.aggregate(F.zip_with("_x", w, lambda a, c: a * c), F.lit(self.intercept), lambda a, v: a + v)
        return df.withColumn("_x", x).withColumn(name, dot).drop("_x")


@dataclass
class KNN(Learner):
    """Exact k nearest neighbours (Euclidean); the score is the mean label of the neighbours."""

    k: int = 5
    weights: str = "uniform"
    row_id: str = "row_id"

    def fit(self, df, features, label):
        x = F.array(*[F.col(f).cast("double") for f in features])
        items = df.select(F.col(self.row_id).alias("item_id"), x.alias("item_vec"),
                          F.col(label).cast("double").alias("_y"))
        return _KNNModel(items, tuple(features), self)


@dataclass
class _KNNModel:
    items: DataFrame
    features: tuple
    spec: KNN

    def score(self, df, name):
        from ..operators.neighbors import nearest
        x = F.array(*[F.col(f).cast("double") for f in self.features])
        q = df.select(F.col(self.spec.row_id).alias("query_id"), x.alias("query_vec"))
        hits = nearest(q, self.items.select("item_id", "item_vec"), self.spec.k, "euclidean")
        got = hits.join(self.items.select("item_id", "_y"), "item_id")
        if self.spec.weights == "distance":
            # An exact match takes all the weight, as with an infinite one.
            exact = F.max(F.when(F.col("score") == 0, 1).otherwise(0))
            d = F.sqrt(-F.col("score"))
            inv = F.when(d > 0, 1.0 / d)
            out = got.groupBy("query_id").agg(F.when(
                exact == 1, F.avg(F.when(d == 0, F.col("_y")))).otherwise(
                F.sum(F.col("_y") * inv) / F.sum(inv)).alias(name))
        else:
            out = got.groupBy("query_id").agg(F.avg("_y").alias(name))
        return df.join(out.withColumnRenamed("query_id", "_q"),
                       F.col(self.spec.row_id) == F.col("_q"), "left").drop("_q")


def classifier(kind: str, **params) -> Learner:
    """Classifier by name with the parameter names of the published grids.

    ``solver`` names a way to the same optimum and is not used; ``penalty`` is "l2". An unknown setting is an error.
    """
    return _named(kind, params)


def regressor(kind: str, **params) -> Learner:
    """Regressor by name; see :func:`classifier`."""
    return _named(kind, params)


_RENAMED = {"max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode", "learning_rate": "stepSize",
            "subsample": "subsamplingRate", "max_iter": "maxIter", "alpha": "regParam", "l1_ratio": "elasticNetParam", "random_state": "seed"}


def _trees(kind: str, params: dict) -> Learner:
    from .tree_learners import Trees
    classes, forest = kind.endswith("classifier"), kind.startswith("random_forest")
    own = {"seed" if k == "random_state" else k: v for k, v in params.items()}
    if forest:
        own = {"n_estimators": 100, "bootstrap": True, "max_features": "sqrt" if classes else None} | own
    return Trees(classes, **own)


def _named(kind: str, params: dict) -> Learner:
    if kind.removesuffix("_classifier").removesuffix("_regressor") in ("decision_tree", "random_forest"):
        return _trees(kind, params)
    params = {k: v for k, v in params.items() if v is not None and k != "solver"}
    if params.pop("penalty", "l2") != "l2":
        raise ValueError("penalty must be l2")
    if kind in ("knn_classifier", "knn_regressor"):
        return KNN(k=params.get("n_neighbors", 5), weights=params.get("weights", "uniform"))
    if kind == "svr":
        return SVR(**params)
    fourier = None
    if kind == "svc":
        kind = "linear_svc"
        if params.pop("kernel", "linear") == "rbf":
            fourier = {"n": 100}
    inverse = params.pop("C", None)
    weight = params.pop("class_weight", None)
    out = {_RENAMED.get(k, k): v for k, v in params.items()}
    if kind.startswith("gradient") and "n_estimators" in out:
        out["maxIter"] = out.pop("n_estimators")
    if out.get("maxDepth", 0) > 30:
        raise ValueError("boosted trees are grown to a depth of 30 at most")
    if kind in ("logistic_regression", "linear_svc", "elastic_net"):
        out.setdefault("standardization", False)
    return MLlib(kind, out, weight, inverse, fourier)
