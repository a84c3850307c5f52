"""Methods by name with the parameter grids of the comparison; grids are fixed values."""

from __future__ import annotations

from functools import partial

from ..operators.experiment import Method
from .adapters import ClassificationAdapter, PiecewiseAdapter, RegressionAdapter, SurvivalAdapter
from .cox import CoxPH
from .kaplan_meier import KaplanMeier
from .learners import classifier, regressor
from .survival_boosting import SurvivalGBT
from .survival_trees import CraidForest, CraidTree, SurvivalForest, SurvivalTree

# Label, learner kind and the published grid, each in full.
CLASSIFIERS = (
    ("LogisticRegression", "logistic_regression",
     {"penalty": ["l2"], "C": [0.01, 0.1, 1, 10], "solver": ["liblinear", "lbfgs"], "class_weight": [None, "balanced"], "max_iter": [1000]}),
    ("SVC", "svc", {"kernel": ["linear", "rbf"], "C": [0.1, 1, 10], "class_weight": [None, "balanced"]}),
    ("KNeighborsClassifier", "knn_classifier", {"n_neighbors": [5, 10, 20], "weights": ["uniform", "distance"]}),
    ("DecisionTreeClassifier", "decision_tree_classifier",
     {"max_depth": [5, 10, 20], "min_samples_split": [2, 10], "min_samples_leaf": [1, 5], "criterion": ["gini", "entropy"]}),
    ("RandomForestClassifier", "random_forest_classifier",
     {"n_estimators": [100, 300], "max_depth": [10, 30], "min_samples_split": [2, 10], "min_samples_leaf": [1, 5]}),
    ("GradientBoostingClassifier", "gradient_boosting_classifier",
     {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "max_depth": [2, 3], "subsample": [0.7, 1.0]}))
REGRESSORS = (
    ("ElasticNet", "elastic_net", {"alpha": [0.001, 0.01, 0.1], "l1_ratio": [0.2, 0.5, 0.8], "max_iter": [1000, 5000]}),
    ("DecisionTreeRegressor", "decision_tree_regressor",
     {"max_depth": [5, 10, 20], "min_samples_split": [2, 10], "min_samples_leaf": [1, 5], "criterion": ["squared_error", "friedman_mse"]}),
    ("RandomForestRegressor", "random_forest_regressor",
     {"n_estimators": [100, 300], "max_depth": [10, 30], "min_samples_split": [2, 10], "min_samples_leaf": [1, 5]}),
    ("GradientBoostingRegressor", "gradient_boosting_regressor",
     {"n_estimators": [100, 300], "learning_rate": [0.05, 0.1], "max_depth": [2, 3], "subsample": [0.7, 1.0]}),
    ("SVR", "svr", {"kernel": ["linear", "rbf"], "C": [0.1, 1, 10], "epsilon": [0.1, 0.2]}),
    ("KNeighborsRegressor", "knn_regressor", {"n_neighbors": [5, 10, 20], "weights": ["uniform", "distance"]}))
SURVIVAL = (
    ("KaplanMeierFitter", KaplanMeier, {}),
    ("CoxPHSurvivalAnalysis", CoxPH, {"alpha": [100, 10, 1, 0.1, 0.01, 0.001]}),
    ("RandomSurvivalForest", SurvivalForest, {"n_trees": [50], "max_depth": [5, 20], "min_leaf": [0.001, 0.01, 0.1, 0.25], "seed": [123]}),
    ("SurvivalTree", SurvivalTree, {"max_depth": [None, 20, 30], "min_leaf": [1, 10, 20], "max_features": [None, "sqrt"], "seed": [123]}),
    ("GradientBoostingSurvivalAnalysis", SurvivalGBT,
     {"learning_rate": [0.01, 0.05, 0.1, 0.5], "n_trees": [50], "min_leaf": [1, 10, 50, 100], "max_features": ["sqrt"], "seed": [123]}),
    ("CRAID", CraidTree, {"max_depth": [10], "criterion": ["wilcoxon", "logrank"], "l_reg": [0], "min_leaf": [0.05, 0.01, 0.001]}),
    ("ParallelBootstrapCRAID", CraidForest,
     {"n_trees": [50], "max_depth": [7], "sample": [0.3, 0.7], "l_reg": [0], "criterion": ["tarone-ware", "wilcoxon"],
      "min_leaf": [0.05, 0.01], "max_features": ["sqrt"]}))


def _wrapped(adapter, kind, make, **params):
    return adapter(make(kind, **params))


def _survival(model, **params):
    return SurvivalAdapter(model(**params))


def methods(names=None) -> list[Method]:
    """All comparison methods, or those named."""
    every = [Method(label, partial(_wrapped, ClassificationAdapter, kind, classifier), grid) for label, kind, grid in CLASSIFIERS]
    every += [Method(label, partial(_wrapped, RegressionAdapter, kind, regressor), grid) for label, kind, grid in REGRESSORS]
    every += [Method(label, partial(_survival, model), grid) for label, model, grid in SURVIVAL]
    return [m for m in every if names is None or m.name in names]


def piecewise(base: str, times: int = 8, censor_aware: bool = False, **params) -> PiecewiseAdapter:
    """Interval adapter over a classifier named by its label."""
    kind = {label: k for label, k, _ in CLASSIFIERS}[base]
    return PiecewiseAdapter(classifier(kind, **params), times, censor_aware=censor_aware)
