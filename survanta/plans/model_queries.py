"""Queries that fit models and score the given tables, and experiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..functions.arrays import doubles
from ..models import adapters, cox, registry
from ..models.learners import GroupRate, classifier, regressor
from ..models.survival_boosting import SurvivalGBT
from ..models.survival_trees import CraidForest, CraidTree, SurvivalForest, SurvivalTree
from ..operators import experiment
from .inputs import ORDERS_TTE, orders_tte, spread
from .registry import query

FEATURES = ["price", "acctbal"]
GRID = [250.0 * k for k in range(10)]


@query("cox_derivatives", f"""WITH {ORDERS_TTE},
c AS (SELECT time, price - 2.5 AS x, acctbal - 4.5 AS z, cens, exp((price - 2.5) * 0.1::DOUBLE + (acctbal - 4.5) * -0.05::DOUBLE) AS r FROM orders_tte),
s AS (SELECT time, sum(r) AS s, sum(r * x) AS sx, sum(r * z) AS sz, sum(r * x * x) AS sxx, sum(r * x * z) AS sxz, CAST(sum(CAST(cens AS INT)) AS DOUBLE) AS d,
 sum(CASE WHEN cens THEN x ELSE 0 END) AS dx, sum(CASE WHEN cens THEN z ELSE 0 END) AS dz FROM c GROUP BY time),
k AS (SELECT time, d, dx, dz, sum(s) OVER w AS s, sum(sx) OVER w AS sx, sum(sz) OVER w AS sz, sum(sxx) OVER w AS sxx, sum(sxz) OVER w AS sxz FROM s WINDOW w AS (ORDER BY time DESC))
SELECT round(sum(dx * 0.1 + dz * -0.05 - d * ln(s)), 4) AS ll, round(sum(dx - d * sx / s), 4) AS g0, round(sum(dz - d * sz / s), 4) AS g1,
 round(sum(d * (sxx / s - sx * sx / s / s)), 4) AS h0_0, round(sum(d * (sxz / s - sx * sz / s / s)), 4) AS h0_1 FROM k WHERE d > 0""")
def cox_derivatives(spark, sf_dir):
    row = cox.derivatives(orders_tte(spark, sf_dir), FEATURES, "time", "cens", [0.1, -0.05], [2.5, 4.5])
    return row.select(*[F.round(c, 4).alias(c) for c in ("ll", "g0", "g1", "h0_0", "h0_1")])


def _curves(spark, sf_dir, adapter):
    df = spread(orders_tte(spark, sf_dir))
    m = adapter.fit(df, FEATURES)
    return m.survival(df, GRID).select("row_id", F.round(F.element_at("sf", -1), 6).alias("s_last"),
                                       F.round(curve.expected_time(F.col("sf"), doubles(GRID), m.from_origin), 4).alias("expected_time"))


def _model_query(name, make):
    @query(name)
    def run(spark, sf_dir):
        return _curves(spark, sf_dir, make())
    return run


_model_query("cox_ph", lambda: adapters.SurvivalAdapter(cox.CoxPH(alpha=0.1)))
_model_query("survival_tree", lambda: adapters.SurvivalAdapter(SurvivalTree(max_depth=None, min_leaf=20)))
_model_query("survival_forest", lambda: adapters.SurvivalAdapter(SurvivalForest(n_trees=50, max_depth=20, min_leaf=0.01)))
_model_query("survival_gbt", lambda: adapters.SurvivalAdapter(SurvivalGBT(n_trees=50, learning_rate=0.1, min_leaf=10, max_features="sqrt")))
_model_query("craid_tree", lambda: adapters.SurvivalAdapter(CraidTree(max_depth=10, criterion="wilcoxon", min_leaf=0.01)))
_model_query("craid_forest", lambda: adapters.SurvivalAdapter(CraidForest(n_trees=50, max_depth=7, sample=0.7, min_leaf=0.01)))
_model_query("logistic_regression", lambda: adapters.ClassificationAdapter(classifier("logistic_regression", C=1.0)))
_model_query("linear_svc", lambda: adapters.ClassificationAdapter(classifier("svc", kernel="linear", C=1.0, max_iter=30)))
_model_query("rbf_svc", lambda: adapters.ClassificationAdapter(classifier("svc", kernel="rbf", C=1.0, max_iter=20)))
_model_query("decision_tree_classifier", lambda: adapters.ClassificationAdapter(classifier("decision_tree_classifier", max_depth=20, min_samples_split=10, min_samples_leaf=5, criterion="entropy")))
_model_query("random_forest_classifier", lambda: adapters.ClassificationAdapter(classifier("random_forest_classifier", n_estimators=100, max_depth=30, min_samples_split=10, min_samples_leaf=5)))
_model_query("gradient_boosting_classifier", lambda: adapters.ClassificationAdapter(classifier("gradient_boosting_classifier", n_estimators=5, max_depth=3)))
_model_query("elastic_net", lambda: adapters.RegressionAdapter(regressor("elastic_net", alpha=0.01, l1_ratio=0.5)))
_model_query("decision_tree_regressor", lambda: adapters.RegressionAdapter(regressor("decision_tree_regressor", max_depth=20, min_samples_split=10, min_samples_leaf=5, criterion="friedman_mse")))
_model_query("random_forest_regressor", lambda: adapters.RegressionAdapter(regressor("random_forest_regressor", n_estimators=100, max_depth=30, min_samples_split=10, min_samples_leaf=5)))
_model_query("gradient_boosting_regressor", lambda: adapters.RegressionAdapter(regressor("gradient_boosting_regressor", n_estimators=5, max_depth=3)))
_model_query("linear_svr", lambda: adapters.RegressionAdapter(regressor("svr", C=1.0, steps=25)))
_model_query("rbf_svr", lambda: adapters.RegressionAdapter(regressor("svr", C=1.0, kernel="rbf", steps=15)))
_model_query("piecewise_decision_tree", lambda: registry.piecewise("DecisionTreeClassifier", times=4, censor_aware=True, max_depth=3))


# Few different values, so that bins are exact and every engine tries the same cuts.
COARSE = ORDERS_TTE + """, coarse AS (SELECT floor(price * 8) AS x1, floor(acctbal) AS x2, CAST(cens AS INT) AS e, floor(time / 90) AS t FROM orders_tte)"""


def coarse(spark, sf_dir):
    return orders_tte(spark, sf_dir).select("row_id", F.floor(F.col("price") * 8).cast("double").alias("x1"), F.floor("acctbal").cast("double").alias("x2"),
                                            "cens", F.floor(F.col("time") / 90).cast("double").alias("time"))


ROOT = "criterion string, feature string, threshold double, n_left double, n_right double"


@query("tree_root_splits", f"""WITH {COARSE},
cells AS (SELECT f, v, CAST(count(*) AS DOUBLE) AS n, CAST(sum(e) AS DOUBLE) AS s, sum(t) AS st FROM (SELECT 'x1' AS f, x1 AS v, e, t FROM coarse UNION ALL SELECT 'x2', x2, e, t FROM coarse) GROUP BY f, v),
c AS (SELECT f, v, sum(n) OVER w AS l, sum(n) OVER (PARTITION BY f) AS n, sum(s) OVER w AS sl, sum(s) OVER (PARTITION BY f) AS s, sum(st) OVER w AS tl, sum(st) OVER (PARTITION BY f) AS st FROM cells WINDOW w AS (PARTITION BY f ORDER BY v)),
h AS (SELECT *, n - l AS r, s - sl AS sr, st - tl AS tr FROM c WHERE n > l),
g AS (SELECT 'gini' AS criterion, f, v, l, r, 2 * s * (n - s) / n - 2 * sl * (l - sl) / l - 2 * sr * (r - sr) / r AS gain FROM h
 UNION ALL SELECT 'entropy', f, v, l, r, (coalesce(sl * ln(nullif(sl, 0) / l), 0) + coalesce((l - sl) * ln(nullif(l - sl, 0) / l), 0) + coalesce(sr * ln(nullif(sr, 0) / r), 0) + coalesce((r - sr) * ln(nullif(r - sr, 0) / r), 0)) FROM h
 UNION ALL SELECT c.criterion, f, v, l, r, tl * tl / l + tr * tr / r - st * st / n FROM h CROSS JOIN (SELECT unnest(['squared_error', 'friedman_mse']) AS criterion) c)
SELECT criterion, f AS feature, v AS threshold, l AS n_left, r AS n_right FROM g QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY gain DESC, f, v) = 1""")
def tree_root_splits(spark, sf_dir):
    df, rows = coarse(spark, sf_dir).persist(), []
    for criterion in ("gini", "entropy", "squared_error", "friedman_mse"):
        classes = criterion in ("gini", "entropy")
        make, label = (classifier, "cens") if classes else (regressor, "time")
        m = make(f"decision_tree_{'classifier' if classes else 'regressor'}", max_depth=1, criterion=criterion).fit(df, ["x1", "x2"], label)
        rows += [(criterion, *r[1:]) for r in m.forest.root_splits(m.binning)]
    df.unpersist()
    return spark.createDataFrame(rows, ROOT)


@query("survival_root_splits", f"""WITH {COARSE},
x AS (SELECT f, v, t, count(*) AS n, sum(e) AS d FROM (SELECT 'x1' AS f, x1 AS v, e, t FROM coarse UNION ALL SELECT 'x2', x2, e, t FROM coarse) GROUP BY f, v, t),
k AS (SELECT DISTINCT f, v AS cut FROM x),
l AS (SELECT k.f, k.cut, x.t, coalesce(sum(n) FILTER (x.v <= k.cut), 0) AS nl, coalesce(sum(d) FILTER (x.v <= k.cut), 0) AS dl, sum(n) AS n, sum(d) AS d FROM k JOIN x USING (f) GROUP BY k.f, k.cut, x.t),
r AS (SELECT f, cut, CAST(nl AS DOUBLE) AS nl, CAST(n AS DOUBLE) AS n, CAST(dl AS DOUBLE) AS dl, CAST(d AS DOUBLE) AS d, CAST(sum(nl) OVER w AS DOUBLE) AS yl, CAST(sum(n) OVER w AS DOUBLE) AS y FROM l WINDOW w AS (PARTITION BY f, cut ORDER BY t DESC)),
q AS (SELECT criterion, r.*, CASE criterion WHEN 'logrank' THEN 1 WHEN 'wilcoxon' THEN y ELSE sqrt(y) END AS w FROM r CROSS JOIN (SELECT unnest(['logrank', 'wilcoxon', 'tarone-ware']) AS criterion)),
s AS (SELECT criterion, f, cut, sum(nl) AS l, sum(n - nl) AS r, sum(w * (dl - d * yl / y)) AS u, sum(CASE WHEN y > 1 THEN w * w * d * (yl / y) * (1 - yl / y) * (y - d) / (y - 1) ELSE 0 END) AS v FROM q GROUP BY criterion, f, cut)
SELECT criterion, f AS feature, cut AS threshold, l AS n_left, r AS n_right FROM s WHERE l >= 20 AND r >= 20 AND v > 1e-12 QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY u * u / v DESC, f, cut) = 1""")
def survival_root_splits(spark, sf_dir):
    df, rows = coarse(spark, sf_dir).persist(), []
    for criterion in ("logrank", "wilcoxon", "tarone-ware"):
        m = SurvivalTree(max_depth=1, min_leaf=20, criterion=criterion, bins=None, time_bins=None).fit(df, ["x1", "x2"])
        rows += [(criterion, *r[1:]) for r in m.forest.root_splits(m.binning)]
    df.unpersist()
    return spark.createDataFrame(rows, ROOT)


HASH = "CAST('0x' || substr(md5(CAST(row_id AS VARCHAR) || ':{s}'), 1, 12) AS BIGINT)"


@query("holdout_split", f"""WITH {ORDERS_TTE}, h AS (SELECT row_id, grp, row_number() OVER (PARTITION BY grp ORDER BY {HASH.format(s=42)}, row_id) AS n, count(*) OVER (PARTITION BY grp) AS c FROM orders_tte)
SELECT row_id, n <= ceil(0.33::DOUBLE * c) AS is_test FROM h""")
def holdout_split(spark, sf_dir):
    return experiment.split(orders_tte(spark, sf_dir), 0.33, 42, "grp").select("row_id", "is_test")


@query("cross_validation_folds", f"""WITH {ORDERS_TTE} SELECT row_id, CAST({HASH.format(s=42)} % 5 AS INT) AS fold FROM orders_tte""")
def cross_validation_folds(spark, sf_dir):
    return orders_tte(spark, sf_dir).select("row_id", experiment.fold("row_id").alias("fold"))


@query("experiment_grid_search", f"""WITH {ORDERS_TTE}, h AS (SELECT *, row_number() OVER (ORDER BY {HASH.format(s=42)}, row_id) AS n, count(*) OVER () AS c, CAST({HASH.format(s=42)} % 3 AS INT) AS fold FROM orders_tte),
t AS (SELECT * FROM h WHERE n > ceil(0.33::DOUBLE * c)), f AS (SELECT unnest([0, 1, 2]) AS k),
a AS (SELECT k, segment AS g, avg(CAST(cens AS INT)) AS p FROM t JOIN f ON fold <> k GROUP BY k, segment), b AS (SELECT k, grp AS g, avg(CAST(cens AS INT)) AS p FROM t JOIN f ON fold <> k GROUP BY k, grp)
SELECT '{{"by": ["segment"]}}' AS params, k AS fold, round(sqrt(avg((CAST(cens AS INT) - p) ** 2)), 9) AS rmse FROM t JOIN a ON fold = k AND segment = g GROUP BY k
UNION ALL SELECT '{{"by": ["grp"]}}', k, round(sqrt(avg((CAST(cens AS INT) - p) ** 2)), 9) FROM t JOIN b ON fold = k AND grp = g GROUP BY k""")
def experiment_grid_search(spark, sf_dir):
    rate = experiment.Method("GroupRate", lambda by: adapters.ClassificationAdapter(GroupRate(by)), {"by": [("segment",), ("grp",)]})
    _, folds = experiment.run(orders_tte(spark, sf_dir), ["segment", "grp"], [rate], ["RMSE_EVENT"], "RMSE_EVENT",
                              folds=3, repeats=1, n_grid=4)
    return folds.select("params", "fold", F.round("value", 9).alias("rmse"))


@query("experiment_metric_table")
def experiment_metric_table(spark, sf_dir):
    tree = experiment.Method("DecisionTreeClassifier", lambda d: adapters.ClassificationAdapter(classifier("decision_tree_classifier", max_depth=d)), {"d": [2, 4]})
    table, _ = experiment.run(orders_tte(spark, sf_dir), FEATURES, [tree], ["AUC_EVENT", "LOGLOSS_EVENT", "RMSE_TIME"],
                              "LOGLOSS_EVENT", dataset="orders", folds=2, repeats=2, n_grid=8)
    return table
