"""Adapters and survival models on small data with a known signal."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survanta.models import adapters, registry
from survanta.models.cox import CoxPH, derivatives
from survanta.models.kaplan_meier import KaplanMeier
from survanta.models.learners import KNN, GroupRate, classifier, regressor
from survanta.models.survival_boosting import SurvivalGBT
from survanta.models.survival_trees import CraidForest, CraidTree, SurvivalForest, SurvivalTree
from survanta.operators import experiment, metrics
from survanta.operators.neighbors import nearest
from survanta.operators import neighbors


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 400
    a, b = rng.normal(size=n), rng.normal(size=n)
    t = rng.exponential(np.exp(-1.0 * a) * 10) + 0.01
    c = rng.exponential(25, n)
    pdf = pd.DataFrame({"row_id": np.arange(n), "time": np.minimum(t, c).round(2) + 0.01, "cens": t <= c, "a": a, "b": b,
                        "g": np.where(a > 0, "hi", "lo")})
    return spark.createDataFrame(pdf).persist()


GRID = [0.0, 2.0, 5.0, 10.0, 20.0]


def check_curves(out):
    s = np.stack(out.select("sf").toPandas()["sf"].to_numpy())
    assert s.shape[1] == len(GRID)
    assert ((s >= -1e-12) & (s <= 1 + 1e-12)).all() and (np.diff(s, axis=1) <= 1e-9).all()
    return s


def test_cox_recovers_the_effect(data):
    m = CoxPH().fit(data, ["a", "b"])
    assert abs(m.beta[0] - 1.0) < 0.25 and abs(m.beta[1]) < 0.25
    row = derivatives(data, ["a", "b"], "time", "cens", m.beta, m.centre).first()
    assert abs(row["g0"]) < 1e-3 and abs(row["g1"]) < 1e-3
    check_curves(m.survival(data, GRID))
    shrunk = CoxPH(alpha=1000.0).fit(data, ["a", "b"])
    assert abs(shrunk.beta[0]) < abs(m.beta[0])


@pytest.mark.parametrize("make", [
    lambda: SurvivalTree(max_depth=3, min_leaf=20), lambda: SurvivalForest(n_trees=5, max_depth=3, min_leaf=10),
    lambda: CraidTree(max_depth=3), lambda: CraidForest(n_trees=5, max_depth=3, max_features=None),
    lambda: SurvivalGBT(n_trees=4, learning_rate=0.3, checkpoint_every=2, dropout_rate=0.1, subsample=0.8)])
def test_survival_models_rank_subjects(data, make):
    curves = adapters.SurvivalAdapter(make()).fit(data, ["a", "b"])
    check_curves(curves.survival(data, GRID))
    risk = curves.expected_time(data, GRID).withColumn("risk", -F.col("expected_time"))
    assert metrics.concordance(risk, "time", "cens", "risk").first()["ci"] > 0.62


def test_tree_splits_on_the_signal(data):
    m = SurvivalTree(max_depth=1, min_leaf=10).fit(data, ["b", "a"])
    assert m.feat[0, 1] == 1
    none = CraidTree(max_depth=2, signif=1e-12).fit(data, ["b"])
    assert (none.feat < 0).all()


def test_bootstrap_weights_have_the_asked_mean(data):
    f = SurvivalForest(n_trees=4, sample=0.7)
    base = data.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree"))
    total = f._sampled(base).agg(F.sum("w")).first()[0]
    assert abs(total / (400 * 4) - 0.7) < 0.1


@pytest.mark.parametrize("aware", [False, True])
def test_piecewise_with_a_tree(data, aware):
    ad = registry.piecewise("DecisionTreeClassifier", times=4, censor_aware=aware, max_depth=2)
    m = ad.fit(data, ["a", "b"])
    assert len(m.models) == len(m.edges) - 1 == 3
    check_curves(m.survival(data, GRID))
    assert ad.label("DecisionTreeClassifier").endswith("(DecisionTreeClassifier, times=4)")


def test_piecewise_constant_intervals(spark):
    rows = [(i, float(t), e, 1.0) for i, (t, e) in enumerate([(1, False), (2, False), (3, True), (4, True)])]
    df = spark.createDataFrame(rows, "row_id long, time double, cens boolean, x double")
    m = adapters.PiecewiseAdapter(GroupRate(), times=3).fit(df, ["x"])
    assert m.edges == [0.0, 2.5, 4.0]
    assert m.models[0] == 0.0 and m.models[1] == 1.0
    assert m.survival(df).first()["sf"] == [1.0, 0.0]
    assert m.survival(df, [1.0, 2.5, 3.0, 9.0]).first()["sf"] == [1.0, 1.0, 0.0, 0.0]


def test_kaplan_meier_adapter(data):
    m = adapters.SurvivalAdapter(KaplanMeier(("g",))).fit(data, [])
    s = check_curves(m.survival(data, GRID))
    assert (s[:, 0] == 1.0).all()


@pytest.mark.parametrize("kind, params", [
    ("logistic_regression", {"C": 1.0, "class_weight": "balanced", "solver": "lbfgs"}), ("svc", {"kernel": "rbf", "max_iter": 10}),
    ("knn_classifier", {"n_neighbors": 10, "weights": "distance"}), ("gradient_boosting_classifier", {"n_estimators": 3, "learning_rate": 0.1})])
def test_classifiers_give_probabilities(data, kind, params):
    m = adapters.ClassificationAdapter(classifier(kind, **params)).fit(data, ["a", "b"])
    p = m.event_proba(data).select("proba").toPandas()["proba"]
    assert len(p) == 400 and p.between(0, 1).all() and p.nunique() > 1


@pytest.mark.parametrize("kind, params", [
    ("svr", {"C": 10.0, "epsilon": 0.1}), ("svr", {"kernel": "rbf"}), ("elastic_net", {"alpha": 0.01, "l1_ratio": 0.5}),
    ("knn_regressor", {"n_neighbors": 5}), ("decision_tree_regressor", {"max_depth": 3, "criterion": "friedman_mse"})])
def test_regressors_follow_a_line(data, kind, params):
    line = data.withColumn("time", 3.0 * F.col("a") + 20.0)
    m = adapters.RegressionAdapter(regressor(kind, **params)).fit(line, ["a", "b"])
    got = m.predict_time(line).select("time", "pred_time").toPandas()
    assert np.corrcoef(got["time"], got["pred_time"])[0, 1] > 0.85


def test_reparameterise():
    base = classifier("logistic_regression", C=1.0)
    other = base.copy_with(inverse_reg=5.0)
    assert (base.inverse_reg, other.inverse_reg) == (1.0, 5.0)


def test_neighbours_blocked_and_broadcast_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = [(int(i), [float(x) for x in rng.integers(0, 3, 3)]) for i in range(60)]
    q = spark.createDataFrame(v, "query_id long, query_vec array<double>")
    i = spark.createDataFrame(v, "item_id long, item_vec array<double>")
    one = sorted(map(tuple, nearest(q, i, 4, "euclidean").collect()))
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 17)
    monkeypatch.setattr(neighbors, "ITEM_BLOCK", 13)
    assert sorted(map(tuple, nearest(q, i, 4, "euclidean").collect())) == one
    x = np.array([r[1] for r in v])
    for qid in (0, 33):
        d = ((x - x[qid]) ** 2).sum(axis=1)
        want = sorted(range(60), key=lambda j: (d[j], j))[:4]
        assert [r[1] for r in sorted(one, key=lambda r: r[3]) if r[0] == qid] == want


def test_split_share_and_fallback(spark):
    df = spark.createDataFrame([(i, "a" if i else "b") for i in range(100)], "row_id long, g string")
    assert experiment.split(df, 0.33, 42).where("is_test").count() == 33
    assert experiment.split(df, 0.33, 42, "g").where("is_test").count() == 33  # one class is too small


def test_evaluate_gives_all_metrics(data):
    m = adapters.SurvivalAdapter(KaplanMeier(("g",))).fit(data, [])
    got = experiment.evaluate(m, data, [float(t) for t in range(0, 60, 5)])
    assert len(got) == 12 and all(v is not None and np.isfinite(v) for v in got.values())
    assert 0.5 < got["CI"] <= 1 and 0 <= got["IBS"] < 0.25


def test_every_published_method_can_be_built():
    every = registry.methods()
    assert len(every) == 19
    for m in every:
        m.make(**m.settings()[0])


@pytest.mark.parametrize("metric", ["euclidean", "dot"])
def test_pivots_give_the_neighbours_of_brute_force(spark, metric):
    """Clusters, vectors of different lengths, ties and text ids; far fewer distances than pairs."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 4)) * 20
    x = np.round(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 4)), 1)
    x[100:110] = x[99]
    ids = [f"row {j:04d}" for j in range(900)]
    i = spark.createDataFrame(list(zip(ids, x.tolist())), "item_id string, item_vec array<double>")
    q = spark.createDataFrame(list(zip(ids[:60] + ["other"], x[:60].tolist() + [[0.0] * 4])), "query_id string, query_vec array<double>")
    got = {}
    for r in nearest(q, i, 5, metric).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["item_id"]))
    for name, v in zip(ids[:60] + ["other"], [*x[:60], np.zeros(4)]):
        s = np.round(x @ v if metric == "dot" else -((x - v) ** 2).sum(axis=1), 12)
        want = sorted(range(900), key=lambda j: (-s[j], ids[j]))[:5]
        assert [j for _, j in sorted(got[name])] == [ids[j] for j in want]
    formed = neighbors.compared(q, i, 5, metric).agg(F.sum("seen")).first()[0]
    assert formed < (0.4 if metric == "euclidean" else 0.8) * 61 * 900
    assert nearest(q, i.limit(0), 5, metric).count() == 0 and nearest(q.limit(0), i, 5, metric).count() == 0


def test_the_items_next_to_a_pivot_bound_the_search(spark):
    """Evenly spread points: a query's bound is far closer than its group's farthest item, so few distances are formed."""
    x = np.random.default_rng(3).random((4000, 2)) * 30
    i = spark.createDataFrame([(j, v) for j, v in enumerate(x.tolist())], "item_id long, item_vec array<double>")
    q = spark.createDataFrame([(j, v) for j, v in enumerate(x[:200].tolist())], "query_id long, query_vec array<double>")
    got = {(r["query_id"], r["rank"]): r["item_id"] for r in nearest(q, i, 5, "euclidean").collect()}
    for j in range(200):
        assert [got[j, n] for n in range(1, 6)] == np.argsort(((x - x[j]) ** 2).sum(axis=1), kind="stable")[:5].tolist()
    formed = neighbors.compared(q, i, 5, "euclidean").agg(F.sum("seen")).first()[0]
    assert formed < 0.08 * 200 * 4000


def test_neighbour_learner_takes_text_ids(data):
    rows = data.withColumn("row_id", F.concat(F.lit("id "), F.col("row_id")))
    m = regressor("knn_regressor", n_neighbors=3, weights="distance").fit(rows, ["a"], "time")
    got = m.score(rows, "p").select("p", "time").toPandas()
    assert np.allclose(got["p"], got["time"], atol=60) and got["p"].notna().all()
