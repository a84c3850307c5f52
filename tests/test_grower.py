"""The tree grower: splits against brute force, both phases of growth against each other, and the published settings."""

import itertools
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from survanta.models import grower, registry
from survanta.models.grower import Entropy, Forest, Gini, LogRank, Spec, Variance, best_split
from survanta.models.learners import classifier, regressor
from survanta.models.survival_boosting import SurvivalGBT
from survanta.models.survival_trees import CraidForest, CraidTree, SurvivalForest, SurvivalTree


def histogram(x, c, y, w, spec):
    hist = np.zeros((x.shape[1], spec.bins, spec.channels, spec.objective.sums))
    for i in range(len(x)):
        for f in range(x.shape[1]):
            hist[f, x[i, f], c[i]] += [w[i], w[i] * y[i], w[i] * y[i] ** 2][:spec.objective.sums]
    return hist


def plain_gain(kind, go, c, y, w):
    """The gain of sending the rows in ``go`` to the left, row by row."""
    if kind in ("logrank", "wilcoxon"):
        u = v = 0.0
        for t in sorted(set(c)):
            risk, d = w[c >= t].sum(), (w * y)[c == t].sum()
            left, dl = w[(c >= t) & go].sum(), (w * y)[(c == t) & go].sum()
            k = 1.0 if kind == "logrank" else risk
            u += k * (dl - d * left / risk)
            if risk > 1:
                v += k * k * d * (left / risk) * (1 - left / risk) * (risk - d) / (risk - 1)
        return u * u / v if v > 1e-12 else -1.0

    def loss(at):
        n, p = w[at].sum(), np.average(y[at], weights=w[at])
        if kind == "gini":
            return n * 2 * p * (1 - p)
        if kind == "entropy":
            return n * sum(-q * np.log2(q) for q in (p, 1 - p) if q > 0)
        return (w[at] * (y[at] - p) ** 2).sum()
    return loss(np.ones(len(y), bool)) - loss(go) - loss(~go)


OBJECTIVES = {"gini": Gini(), "entropy": Entropy(), "squared_error": Variance(), "logrank": LogRank(), "wilcoxon": LogRank("wilcoxon")}


@pytest.mark.parametrize("kind", OBJECTIVES)
@pytest.mark.parametrize("categorical", [(), (1,)])
def test_best_split_is_the_best_of_all(kind, categorical):
    rng = np.random.default_rng(3)
    survival = kind in ("logrank", "wilcoxon")
    for _ in range(15):
        n = 40
        x = np.stack([rng.integers(0, 6, n), rng.integers(0, 5, n)], 1)
        c = rng.integers(0, 7, n) if survival else np.zeros(n, int)
        y = rng.integers(0, 2, n).astype(float) if kind != "squared_error" else rng.normal(size=n)
        w = rng.integers(1, 3, n).astype(float)
        spec = Spec(OBJECTIVES[kind], 6, 7 if survival else 1, min_leaf=3, categorical=categorical)
        got = best_split(histogram(x, c, y, w, spec), spec, 0, 1)
        ways = [(f, x[:, f] <= b) for f in (0, 1) for b in range(5) if f not in categorical]
        for f in categorical:
            values = sorted(set(x[:, f]))
            ways += [(f, np.isin(x[:, f], s)) for k in range(1, len(values)) for s in itertools.combinations(values, k)]
        gains = [plain_gain(kind, go, c, y, w) for f, go in ways if w[go].sum() >= 3 and w[~go].sum() >= 3]
        f, go, left = got
        assert plain_gain(kind, go[x[:, f]], c, y, w) == pytest.approx(max(gains))
        assert left[:, 0].sum() == pytest.approx(w[go[x[:, f]]].sum())


@pytest.mark.parametrize("kind", ["gini", "squared_error", "logrank"])
def test_ordered_categories_against_all_subsets(kind):
    """The order of means holds the best subset for classes and numbers; for the log-rank statistic it comes close."""
    rng = np.random.default_rng(5)
    shares = []
    for _ in range(10):
        n, survival = 300, kind == "logrank"
        x = rng.integers(0, 10, (n, 1))
        effect = rng.normal(size=10)[x[:, 0]]
        c = np.minimum(rng.exponential(np.exp(-effect)) * 3, 9).astype(int) if survival else np.zeros(n, int)
        y = (rng.random(n) < 0.7).astype(float) if survival else (effect + rng.normal(size=n) > 0).astype(float)
        made = [best_split(histogram(x, c, y, np.ones(n), s), s, 0, 1) for s in (
            Spec(OBJECTIVES[kind], 10, 10 if survival else 1, categorical=(0,), exact_categories=k) for k in (2, 10))]
        ordered, every = (plain_gain(kind, go[x[:, 0]], c, y, np.ones(n)) for _, go, _ in made)
        shares.append(ordered / every)
    assert min(shares) > (1 - 1e-9 if kind != "logrank" else 0.97)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    n = 900
    a, b, g = rng.normal(size=n), rng.integers(0, 8, n).astype(float), rng.integers(0, 12, n).astype(float)
    t = rng.exponential(np.exp(-a + 3 * np.isin(g, [1, 4, 7, 10])) * 10) + 0.01
    pdf = pd.DataFrame({"row_id": np.arange(n), "time": np.round(t) + 1, "cens": rng.random(n) < 0.8, "a": a, "b": b, "g": g})
    return spark.createDataFrame(pdf).repartition(4, "row_id").persist()


GRID = [0.0, 2.0, 5.0, 10.0, 20.0]


def curves(model, df):
    return np.stack(model.survival(df, GRID).orderBy("row_id").toPandas()["sf"].to_numpy())


@pytest.mark.parametrize("make", [
    lambda local: SurvivalTree(min_leaf=5, local=local), lambda local: SurvivalForest(n_trees=4, max_depth=None, min_leaf=4, local=local),
    lambda local: CraidForest(n_trees=3, min_leaf=0.02, categ=("g",), local=local), lambda local: SurvivalGBT(n_trees=3, max_features="sqrt", subsample=0.7, local=local)])
def test_both_phases_grow_the_same_survival_trees(data, make):
    one, other = (make(local).fit(data, ["a", "b", "g"]) for local in (1 << 17, 60))
    assert np.allclose(curves(one, data), curves(other, data))


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_both_phases_grow_the_same_class_trees(data, criterion):
    scores = []
    for local in (1 << 17, 50):
        made = classifier("random_forest_classifier", n_estimators=5, max_depth=None, min_samples_split=10, criterion=criterion).copy_with(local=local)
        scores.append(made.fit(data, ["a", "b", "g"], "cens").score(data, "p").orderBy("row_id").toPandas()["p"].to_numpy())
    assert np.allclose(*scores) and 0 <= scores[0].min() < scores[0].max() <= 1


def test_few_cells_take_more_passes_and_change_nothing(data, monkeypatch):
    want = curves(SurvivalForest(n_trees=4, max_depth=4, local=60).fit(data, ["a", "b"]), data)
    monkeypatch.setattr(grower, "CELLS", 1)
    assert np.allclose(curves(SurvivalForest(n_trees=4, max_depth=4, local=60).fit(data, ["a", "b"]), data), want)


def test_unlimited_depth_separates_what_bins_separate(data):
    line = data.withColumn("y", F.col("a") * 5 + F.col("b"))
    model = regressor("decision_tree_regressor", max_depth=None).copy_with(bins=2000).fit(line, ["a", "b"], "y")
    got = model.score(line, "p").select("y", "p").toPandas()
    assert np.allclose(got["y"], got["p"])
    stopped = regressor("decision_tree_regressor", max_depth=None, min_samples_split=100).fit(line, ["a", "b"], "y").forest
    sizes = stopped.sums[:, 0]
    assert (sizes < 100).all() and sizes.sum() == 900 and len(stopped.feature) < len(model.forest.feature)
    assert regressor("decision_tree_regressor", max_depth=0).fit(line, ["a"], "y").score(line, "p").select("p").distinct().count() == 1


def test_planted_categories_are_split(data):
    model = CraidTree(max_depth=1, min_leaf=0.01, categ=("g",)).fit(data, ["b", "g"])
    root = model.forest.roots[0]
    go = np.unpackbits(model.forest.sets[root], bitorder="little")
    planted = {model.binning.edges[1].index(v) for v in (1.0, 4.0, 7.0, 10.0)}
    assert model.forest.feature[root] == 1
    assert set(np.flatnonzero(go)) in (planted, set(range(12)) - planted)
    plain = CraidTree(max_depth=1, min_leaf=0.01).fit(data, ["b", "g"]).forest
    assert set(np.flatnonzero(np.unpackbits(plain.sets[plain.roots[0]], bitorder="little"))) not in (planted, set(range(12)) - planted)


def test_missing_values_and_unseen_categories(spark, data):
    model = CraidForest(n_trees=2, categ=("g",)).fit(data, ["a", "g"])
    rows = spark.createDataFrame([(1, None, 3.0), (2, 0.5, 99.0), (3, float("nan"), None)], "row_id long, a double, g double")
    assert curves(model, rows).shape == (3, len(GRID))


def test_model_in_parts_is_the_same_model(data, monkeypatch):
    model = SurvivalForest(n_trees=6, max_depth=None, min_leaf=5).fit(data, ["a", "b"])
    want = curves(model, data)
    from survanta.models import survival_trees
    monkeypatch.setattr(survival_trees, "MODEL_BYTES", 1 + model.forest.nbytes() // 4)
    assert len(model.forest.parts(survival_trees.MODEL_BYTES)) == 4
    assert np.allclose(curves(model, data), want)


def test_one_value_and_equal_rows(spark):
    rows = spark.createDataFrame([(i, 1.0, float(i % 2)) for i in range(300)], "row_id long, x double, y double")
    for local in (1 << 17, 10):
        model = classifier("decision_tree_classifier").copy_with(local=local).fit(rows, ["x"], "y")
        assert model.forest.feature.tolist() == [-1] and model.score(rows, "p").first()["p"] == 0.5


def test_settings_without_a_meaning_are_errors():
    for kind, params in (("decision_tree_classifier", {"criterion": "squared_error"}), ("random_forest_regressor", {"criterion": "gini"}),
                         ("decision_tree_classifier", {"depth": 3}), ("gradient_boosting_classifier", {"max_depth": 31}),
                         ("logistic_regression", {"penalty": "l1"})):
        with pytest.raises((ValueError, TypeError)):
            classifier(kind, **params)
    with pytest.raises(NotImplementedError):
        CraidTree(l_reg=0.1)


def test_every_published_setting_can_be_built():
    for m in registry.methods():
        for s in m.settings():
            m.make(**s)


ORDERS = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(ORDERS), reason="needs the larger table")
@pytest.mark.parametrize("depth", [None, 20, 30])
def test_fifty_deep_trees(spark, depth):
    from survanta.plans.inputs import orders_tte
    df = orders_tte(spark, ORDERS).repartition(8).persist()
    model = SurvivalForest(n_trees=50, max_depth=depth, min_leaf=20).fit(df, ["price", "acctbal"])
    leaves, nodes = int((model.forest.feature < 0).sum()), len(model.forest.feature)
    assert nodes == 2 * leaves - 50 and nodes < 50 * 2 * 15_000 / 20
    assert (np.diff(curves(model, df.limit(500)), axis=1) <= 1e-12).all()


def test_exact_bins_try_every_cut(spark):
    """With more values than bins, bins=None still finds the best cut that quantile bins step over (survival_root_splits)."""
    rows = [(i * 40 + x, float(x), 10.0 + (x > 5) * 10.0 + i % 3, True) for x in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "row_id long, x1 double, time double, cens boolean")
    exact = SurvivalTree(max_depth=1, min_leaf=20, criterion="logrank", bins=None, time_bins=None).fit(df, ["x1"])
    assert exact.binning.edges[0] == [float(x) for x in range(40)]
    assert exact.forest.root_splits(exact.binning)[0][1:] == ("x1", 5.0, 180.0, 1020.0)


def test_a_subtree_is_counted_once_per_level_as_node_by_node(monkeypatch):
    """Small nodes of one level share a histogram pass; the tree, its leaves and their sums are those of one node at a time."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 32, (4000, 2))
    y = (rng.random(4000) < 0.3).astype(float)
    w = grower.draws(rng.integers(0, 1 << 62, 4000), 0, 1.0, 42)
    x, y, w = x[w > 0], y[w > 0], w[w > 0]
    spec = Spec(Gini(), 32, 1, 1, 30, 5, 10, 1, 1.0, (), seed=42, rows=4000)
    calls, count = [], np.bincount
    monkeypatch.setattr(grower.np, "bincount", lambda *a, **k: calls.append(1) or count(*a, **k))
    made = grower.grow_rows(x, np.zeros(len(x), int), y, w, spec, 0, 1, 0)
    monkeypatch.undo()
    # Channel 1 alone takes the path of one node at a time; a single channel leaves every gain as it is.
    plain = grower.grow_rows(x, np.ones(len(x), int), y, w, spec, 0, 1, 0)
    assert len(made.feature) == len(plain.feature) > 100
    assert len(calls) <= 2 * 31

    def leaf_sums(nodes):
        forest = Forest.of(nodes, np.array([0]), 2)
        return forest.sums[forest.start[forest.walk(x)[:, 0]]]
    assert np.array_equal(leaf_sums(made), leaf_sums(plain))
