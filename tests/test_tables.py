"""Ranking, recommendation, interval-model and leaderboard rules on small metric tables."""

import pytest

from survanta.functions.numbers import format_number, format_short
from survanta.operators import metric_tables as mt
from survanta.operators import piecewise, prefix, ranking, recommend
from survanta.operators.tasks import TASKS
from survanta.sources import store
from pyspark.sql import functions as F

P, C = "PiecewiseClassifWrapSA", "PiecewiseCensorAwareClassifWrapSA"


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_CELLS", 1)


def table(spark, columns, rows, dataset="ds"):
    schema = "dataset string, method string, " + ", ".join(f"{c}_mean double" for c in columns)
    return spark.createDataFrame([(r[0], *r[1:]) if len(r) == len(columns) + 2 else (dataset, *r) for r in rows], schema)


EVENT = ["auc_event", "logloss_event", "rmse_event"]


def test_rank_block(spark):
    df = table(spark, ["ci", "ibs"], [("middle", .70, .20), ("best", .85, .10), ("worst", .60, .30)])
    t = ranking.blocks(df).orderBy("survival_position").collect()
    assert [r["method"] for r in t] == ["best", "middle", "worst"]
    assert [r["survival_position"] for r in t] == [1, 2, 3]
    d = ranking.diagnostics(df).first()
    assert d["survival_missing"] == "AUPRC_mean" and d["survival_present"] == "CI_mean, IBS_mean"


def test_average_ranks_put_missing_last(spark):
    df = table(spark, ["ibs"], [("a", 1.0), ("b", None), ("c", None), ("d", 3.0)])
    got = {r["method"]: r["rank"] for r in ranking.metric_ranks(df).collect()}
    assert got == {"a": 1.0, "b": 3.5, "c": 3.5, "d": 2.0}


def test_allow_list(spark):
    df = table(spark, EVENT, [(" Alpha ", .9, .2, .3), ("Beta", .8, .4, .3), ("Ignored", 1.0, .1, .3)])
    kept = mt.normalize_methods(df, ["Alpha", "Beta"])
    assert sorted(r["method"] for r in kept.collect()) == ["Alpha", "Beta"]
    assert ranking.diagnostics(kept).first()["rows"] == 2


def test_best_variant_per_pair(spark):
    df = table(spark, EVENT, [
        (f"{P}(Tree, times=4)", .70, .50, .40), (f"{P}(Tree, times=8)", .90, .20, .20),
        (f"{C}(Tree, times=16)", .85, .30, .25), (f"{C}(Tree, times=32)", .75, .45, .35), ("Base", .6, .6, .5)])
    got = sorted(r["method"] for r in piecewise.extract(df).collect())
    assert got == sorted([f"{P}(Tree, times=8)", f"{C}(Tree, times=16)"])


def test_full_coverage_beats_a_higher_score(spark):
    df = table(spark, ["auc_event"], [("ds1", f"{P}(M, times=8)", .90), ("ds1", f"{P}(M, times=16)", .70),
                                      ("ds2", f"{P}(M, times=16)", .80)])
    assert piecewise.global_times(df).first()["times"] == 16


def test_variant_selection(spark):
    df = table(spark, EVENT, [(f"{P}(M, times=4)", .70, .50, .40), (f"{P}(M, times=16)", .82, .20, .18), (f"{P}(M, times=32)", .78, .35, .30)])
    wanted = spark.createDataFrame([("ds", P, "M"), ("ds", C, "M")], "dataset string, family string, base_model string")
    got = {r["family"]: (r["method"], r["precomputed"]) for r in piecewise.variant_labels(df, wanted).collect()}
    assert got == {P: (f"{P}(M, times=16)", True), C: (None, False)}
    run_time = {r["family"]: r["method"] for r in piecewise.variant_labels(df, wanted, default_times=8).collect()}
    assert run_time[C] == f"{C}(M, times=8)"


def test_interval_gain(spark):
    df = table(spark, EVENT, [("ClassifWrapSA(DecisionTreeClassifier)", .60, .90, .50),
                              (f"{P}(DecisionTreeClassifier, times=8)", .95, .20, .10), (f"{P}(DecisionTreeClassifier, times=16)", .80, .40, .30)])
    p = piecewise.pairs(df)
    s = piecewise.summary(p).first()
    assert (s["win_rate"], s["best_times"], s["datasets"]) == (100.0, "8", 1)
    c = piecewise.cards(p).first()
    assert c["improved"] == 1 and abs(c["model_gain"] - 100.0) < 1e-9
    d = piecewise.details(p).first()
    assert d["variant"] == "Piecewise, times=8" and abs(d["auc_delta"] - 35.0) < 1e-9


def test_overall_uses_task_medians(spark):
    cols = ["dataset", "method", "classification_position", "regression_position", "survival_position"]
    rows = [("ds1", "A", 1, 2, 1), ("ds2", "A", 2, 1, 1), ("ds1", "B", 2, 1, 2), ("ds2", "B", 1, 3, 3)]
    out = ranking.overall_all(spark.createDataFrame(rows, cols)).orderBy("overall_position").collect()
    assert [r["method"] for r in out] == ["A", "B"] and out[0]["datasets"] == 2


def test_recommend_event(spark):
    df = table(spark, EVENT, [("Weak", .62, .55, .42), ("StrongModel", .91, .22, .18)])
    r = recommend.run(df, "classification").first()
    assert (r["recommended_method"], r["score"]) == ("StrongModel", 100)
    assert "позиция 1 из 2" in r["top_models"][0]["metrics"][0]
    assert "StrongModel" in recommend.facts(recommend.run(df, "classification")).first()["text"]


def test_lower_is_better_decides(spark):
    df = table(spark, ["ci", "ibs", "auprc"], [("LowIbsModel", .80, .10, .70), ("HighIbsModel", .80, .30, .70)])
    assert recommend.run(df, "survival").first()["recommended_method"] == "LowIbsModel"


def test_no_metrics_no_recommendation(spark):
    df = table(spark, ["ci"], [("A", .8), ("B", .7)])
    assert recommend.run(df, "regression").count() == 0


def test_regression_order(spark):
    df = table(spark, ["rmse_time", "r2_time"], [("KNeighborsClassifier", 100.0, .10), ("ElasticNet", 12.0, .55), ("RandomForestRegressor", 8.0, .80)])
    top = recommend.run(df, "regression").first()["top_models"]
    assert [m["method"] for m in top] == ["RandomForestRegressor", "ElasticNet", "KNeighborsClassifier"]


def test_interval_rows_join_the_recommendation(spark):
    df = table(spark, EVENT, [("Base", .6, .6, .5)])
    extra = table(spark, EVENT, [(f"{P}(Tree, times=8)", .9, .1, .1)])
    r = recommend.run(df, "classification", extra).first()
    assert r["recommended_method"] == f"{P}(Tree, times=8)" and len(r["why"]) == 4


def test_candidates(spark):
    df = table(spark, ["ci", "ibs"], [("Good", .9, .1), ("Kept", .5, .5)])
    tasks = spark.createDataFrame([("Good", "survival"), ("Kept", "survival")], "method string, task string")
    assert recommend.best_candidate(df, tasks).first()["method"] == "Good"
    assert recommend.best_candidate(df, tasks, preferred="Kept").first()["method"] == "Kept"


def test_lookup_missing_upsert(spark):
    df = table(spark, ["auc_event", "logloss_event"], [("METHOD one", .72, None)])
    want = spark.createDataFrame([("ds", " method ONE", "AUC_EVENT"), ("ds", "method one", "logloss_event"), ("ds", "other", "auc_event")],
                                 "dataset string, method string, metric string")
    got = {(r["method"].strip(), r["metric"]): r["value"] for r in mt.lookup(df, want).collect()}
    assert got[("method ONE", "auc_event")] == .72 and got[("method one", "logloss_event")] is None
    assert mt.missing(df, want).count() == 2
    fresh = table(spark, ["auc_event", "logloss_event"], [("Method One", .1, .31), ("other", .5, .6)])
    after = {r["method"]: (r["auc_event_mean"], r["logloss_event_mean"]) for r in mt.upsert(df, fresh).collect()}
    assert after == {"METHOD one": (.72, .31), "other": (.5, .6)}


def test_leaderboard_store(spark, tmp_path):
    df = table(spark, ["ci", "ibs", "auc_event"], [(d, m, v, 1 - v, v) for d in ("x", "y") for m, v in (("A", .9), ("B", .5), ("C", .4), ("D", .3))])
    store.write_tables(ranking.leaderboards(df), str(tmp_path))
    rows = store.read_leaderboard(spark, str(tmp_path)).collect()
    assert [r["method"] for r in rows] == list("ABCD") and [r["is_top_three"] for r in rows] == [True, True, True, False]
    assert rows[0]["avg_position"] == "1"


def test_number_texts(spark):
    df = spark.createDataFrame([(123.456,), (0.5,), (0.0625,), (None,), (100.0,)], "x double")
    assert [r[0] for r in df.select(format_number(F.col("x"))).collect()] == ["123.5", "0.5", "0.062", "нет данных", "100"]
    assert [r[0] for r in df.select(format_short(F.col("x"))).collect()] == ["123.46", "0.5", "0.06", "—", "100"]


def test_weights_sum_to_one():
    for task in TASKS.values():
        assert abs(sum(m.weight for m in task.metrics) - 1) < 1e-12
