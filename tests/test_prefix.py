"""Prefix sums, ranks and quantiles against plain windows and NumPy, with many small ranges."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from survanta.functions.arrays import doubles, search_left, search_right
from survanta.operators import prefix
from survanta.operators.estimators import km, life_table, nelson_aalen


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_CELLS", 1)


def skewed(spark, n=600):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b"], n))
    v = np.where(rng.random(n) < 0.34, 5.0, rng.integers(0, 80, n).astype(float))
    pdf = pd.DataFrame({"g": g, "v": v, "e": rng.random(n) < 0.4})
    pdf.loc[pdf.index % 50 == 0, "g"] = None
    return pdf, spark.createDataFrame(pdf)


def test_average_ranks_match_pandas(spark):
    pdf, df = skewed(spark)
    got = {(r["g"], r["v"]): r["avg_rank"] for r in prefix.rank_cells(df, ["g"], "v").collect()}
    pdf["r"] = pdf.groupby("g", dropna=False)["v"].rank()
    for g, v, r in pdf[["g", "v", "r"]].itertuples(index=False):
        assert got[(g, v)] == r


def test_row_numbers_are_a_permutation(spark):
    _, df = skewed(spark)
    df = df.withColumn("id", F.monotonically_increasing_id())
    out = prefix.row_numbers(df, ["g"], "v", ["v", "id"]).toPandas()
    for _, part in out.groupby("g", dropna=False):
        part = part.sort_values(["v", "id"])
        assert list(part["position"]) == list(range(1, len(part) + 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob_no"]: r["value"] for r in prefix.quantiles(df, "v", probs).collect()}
    for i, q in enumerate(np.quantile(values, probs)):
        assert abs(got[i] - q) < 1e-9


def test_search_matches_numpy(spark):
    grid = [1.0, 2.0, 2.0, 3.5, 9.0]
    xs = [0.0, 1.0, 2.0, 2.1, 9.0, 10.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", search_left(doubles(grid), F.col("x")).alias("l"), search_right(doubles(grid), F.col("x")).alias("r"))
    for r in df.collect():
        assert r["l"] == np.searchsorted(grid, r["x"], "left")
        assert r["r"] == np.searchsorted(grid, r["x"], "right")


def test_kaplan_meier_without_censoring_is_the_empirical_tail(spark):
    pdf, df = skewed(spark)
    got = km(df.withColumn("e", F.lit(True)), "v", "e").toPandas()
    for t, s in zip(got["v"], got["surv"]):
        assert abs(s - (pdf["v"] > t).mean()) < 1e-9


def test_hazard_bounds_minus_log_survival(spark):
    _, df = skewed(spark)
    t = life_table(df, "v", "e").toPandas()
    t = t[t["surv"] > 0]
    assert (t["cumhaz"] <= -np.log(t["surv"]) + 1e-9).all()
    na = nelson_aalen(df, "v", "e").toPandas().set_index("v")["cumhaz"]
    assert np.allclose(na.loc[t["v"]], t["cumhaz"])


def test_no_single_partition_exchange_over_rows(spark, sf_dir):
    from survanta.plans.inputs import orders_tte
    plan = km(orders_tte(spark, sf_dir), "time", "cens", ["grp"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_a_hot_group_is_spread_without_automatic_broadcasts(spark, monkeypatch):
    """99 per cent of the rows in one group: no task gets more than two shares of the rows."""
    monkeypatch.setattr(prefix, "RANGE_CELLS", 1000)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = 80_000
        df = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.pmod(F.hash("id"), F.lit(50))).otherwise(-1).alias("g"), (F.col("id") * 7919 % n).cast("double").alias("v"))
        out = prefix.row_numbers(df, ["g"], "v", ["v"])
        per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(per_task) == n and max(per_task) < 3 * n / 8
        hot = out.where("g = -1").agg(F.count_distinct("position"), F.min("position"), F.max("position")).first()
        assert tuple(hot) == (79_200, 1, 79_200)
        placed = prefix.place(df, ["g"], "v")
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
        ends = placed.where("g = -1").select(prefix.BUCKET).distinct().count()
        assert 6 <= ends <= 9 and placed.where("g <> -1").select(prefix.BUCKET).distinct().count() == 1
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_many_groups_have_few_ends(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("g"), F.col("id").cast("double").alias("v"))
    placed = prefix.place(df, ["g"], "v")
    assert placed.select(prefix.BUCKET).distinct().collect()[0][0] == 0
    got = prefix.row_numbers(df, ["g"], "v", ["v"])
    assert got.groupBy("g").agg(F.max("position").alias("m")).where("m <> 4").count() == 0
