"""Queries for the adapters, person-period tables and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..functions.arrays import doubles
from ..models import adapters
from ..models.kaplan_meier import KaplanMeier
from ..models.learners import KNN, GroupRate, probability
from ..operators.neighbors import nearest
from .inputs import ORDERS_TTE, orders_tte, table
from .registry import query
from .survival_queries import LIFE

PTS = [0.0, 400.0, 800.0, 1200.0, 1600.0, 2000.0]
# Interval edges at quantiles 0, 1/4, 1/2, 3/4, 1 of the time, as rows j, a, b.
EDGES = ORDERS_TTE + """,
q AS (SELECT list_concat([0.0], quantile_cont(time, [0.25, 0.5, 0.75, 1.0])) AS e FROM orders_tte),
iv AS (SELECT j, e[j] AS a, e[j + 1] AS b FROM q CROSS JOIN (SELECT unnest(range(1, 5)) AS j))"""


def _pp(aware: bool) -> str:
    used = "((cens AND time > a AND time <= b) OR time > b)" if aware else "time > a"
    return f"""pp AS (SELECT o.*, j, CASE WHEN cens AND time > a AND time <= b THEN 1 ELSE 0 END AS y
 FROM orders_tte o JOIN iv ON {used})"""


def _piecewise_sql(aware: bool) -> str:
    return f"""WITH {EDGES}, {_pp(aware)},
r AS (SELECT segment, j, avg(y) AS p FROM pp GROUP BY segment, j),
c AS (SELECT segment, list(1 - p ORDER BY j) AS k FROM r GROUP BY segment),
s AS (SELECT segment, [list_reduce(k[1:n], lambda a, x: a * x) FOR n IN range(1, 5)] AS s FROM c)
SELECT row_id, round(s[1], 9) AS s1, round(s[2], 9) AS s2, round(s[3], 9) AS s3, round(s[4], 9) AS s4,
 round((1 + s[1]) / 2 * e[2] + (s[1] + s[2]) / 2 * (e[3] - e[2]) + (s[2] + s[3]) / 2 * (e[4] - e[3]) + (s[3] + s[4]) / 2 * (e[5] - e[4]), 6) AS expected_time,
 CASE WHEN s[1] <= 0.5 THEN e[2] WHEN s[2] <= 0.5 THEN e[3] WHEN s[3] <= 0.5 THEN e[4] WHEN s[4] <= 0.5 THEN e[5] END AS median_time
FROM orders_tte JOIN s USING (segment) CROSS JOIN q"""


def _piecewise(spark, sf_dir, aware):
    df = orders_tte(spark, sf_dir)
    m = adapters.PiecewiseAdapter(GroupRate(("segment",)), times=5, censor_aware=aware).fit(df, ["price"])
    out = m.survival(df, name="sf")
    g = doubles(m.grid())
    cells = [F.round(F.get("sf", F.lit(i)), 9).alias(f"s{i + 1}") for i in range(4)]
    return out.select("row_id", *cells, F.round(curve.expected_time(F.col("sf"), g, True), 6).alias("expected_time"),
                      curve.median_time(F.col("sf"), g).alias("median_time"))


@query("person_period", f"""WITH {EDGES}, {_pp(False)}
SELECT CAST(j AS INT) AS interval, segment, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM pp GROUP BY j, segment""")
def person_period(spark, sf_dir):
    from ..operators import grids
    df = orders_tte(spark, sf_dir)
    e = grids.edges(df, "time", 5)
    long = adapters.person_period(df.crossJoin(F.broadcast(e)), F.col("edges"))
    return long.groupBy("interval", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("events"))


@query("piecewise_curves", _piecewise_sql(False))
def piecewise_curves(spark, sf_dir):
    return _piecewise(spark, sf_dir, False)


@query("piecewise_censor_aware_curves", _piecewise_sql(True))
def piecewise_censor_aware_curves(spark, sf_dir):
    return _piecewise(spark, sf_dir, True)


@query("classification_adapter", f"""WITH {ORDERS_TTE},
r AS (SELECT segment, avg(CAST(cens AS INT)) AS p FROM orders_tte GROUP BY segment)
SELECT row_id, round(p, 9) AS proba, round(1 - p, 9) AS s_last, round((1 - p) * (SELECT max(time) FROM orders_tte), 6) AS expected_time,
 round(-ln(1 - p), 9) AS h_last FROM orders_tte JOIN r USING (segment)""")
def classification_adapter(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    m = adapters.ClassificationAdapter(GroupRate(("segment",)), n_grid=16).fit(df, ["price"])
    out = m.expected_time(m.hazard(m.survival(m.event_proba(df))))
    return out.select("row_id", F.round("proba", 9).alias("proba"), F.round(F.element_at("sf", -1), 9).alias("s_last"),
                      F.round("expected_time", 6).alias("expected_time"), F.round(F.element_at("hf", -1), 9).alias("h_last"))


@query("regression_adapter", f"""WITH {ORDERS_TTE},
r AS (SELECT grp, avg(time) AS t FROM orders_tte GROUP BY grp), m AS (SELECT max(time) AS hi FROM orders_tte),
g AS (SELECT grp, t, k, hi / 32.0 * k AS x, hi / 32.0 AS w FROM r CROSS JOIN m CROSS JOIN (SELECT unnest(range(0, 33)) AS k)),
a AS (SELECT grp, sum(w * CASE WHEN k = 0 THEN 0.5 * CAST(x < t AS INT) WHEN k = 32 THEN 0.5 * CAST(x < t AS INT) ELSE CAST(x < t AS INT) END) AS et,
  CAST(sum(CAST(x < t AS INT)) AS DOUBLE) AS ones FROM g GROUP BY grp)
SELECT row_id, round(t, 6) AS pred_time, round(et, 6) AS expected_time, ones FROM orders_tte JOIN r USING (grp) JOIN a USING (grp)""")
def regression_adapter(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    m = adapters.RegressionAdapter(GroupRate(("grp",)), n_grid=33).fit(df, ["price"])
    out = m.expected_time(m.survival(m.predict_time(df)))
    return out.select("row_id", F.round("pred_time", 6).alias("pred_time"), F.round("expected_time", 6).alias("expected_time"),
                      F.aggregate("sf", F.lit(0.0), lambda a, x: a + x).alias("ones"))


@query("survival_adapter", f"""WITH {ORDERS_TTE},
src AS (SELECT grp AS g, time, cens AS ev FROM orders_tte), {LIFE},
e AS (SELECT g, k, coalesce(min(CASE WHEN time <= 400.0 * k THEN surv END), 1.0) AS s, coalesce(max(CASE WHEN time <= 400.0 * k THEN cumhaz END), 0.0) AS h
 FROM life CROSS JOIN (SELECT unnest(range(0, 6)) AS k) GROUP BY g, k),
w AS (SELECT g, sum(s * CASE WHEN k IN (0, 5) THEN 200.0 ELSE 400.0 END) AS et, min(CASE WHEN s <= 0.5 THEN 400.0 * k END) AS med,
 min(CASE WHEN k = 5 THEN s END) AS sl, max(CASE WHEN k = 5 THEN h END) AS hl FROM e GROUP BY g)
SELECT row_id, round(sl, 9) AS s_last, round(hl, 9) AS h_last, round(et, 6) AS expected_time FROM orders_tte JOIN w ON grp = g""")
def survival_adapter(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    m = adapters.SurvivalAdapter(KaplanMeier(("grp",)), n_grid=6).fit(df, [])
    out = m.expected_time(m.hazard(m.survival(df, PTS), PTS), PTS)
    return out.select("row_id", F.round(F.element_at("sf", -1), 9).alias("s_last"),
                      F.round(F.element_at("hf", -1), 9).alias("h_last"), F.round("expected_time", 6).alias("expected_time"))


@query("curve_comparison", f"""WITH {ORDERS_TTE},
p AS (SELECT segment, avg(CAST(cens AS INT)) AS p FROM orders_tte GROUP BY segment),
r AS (SELECT segment, avg(time) AS t FROM orders_tte GROUP BY segment),
g AS (SELECT unnest([0.0, 400.0, 800.0, 1200.0, 1600.0, 2000.0]) AS x)
SELECT 'classification' AS model, row_id, CAST(x AS DOUBLE) AS t, round(1 - p, 9) AS value FROM orders_tte JOIN p USING (segment) CROSS JOIN g
UNION ALL SELECT 'regression', row_id, CAST(x AS DOUBLE), CASE WHEN x < t THEN 1.0 ELSE 0.0 END FROM orders_tte JOIN r USING (segment) CROSS JOIN g""")
def curve_comparison(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    base = GroupRate(("segment",))
    made = {"classification": adapters.ClassificationAdapter(base).fit(df, []),
            "regression": adapters.RegressionAdapter(base).fit(df, [])}
    return adapters.compare(made, df, "row_id", PTS).withColumn("value", F.round("value", 9))


@query("prediction_card", f"""WITH {ORDERS_TTE},
r AS (SELECT segment, avg(CAST(cens AS INT)) AS p FROM orders_tte GROUP BY segment)
SELECT row_id, round(1 - p, 9) AS s_first, round((1 - p) * 2000.0, 6) AS expected_time, round(p, 9) AS risk FROM orders_tte JOIN r USING (segment)""")
def prediction_card(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    m = adapters.ClassificationAdapter(GroupRate(("segment",))).fit(df, [])
    return adapters.score(m, df, 2000.0).select(
        "row_id", F.round(F.get("sf", F.lit(0)), 9).alias("s_first"),
        F.round("expected_time", 6).alias("expected_time"), F.round("risk", 9).alias("risk"))


@query("probability_fallbacks", f"""WITH {ORDERS_TTE}
SELECT row_id, round(1 / (1 + exp(-acctbal)), 9) AS from_decision, CAST(cens AS INT) * 1.0::DOUBLE AS from_labels,
 round((price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()), 9) AS from_values FROM orders_tte""")
def probability_fallbacks(spark, sf_dir):
    df = orders_tte(spark, sf_dir)
    a = probability(df, raw=F.col("acctbal")).withColumnRenamed("proba", "a")
    b = probability(a, prediction=F.col("cens").cast("int")).withColumnRenamed("proba", "b")
    c = probability(b, prediction=F.col("price"))
    return c.select("row_id", F.round("a", 9).alias("from_decision"), F.col("b").alias("from_labels"),
                    F.round("proba", 9).alias("from_values"))


@query("nearest_neighbors", """WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, round(list_sum([(a.e[i] - b.e[i]) ** 2 FOR i IN range(1, len(a.e) + 1)]), 12) AS d2 FROM n a CROSS JOIN n b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, item_id) AS rk FROM d)
SELECT query_id, item_id, CAST(rk AS INT) AS rank FROM r WHERE rk <= 5""")
def nearest_neighbors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    i = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("item_vec"))
    return nearest(q, i, 5, "euclidean").select("query_id", "item_id", "rank")


@query("knn_classifier", """WITH s AS (SELECT c_custkey AS row_id, c_acctbal / 1000.0 AS x, CAST(c_nationkey AS DOUBLE) AS z, CAST(c_mktsegment = 'BUILDING' AS INT) AS y FROM customer),
d AS (SELECT a.row_id, b.row_id AS other, b.y, round((b.x - a.x) ** 2 + (b.z - a.z) ** 2, 12) AS d2 FROM s a CROSS JOIN s b),
r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d2, other) AS rk FROM d),
k AS (SELECT * FROM r WHERE rk <= 5)
SELECT row_id, round(avg(y), 9) AS uniform, round(coalesce(avg(CASE WHEN d2 = 0 THEN y END), sum(CASE WHEN d2 > 0 THEN y / sqrt(d2) END) / sum(CASE WHEN d2 > 0 THEN 1 / sqrt(d2) END)), 7) AS by_distance
FROM k GROUP BY row_id""")
def knn_classifier(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_id"), (F.col("c_acctbal") / 1000.0).alias("x"),
        F.col("c_nationkey").cast("double").alias("z"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    a = KNN(5).fit(df, ["x", "z"], "y").score(df, "uniform")
    b = KNN(5, "distance").fit(df, ["x", "z"], "y").score(a, "by_distance")
    return b.select("row_id", F.round("uniform", 9).alias("uniform"), F.round("by_distance", 7).alias("by_distance"))
