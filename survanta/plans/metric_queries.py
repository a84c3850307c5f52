"""Queries for curve functions and the twelve metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..functions.arrays import doubles
from ..operators import metrics
from .inputs import ORDERS_TTE, SCORED, orders_tte, scored
from .registry import query
from .survival_queries import LIFE

GRID = [250.0 * k for k in range(10)]
CURVES = ORDERS_TTE + """,
curves AS (SELECT row_id, time, cens, grp, price, [1.0 / (1.0 + price * k * 0.15) FOR k IN range(0, 10)] AS sf,
  [250.0 * k FOR k IN range(0, 10)] AS grid FROM orders_tte)"""
# The same curves in long form, one row per grid point.
LONG = CURVES + """,
long AS (SELECT row_id, time, cens, grp, k, CAST(250.0 * k AS DOUBLE) AS t, sf[k + 1] AS s,
  CASE WHEN k < 9 THEN sf[k + 2] END AS s_next FROM curves CROSS JOIN (SELECT unnest(range(0, 10)) AS k))"""


def curves(spark, sf_dir):
    one = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: 1.0 / (1.0 + F.col("price") * k * 0.15))
    return orders_tte(spark, sf_dir).select(
        "row_id", "time", "cens", "grp", "price", one.alias("sf"), doubles(GRID).alias("grid"))


@query("curve_hazard", f"""WITH {LONG}
SELECT row_id, round(sum(h), 7) AS total_hazard, round(max(h), 7) AS last_hazard FROM
 (SELECT row_id, -ln(greatest(least(s, 1.0), 1e-12)) AS h FROM long) GROUP BY row_id""")
def curve_hazard(spark, sf_dir):
    h = curves(spark, sf_dir).select("row_id", curve.hazard(F.col("sf")).alias("h"))
    return h.select("row_id", F.round(F.aggregate("h", F.lit(0.0), lambda a, x: a + x), 7).alias("total_hazard"),
                    F.round(F.array_max("h"), 7).alias("last_hazard"))


@query("curve_expected_time", f"""WITH {LONG}
SELECT row_id, round(sum(CASE WHEN k < 9 THEN 250.0 * (s + s_next) / 2 END), 6) AS expected,
 round(sum(CASE WHEN k < 9 THEN 250.0 * (s + s_next) / 2 END), 6) AS expected_from_origin FROM long GROUP BY row_id""")
def curve_expected_time(spark, sf_dir):
    s, g = F.col("sf"), F.col("grid")
    later = F.slice(s, 2, 9), F.slice(g, 2, 9)
    return curves(spark, sf_dir).select(
        "row_id", F.round(curve.expected_time(s, g), 6).alias("expected"),
        F.round(curve.expected_time(*later, from_origin=True), 6).alias("expected_from_origin"))


@query("curve_median_time", f"""WITH {LONG}
SELECT row_id, min(CASE WHEN s <= 0.5 THEN t END) AS median_time FROM long GROUP BY row_id""")
def curve_median_time(spark, sf_dir):
    return curves(spark, sf_dir).select("row_id", curve.median_time(F.col("sf"), F.col("grid")).alias("median_time"))


@query("curve_event_proba", f"""WITH {CURVES}
SELECT row_id, round(1 - sf[10], 9) AS proba, round(1 - list_sum(sf) / 10, 9) AS score FROM curves""")
def curve_event_proba(spark, sf_dir):
    return curves(spark, sf_dir).select(
        "row_id", F.round(curve.event_proba(F.col("sf")), 9).alias("proba"),
        F.round(curve.event_score(F.col("sf")), 9).alias("score"))


@query("curve_at_true_time", f"""WITH {CURVES}
SELECT row_id, round(sf[least(CAST(ceil(time / 250.0) AS INT), 9) + 1], 9) AS sf_true FROM curves""")
def curve_at_true_time(spark, sf_dir):
    return curves(spark, sf_dir).select("row_id", F.round(
        curve.at_true_time(F.col("sf"), F.col("grid"), F.col("time")), 9).alias("sf_true"))


@query("curve_step_lookup", f"""WITH {CURVES}
SELECT row_id, round(CASE WHEN time < 500 THEN 1.0 ELSE sf[least(CAST(ceil(time / 250.0) AS INT), 9) + 1] END, 9) AS s_step,
 round(sf[least(CAST(floor(time / 250.0) AS INT), 9) + 1], 9) AS s_before FROM curves""")
def curve_step_lookup(spark, sf_dir):
    s, g = F.slice(F.col("sf"), 3, 8), F.slice(F.col("grid"), 3, 8)
    return curves(spark, sf_dir).select(
        "row_id", F.round(curve.step_at(s, g, F.col("time")), 9).alias("s_step"),
        F.round(curve.step_before(F.col("sf"), F.col("grid"), F.col("time")), 9).alias("s_before"))


@query("curve_interpolation", f"""WITH {CURVES},
j AS (SELECT *, CAST(floor(time / 250.0) AS INT) AS i FROM curves)
SELECT row_id, round(CASE WHEN i >= 9 THEN sf[10] ELSE sf[i + 1] + (sf[i + 2] - sf[i + 1]) * (time - grid[i + 1]) / (grid[i + 2] - grid[i + 1]) END, 9) AS s_linear FROM j""")
def curve_interpolation(spark, sf_dir):
    return curves(spark, sf_dir).select("row_id", F.round(
        curve.interpolate(F.col("sf"), F.col("grid"), F.col("time")), 9).alias("s_linear"))


@query("curve_from_rates", f"""WITH {CURVES}
SELECT row_id, round(list_reduce([1 - least(r, 1.0) FOR r IN [price * k * 0.04 FOR k IN range(0, 10)]], lambda a, x: a * x), 9) AS s_last,
 round(list_reduce([1 - least(r, 1.0) FOR r IN [price * k * 0.04 FOR k IN range(0, 5)]], lambda a, x: a * x), 9) AS s_fifth FROM curves""")
def curve_from_rates(spark, sf_dir):
    rates = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.col("price") * k * 0.04)
    s = curves(spark, sf_dir).select("row_id", curve.survival_from_rates(rates).alias("s"))
    return s.select("row_id", F.round(F.get("s", F.lit(9)), 9).alias("s_last"),
                    F.round(F.get("s", F.lit(4)), 9).alias("s_fifth"))


@query("time_grid", f"""WITH {ORDERS_TTE},
b AS (SELECT grp, min(time) AS lo, max(time) AS hi FROM orders_tte GROUP BY grp)
SELECT grp, k, round(lo + k * (hi - lo) / 15.0, 6) AS t_from_min, round(k * hi / 15.0, 6) AS t_from_zero
FROM b CROSS JOIN (SELECT unnest(range(0, 16)) AS k)""")
def time_grid(spark, sf_dir):
    from ..operators.grids import grid
    by_min = grid(orders_tte(spark, sf_dir), "time", 16, start_at_zero=False, by=["grp"])
    by_zero = grid(orders_tte(spark, sf_dir), "time", 16, by=["grp"])
    a = by_min.select("grp", F.posexplode("grid").alias("k", "t_from_min"))
    b = by_zero.select("grp", F.posexplode("grid").alias("k", "t_from_zero"))
    return a.join(b, ["grp", "k"]).select("grp", F.col("k").cast("long").alias("k"),
        F.round("t_from_min", 6).alias("t_from_min"), F.round("t_from_zero", 6).alias("t_from_zero"))


@query("quantile_edges", f"""WITH {ORDERS_TTE},
q AS (SELECT grp, max(time) AS hi, quantile_cont(time, [1/7.0, 2/7.0, 3/7.0, 4/7.0, 5/7.0, 6/7.0]) AS mid FROM orders_tte GROUP BY grp),
e AS (SELECT grp, unnest(list_distinct(list_concat(list_concat([0.0], mid), [hi]))) AS edge FROM q)
SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY edge) - 1 AS k, round(edge, 6) AS edge FROM e""")
def quantile_edges(spark, sf_dir):
    from ..operators.grids import edges
    e = edges(orders_tte(spark, sf_dir), "time", 8, by=["grp"])
    return e.select("grp", F.posexplode("edges").alias("k", "edge")).select(
        "grp", F.col("k").cast("long").alias("k"), F.round("edge", 6).alias("edge"))


@query("metric_auc_event", f"""WITH {SCORED},
c AS (SELECT grp, score, sum(CAST(cens AS INT)) AS p, sum(1 - CAST(cens AS INT)) AS n FROM scored GROUP BY grp, score),
r AS (SELECT grp, p, n, coalesce(sum(n) OVER (PARTITION BY grp ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM c)
SELECT grp, round(sum(p * (u + n / 2.0)) / (sum(p) * sum(n)), 9) AS auc_event FROM r GROUP BY grp""")
def metric_auc_event(spark, sf_dir):
    return metrics.auc(scored(spark, sf_dir), "cens", "score", ["grp"]).withColumn("auc_event", F.round("auc_event", 9))


@query("metric_logloss_event", f"""WITH {SCORED}
SELECT grp, round(avg(-(CASE WHEN cens THEN ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
 ELSE ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)) END)), 9) AS logloss_event FROM scored GROUP BY grp""")
def metric_logloss_event(spark, sf_dir):
    return metrics.logloss(scored(spark, sf_dir), "cens", "score", ["grp"]).withColumn(
        "logloss_event", F.round("logloss_event", 9))


@query("metric_rmse_event", f"""WITH {SCORED}
SELECT grp, round(sqrt(avg((CAST(cens AS INT) - score) ** 2)), 9) AS rmse_event FROM scored GROUP BY grp""")
def metric_rmse_event(spark, sf_dir):
    return metrics.rmse(scored(spark, sf_dir), "cens", "score", ["grp"], "rmse_event").withColumn(
        "rmse_event", F.round("rmse_event", 9))


@query("metric_event_score_variants", f"""WITH {CURVES},
v AS (SELECT grp, cens, 1 - list_sum(sf) / 10 AS a, sf[least(CAST(ceil(time / 250.0) AS INT), 9) + 1] AS b FROM curves)
SELECT grp, round(sqrt(avg((CAST(cens AS INT) - a) ** 2)), 9) AS rmse_mean,
 round(sqrt(avg((CAST(cens AS INT) - b) ** 2)), 9) AS rmse_sf_at_time FROM v GROUP BY grp""")
def metric_event_score_variants(spark, sf_dir):
    base = curves(spark, sf_dir)
    df = metrics.with_event_score(base, "sf", name="a")
    df = metrics.with_event_score(df, "sf", F.col("grid"), "time", "sf_at_time", "b")
    y = F.col("cens")
    return df.groupBy("grp").agg(F.round(metrics.rmse_column(y, F.col("a")), 9).alias("rmse_mean"),
                                 F.round(metrics.rmse_column(y, F.col("b")), 9).alias("rmse_sf_at_time"))


@query("metric_time_errors", f"""WITH {SCORED}
SELECT grp, round(sqrt(avg((time - pred) ** 2)), 7) AS rmse_time,
 round(1 - avg((time - pred) ** 2) / var_pop(time), 9) AS r2_time,
 round(sqrt(avg((ln(1 + greatest(time, 0)) - ln(1 + greatest(pred, 0))) ** 2)), 9) AS rmsle_time,
 round(avg(abs((time - pred) / greatest(time, 1))) * 100, 7) AS mape_time FROM scored GROUP BY grp""")
def metric_time_errors(spark, sf_dir):
    t, p = F.col("time"), F.col("pred")
    return scored(spark, sf_dir).groupBy("grp").agg(
        F.round(metrics.rmse_column(t, p), 7).alias("rmse_time"), F.round(metrics.r2_column(t, p), 9).alias("r2_time"),
        F.round(metrics.rmsle_column(t, p), 9).alias("rmsle_time"), F.round(metrics.mape_column(t, p), 7).alias("mape_time"))


@query("metric_medape_time", f"""WITH {SCORED}
SELECT grp, round(quantile_cont(abs((time - pred) / greatest(time, 1)) * 100, 0.5), 7) AS medape_time FROM scored GROUP BY grp""")
def metric_medape_time(spark, sf_dir):
    return metrics.medape(scored(spark, sf_dir), "time", "pred", ["grp"]).withColumn("medape_time", F.round("medape_time", 7))


@query("metric_spearman_time", f"""WITH {SCORED},
r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY time) + (count(*) OVER (PARTITION BY grp, time) - 1) / 2.0 AS a,
 rank() OVER (PARTITION BY grp ORDER BY pred) + (count(*) OVER (PARTITION BY grp, pred) - 1) / 2.0 AS b FROM scored)
SELECT grp, round(corr(a, b), 9) AS spearman_time FROM r GROUP BY grp""")
def metric_spearman_time(spark, sf_dir):
    return metrics.spearman(scored(spark, sf_dir), "time", "pred", ["grp"]).withColumn(
        "spearman_time", F.round("spearman_time", 9))


@query("metric_concordance", f"""WITH {SCORED}
SELECT a.grp, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 9) AS ci
FROM scored a JOIN scored b ON a.grp = b.grp AND a.cens AND (a.time < b.time OR (a.time = b.time AND NOT b.cens)) GROUP BY a.grp""")
def metric_concordance(spark, sf_dir):
    return metrics.concordance(scored(spark, sf_dir), "time", "cens", "score", ["grp"]).withColumn("ci", F.round("ci", 9))


@query("metric_ibs", f"""WITH {LONG},
src AS (SELECT grp AS g, time, NOT cens AS ev FROM orders_tte), {LIFE},
cens_km AS (SELECT g, time, surv, lag(surv, 1, 1.0) OVER (PARTITION BY g ORDER BY time) AS before FROM life),
ahead AS (SELECT g, k, coalesce(min(CASE WHEN time <= 250.0 * k THEN surv END), 1.0) AS gt FROM cens_km CROSS JOIN (SELECT unnest(range(0, 10)) AS k) GROUP BY g, k),
part AS (SELECT l.grp, l.k, CASE WHEN l.cens AND l.time <= l.t THEN s * s / c.before WHEN l.time > l.t THEN (1 - s) ** 2 / a.gt ELSE 0 END AS bs
  FROM long l JOIN cens_km c ON c.g = l.grp AND c.time = l.time JOIN ahead a ON a.g = l.grp AND a.k = l.k),
bs AS (SELECT grp, k, avg(bs) AS bs FROM part GROUP BY grp, k)
SELECT grp, round(sum(bs * CASE WHEN k IN (0, 9) THEN 125.0 ELSE 250.0 END) / 2250.0, 9) AS ibs FROM bs GROUP BY grp""")
def metric_ibs(spark, sf_dir):
    return metrics.ibs(curves(spark, sf_dir), "time", "cens", "sf", GRID, ["grp"]).withColumn("ibs", F.round("ibs", 9))


@query("metric_auprc", f"""WITH {CURVES},
f AS (SELECT *, i / 10.0 AS phi FROM curves CROSS JOIN (SELECT unnest(range(0, 11)) AS i)),
p AS (SELECT row_id, grp, i, sf[least(CAST(floor(time * phi / 250.0) AS INT), 9) + 1]
  - CASE WHEN NOT cens THEN 0 WHEN i = 0 THEN sf[10] ELSE sf[CAST(least(floor(time / phi / 250.0), 9) AS INT) + 1] END AS pr FROM f)
SELECT grp, round(sum(pr * CASE WHEN i IN (0, 10) THEN 0.5 ELSE 1.0 END) / 10 / count(DISTINCT row_id), 9) AS auprc FROM p GROUP BY grp""")
def metric_auprc(spark, sf_dir):
    return metrics.auprc(curves(spark, sf_dir), "time", "cens", "sf", GRID, ["grp"], steps=10).withColumn(
        "auprc", F.round("auprc", 9))


@query("metric_custom", f"""WITH {SCORED}
SELECT grp, round(max(abs(time - pred)), 6) AS worst_error FROM scored GROUP BY grp""")
def metric_custom(spark, sf_dir):
    worst = lambda truth, guess: F.round(F.max(F.abs(truth - guess)), 6)
    return metrics.custom(scored(spark, sf_dir), worst, ["grp"], "worst_error", truth="time", guess="pred")
