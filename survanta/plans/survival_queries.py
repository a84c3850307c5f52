"""Queries for estimators and curve functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import curve
from ..operators import estimators, prefix
from .inputs import LINEITEM_RET, ORDERS_TTE, lineitem_ret, orders_tte
from .registry import query

# Life table CTE: expects a CTE ``src(g, time, ev)``.
LIFE = """cell AS (SELECT g, time, count(*) AS n, CAST(sum(CAST(ev AS INT)) AS BIGINT) AS d FROM src GROUP BY g, time),
risk AS (SELECT g, time, n, d, CAST(sum(n) OVER (PARTITION BY g ORDER BY time DESC) AS BIGINT) AS r FROM cell),
life AS (SELECT g, time, n, d, r,
  CASE WHEN d = r THEN 0.0 ELSE exp(sum(CASE WHEN d = r THEN 0.0 ELSE ln(1 - d / r) END)
       OVER (PARTITION BY g ORDER BY time)) END AS surv,
  sum(d / r) OVER (PARTITION BY g ORDER BY time) AS cumhaz FROM risk)"""


@query("km_by_priority", f"""WITH {ORDERS_TTE},
src AS (SELECT grp AS g, time, cens AS ev FROM orders_tte), {LIFE}
SELECT g AS grp, time, r AS n_risk, d AS n_event, n - d AS n_censor, round(surv, 9) AS surv FROM life""")
def km_by_priority(spark, sf_dir):
    return estimators.km(orders_tte(spark, sf_dir), "time", "cens", ["grp"]).withColumn(
        "surv", F.round("surv", 9))


@query("km_overall", f"""WITH {LINEITEM_RET},
src AS (SELECT 1 AS g, time, cens AS ev FROM lineitem_ret), {LIFE}
SELECT time, r AS n_risk, d AS n_event, n - d AS n_censor, round(surv, 9) AS surv FROM life""")
def km_overall(spark, sf_dir):
    return estimators.km(lineitem_ret(spark, sf_dir), "time", "cens").withColumn("surv", F.round("surv", 9))


@query("nelson_aalen_by_priority", f"""WITH {ORDERS_TTE},
src AS (SELECT grp AS g, time, cens AS ev FROM orders_tte), {LIFE}
SELECT g AS grp, time, r AS n_risk, d AS n_event, round(cumhaz, 9) AS cumhaz FROM life""")
def nelson_aalen_by_priority(spark, sf_dir):
    return estimators.nelson_aalen(orders_tte(spark, sf_dir), "time", "cens", ["grp"]).withColumn(
        "cumhaz", F.round("cumhaz", 9))


@query("censor_km_overall", f"""WITH {ORDERS_TTE},
src AS (SELECT 1 AS g, time, NOT cens AS ev FROM orders_tte), {LIFE}
SELECT time, r AS n_risk, d AS n_censored, round(surv, 9) AS surv FROM life""")
def censor_km_overall(spark, sf_dir):
    return estimators.censor_km(orders_tte(spark, sf_dir), "time", "cens").drop("surv_before").withColumn(
        "surv", F.round("surv", 9))


@query("km_median_time", f"""WITH {ORDERS_TTE},
src AS (SELECT grp AS g, time, cens AS ev FROM orders_tte), {LIFE}
SELECT g AS grp, min(CASE WHEN surv <= 0.5 THEN time END) AS median_time FROM life GROUP BY g""")
def km_median_time(spark, sf_dir):
    curves = estimators.km(orders_tte(spark, sf_dir), "time", "cens", ["grp"])
    return estimators.median_survival(curves, "time", ["grp"])


@query("average_tie_ranks", f"""WITH {LINEITEM_RET},
cell AS (SELECT grp, time, count(*) AS n FROM lineitem_ret GROUP BY grp, time)
SELECT grp, time, n, CAST(sum(n) OVER (PARTITION BY grp) AS BIGINT) AS size, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS below,
       coalesce(sum(n) OVER w, 0) + (n + 1) / 2.0 AS avg_rank,
       CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) + 1 AS min_rank
FROM cell WINDOW w AS (PARTITION BY grp ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def average_tie_ranks(spark, sf_dir):
    return prefix.rank_cells(lineitem_ret(spark, sf_dir), ["grp"], "time")


@query("exact_quantiles", f"""WITH {LINEITEM_RET}, p(i, q) AS (VALUES (0, 0.0), (1, 0.1), (2, 0.5), (3, 0.75), (4, 1.0)),
s AS (SELECT grp, time, row_number() OVER (PARTITION BY grp ORDER BY time) - 1 AS rn, count(*) OVER (PARTITION BY grp) AS n FROM lineitem_ret),
b AS (SELECT grp, i, q, max(CASE WHEN rn = floor(q * (n - 1)) THEN time END) AS lo,
             max(CASE WHEN rn = least(floor(q * (n - 1)) + 1, n - 1) THEN time END) AS hi, max(n) AS n
      FROM s CROSS JOIN p WHERE rn BETWEEN floor(q * (n - 1)) AND floor(q * (n - 1)) + 1 GROUP BY grp, i, q)
SELECT grp, i AS prob_no, CAST(q AS DOUBLE) AS prob,
       round(lo + (hi - lo) * (q * (n - 1) - floor(q * (n - 1))), 6) AS value FROM b""")
def exact_quantiles(spark, sf_dir):
    out = prefix.quantiles(lineitem_ret(spark, sf_dir), "time", [0.0, 0.1, 0.5, 0.75, 1.0], ["grp"])
    return out.withColumn("value", F.round("value", 6))
