"""Non-parametric estimators: Kaplan-Meier, Nelson-Aalen, censoring Kaplan-Meier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import place, running


def life_table(df: DataFrame, time: str, cens: str, by=()) -> DataFrame:
    """One row per group and distinct time.

    Columns: ``by``, time, n_risk, n_event, n_censor, surv, surv_before, cumhaz.
    Rows are first combined per time on the map side; the running totals then work
    on that smaller table. Survival is the product of ``1 - d/n``; it is exactly 0
    from a time at which everyone still at risk has the event, which can only be
    the last time of the group.
    """
    by = list(by)
    live = df.where(F.col(time).isNotNull() & F.col(cens).isNotNull())
    # Both counts travel in one array, so every later branch reads the same shuffle.
    cells = live.groupBy(*by, time).agg(
        F.array(F.count(F.lit(1)), F.sum(F.col(cens).cast("long"))).alias("_nd"))
    placed = place(cells, by, time, F.element_at("_nd", 1)).withColumns({
        "_n": F.element_at("_nd", 1), "n_event": F.element_at("_nd", 2)}).drop("_nd")
    seen = running(placed, [time], {"_past": "_n"}, before=True, whole={"_size": "_n"})
    risk = seen.withColumn("n_risk", F.col("_size") - F.col("_past")).withColumns({
        "_last": F.col("n_event") == F.col("n_risk"),
        "_haz": F.col("n_event") / F.col("n_risk"),
    }).withColumn("_log", F.when(F.col("_last"), F.lit(0.0)).otherwise(F.log1p(-F.col("_haz"))))
    acc = running(risk, [time], {"_cumlog": "_log", "cumhaz": "_haz"})
    return acc.select(
        *by, time, "n_risk", "n_event", (F.col("_n") - F.col("n_event")).alias("n_censor"),
        F.when(F.col("_last"), F.lit(0.0)).otherwise(F.exp("_cumlog")).alias("surv"),
        F.exp(F.col("_cumlog") - F.col("_log")).alias("surv_before"),
        "cumhaz")


def km(df: DataFrame, time: str, cens: str, by=()) -> DataFrame:
    """Kaplan-Meier survival function, one curve per ``by`` group."""
    return life_table(df, time, cens, by).select(*by, time, "n_risk", "n_event", "n_censor", "surv")


def nelson_aalen(df: DataFrame, time: str, cens: str, by=()) -> DataFrame:
    """Nelson-Aalen cumulative hazard, one curve per ``by`` group."""
    return life_table(df, time, cens, by).select(*by, time, "n_risk", "n_event", "cumhaz")


def censor_km(df: DataFrame, time: str, cens: str, by=()) -> DataFrame:
    """Kaplan-Meier of the censoring time (event flag inverted)."""
    flipped = df.withColumn("_flip", ~F.col(cens))
    return life_table(flipped, time, "_flip", by).select(
        *by, time, "n_risk", F.col("n_event").alias("n_censored"), "surv", "surv_before")


def median_survival(curve: DataFrame, time: str, by=()) -> DataFrame:
    """First time at which each curve is at or below one half (NULL if never)."""
    hit = F.min(F.when(F.col("surv") <= 0.5, F.col(time)))
    return curve.groupBy(*by).agg(hit.alias("median_time"))


def evaluate(curve: DataFrame, time: str, grid, by=(), value: str = "surv",
             start: float = 1.0) -> DataFrame:
    """Value of a right-continuous step curve at each point of a short grid.

    Returns ``by``, ``k``, ``t``, ``value`` (``start`` before the first step).
    """
    by = list(by)
    points = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("t"))
                                 for k, t in enumerate(grid)])).alias("_g")
    last = F.max_by(F.col(value), F.when(F.col(time) <= F.col("_g.t"), F.col(time)))
    return curve.select(*by, time, value, points).groupBy(*by, "_g").agg(last.alias("_v")).select(
        *by, F.col("_g.k").alias("k"), F.col("_g.t").alias("t"),
        F.coalesce("_v", F.lit(start)).alias("value"))
