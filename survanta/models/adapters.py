"""Adapters: every model's prediction as a survival curve on a shared time grid.

``Adapter(base, ...).fit(df, features, time, cens)`` returns a :class:`Curves`
object. Its methods add columns to any DataFrame of subjects, batch or streaming.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import curve
from ..functions.arrays import doubles
from ..operators import grids


def time_bounds(df: DataFrame, time: str) -> tuple[float, float]:
    row = df.agg(F.min(time), F.max(time)).first()
    lo, hi = row[0], row[1]
    if lo is None or not float("-inf") < lo < hi < float("inf"):
        return 0.0, 1.0
    return float(lo), float(hi)


def even_grid(start: float, end: float, n: int) -> list[float]:
    if n == 1:
        return [start]
    step = (end - start) / (n - 1)
    return [start + i * step for i in range(n - 1)] + [end]


@dataclass
class Curves:
    """A fitted adapter. Subclasses implement :meth:`survival`."""

    bounds: tuple = (0.0, 1.0)
    n_grid: int = 128
    start_at_zero: bool = True
    from_origin: bool = False

    def grid(self) -> list[float]:
        return even_grid(0.0 if self.start_at_zero else self.bounds[0], self.bounds[1], self.n_grid)

    def survival(self, df: DataFrame, times=None, name: str = "sf") -> DataFrame:
        raise NotImplementedError

    def _over(self, df, times, make, name):
        grid = list(times) if times is not None else self.grid()
        out = self.survival(df, times, "_s")
        return out.withColumn(name, make(F.col("_s"), doubles(grid))).drop("_s")

    def hazard(self, df, times=None, name="hf"):
        return self._over(df, times, lambda s, g: curve.hazard(s), name)

    def expected_time(self, df, times=None, name="expected_time"):
        return self._over(df, times, lambda s, g: curve.expected_time(s, g, self.from_origin), name)

    def predict_time(self, df, name="pred_time"):
        return self._over(df, None, curve.median_time, name)

    def event_proba(self, df, name="proba"):
        return self._over(df, None, lambda s, g: curve.event_proba(s), name)


@dataclass
class ClassificationCurves(Curves):
    fitted: object = None

    def survival(self, df, times=None, name="sf"):
        n = len(times) if times is not None else self.n_grid
        return self.fitted.score(df, "_p").withColumn(name, curve.constant_curve(F.col("_p"), n)).drop("_p")

    def predict_time(self, df, name="pred_time"):
        return df.withColumn(name, F.lit(None).cast("double"))

    def event_proba(self, df, name="proba"):
        return self.fitted.score(df, name)


@dataclass
class ClassificationAdapter:
    """Event classifier as a flat curve ``1 - p``."""

    base: object
    n_grid: int = 128
    start_at_zero: bool = True

    def fit(self, df, features, time="time", cens="cens"):
        return ClassificationCurves(time_bounds(df, time), self.n_grid, self.start_at_zero,
                                    fitted=self.base.fit(df, features, cens))


@dataclass
class RegressionCurves(Curves):
    fitted: object = None

    def survival(self, df, times=None, name="sf"):
        grid = doubles(times if times is not None else self.grid())
        return self.fitted.score(df, "_t").withColumn(name, curve.indicator_curve(F.col("_t"), grid)).drop("_t")

    def predict_time(self, df, name="pred_time"):
        return self.fitted.score(df, name)


@dataclass
class RegressionAdapter:
    """Time regressor as a step curve. Fits on all rows, or only on ``events_only``."""

    base: object
    n_grid: int = 128
    start_at_zero: bool = True
    events_only: bool = False

    def fit(self, df, features, time="time", cens="cens"):
        rows = df.where(F.col(cens)) if self.events_only else df
        return RegressionCurves(time_bounds(df, time), self.n_grid, self.start_at_zero,
                                fitted=self.base.fit(rows, features, time))


@dataclass
class SurvivalCurves(Curves):
    fitted: object = None

    def survival(self, df, times=None, name="sf"):
        return self.fitted.survival(df, list(times) if times is not None else self.grid(), name)

    def hazard(self, df, times=None, name="hf"):
        grid = list(times) if times is not None else self.grid()
        if hasattr(self.fitted, "hazard"):
            return self.fitted.hazard(df, grid, name)
        return super().hazard(df, times, name)


@dataclass
class SurvivalAdapter:
    """Survival model (Kaplan-Meier, Cox, tree, ensemble) on the adapter grid."""

    base: object
    n_grid: int = 128
    start_at_zero: bool = True

    def fit(self, df, features, time="time", cens="cens"):
        return SurvivalCurves(time_bounds(df, time), self.n_grid, self.start_at_zero,
                              fitted=self.base.fit(df, features, time, cens))


def _interval_rules(a, b, time: str, cens: str, censor_aware: bool):
    """Training rule of interval (a, b]: which rows take part, and their label."""
    t = F.col(time)
    event = F.col(cens) & (t > a) & (t <= b)
    used = (event | (t > b)) if censor_aware else (t > a)
    return used, event.cast("int")


def person_period(df: DataFrame, edges, time: str = "time", cens: str = "cens",
                  censor_aware: bool = False) -> DataFrame:
    """One row per subject and interval it takes part in: adds ``interval``, ``label``.

    ``edges`` is a list or an array column. The expansion is a row-wise explode, no
    range join and no shuffle.
    """
    arr = edges if isinstance(edges, Column) else doubles(edges)
    marks = F.transform(F.sequence(F.lit(1), F.size("_edges") - 1), lambda j: F.struct(
        j.alias("j"), F.get("_edges", j - 1).alias("a"), F.get("_edges", j).alias("b")))
    wide = df.withColumn("_edges", arr).withColumn("_i", F.explode(marks))
    used, label = _interval_rules(F.col("_i.a"), F.col("_i.b"), time, cens, censor_aware)
    return wide.where(used).withColumns({"interval": F.col("_i.j"), "label": label}).drop("_edges", "_i")


@dataclass
class PiecewiseCurves(Curves):
    edges: list = field(default_factory=list)
    models: list = field(default_factory=list)  # 0.0, 1.0 or a fitted learner per interval

    def grid(self):
        return self.edges[1:]

    def rates(self, df: DataFrame, name: str = "rates") -> DataFrame:
        """Event probability per interval as an array column."""
        out, cols = df, []
        for j, m in enumerate(self.models):
            if isinstance(m, float):
                cols.append(F.lit(m))
            else:
                out = m.score(out, f"_p{j}")
                cols.append(F.col(f"_p{j}"))
        return out.withColumn(name, F.array(*cols)).drop(*[f"_p{j}" for j in range(len(self.models))])

    def survival(self, df, times=None, name="sf"):
        steps = self.rates(df, "_r").withColumn("_r", curve.survival_from_rates(F.col("_r")))
        if times is None:
            return steps.withColumnRenamed("_r", name)
        return steps.withColumn(
            name, curve.regrid(F.col("_r"), doubles(self.grid()), doubles(times), "step")).drop("_r")


@dataclass
class PiecewiseAdapter:
    """One event classifier per time interval; the curve is the product of ``1 - p``.

    ``censor_aware`` drops a subject from the interval in which it is censored.
    Edges are exact quantiles of the time, or evenly spaced with ``uniform``.
    """

    base: object
    times: int = 8
    start_at_zero: bool = True
    censor_aware: bool = False
    uniform: bool = False

    def label(self, base_name: str) -> str:
        family = "PiecewiseCensorAwareClassifWrapSA" if self.censor_aware else "PiecewiseClassifWrapSA"
        return f"{family}({base_name}, times={self.times})"

    def fit(self, df, features, time="time", cens="cens"):
        e = grids.to_list(grids.edges(df, time, self.times, self.start_at_zero, uniform=self.uniform), "edges")
        e = e or [0.0, 1.0]
        # One job tells for every interval whether a model is needed.
        long = person_period(df.select(time, cens), e, time, cens, self.censor_aware)
        seen = {r["interval"]: (r["n"], r["y"]) for r in long.groupBy("interval").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("y")).collect()}  # one row per interval
        models = []
        for j in range(1, len(e)):
            n, y = seen.get(j, (0, 0))
            if n == 0 or y == 0:
                models.append(0.0)
            elif y == n:
                models.append(1.0)
            else:
                used, label = _interval_rules(e[j - 1], e[j], time, cens, self.censor_aware)
                models.append(self.base.fit(df.where(used).withColumn("_label", label), features, "_label"))
        return PiecewiseCurves(time_bounds(df, time), len(e) - 1, self.start_at_zero, True, e, models)


def compare(models: dict, df: DataFrame, row_id: str, times=None, mode: str = "survival") -> DataFrame:
    """Curves of several models for the same subjects: ``model, row_id, t, value``."""
    grid = list(times) if times is not None else even_grid(
        0.0, max([1.0] + [m.bounds[1] for m in models.values()]), 128)
    out = None
    for label, m in models.items():
        made = (m.hazard if mode.lower().startswith("h") else m.survival)(df, grid, "_v")
        long = made.select(F.lit(label).alias("model"), row_id, F.explode(
            F.arrays_zip(doubles(grid).alias("t"), F.col("_v").alias("v"))).alias("_z")).select(
            "model", row_id, F.col("_z.t").alias("t"), F.col("_z.v").alias("value"))
        out = long if out is None else out.unionByName(long)
    return out


def score(model: Curves, df: DataFrame, end: float, n: int = 128) -> DataFrame:
    """Batch prediction card: curve on ``n`` points of [0, end], expected time and risk."""
    grid = even_grid(0.0, end, n)
    s = model.survival(df, grid, "sf")
    return s.withColumns({
        "expected_time": curve.expected_time(F.col("sf"), doubles(grid), model.from_origin),
        "risk": curve.event_proba(F.col("sf"))})
