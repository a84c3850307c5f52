"""Kaplan-Meier as a model: the same curve for everyone, or one per stratum."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimators
from ..operators.joins import join_keys


@dataclass
class KaplanMeier:
    by: tuple = ()

    def fit(self, df, features, time="time", cens="cens"):
        return KaplanMeierModel(estimators.life_table(df, time, cens, self.by), time, tuple(self.by))


@dataclass
class KaplanMeierModel:
    table: DataFrame
    time: str
    by: tuple = field(default=())

    def _curve(self, df, grid, name, value, start):
        at = estimators.evaluate(self.table, self.time, grid, self.by, value, start)
        arr = at.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("_c"))
        arr = arr.select(*self.by, F.transform("_c", lambda c: c["value"]).alias(name))
        return join_keys(df, arr, self.by, "left") if self.by else df.crossJoin(F.broadcast(arr))

    def survival(self, df, grid, name="sf"):
        return self._curve(df, grid, name, "surv", 1.0)

    def hazard(self, df, grid, name="hf"):
        return self._curve(df, grid, name, "cumhaz", 0.0)
