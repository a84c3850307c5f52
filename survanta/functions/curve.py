"""Column functions over survival curves stored as ``array<double>`` on a grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import search_left, search_right, total

FLOOR = 1e-12


def linspace(start: Column, end: Column, n: int) -> Column:
    """``n`` evenly spaced points, the last one exactly ``end``."""
    if n == 1:
        return F.array(start.cast("double"))
    step = (end - start) / F.lit(float(n - 1))
    inner = F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: start + i * step)
    return F.concat(inner, F.array(end.cast("double")))


def hazard(s: Column) -> Column:
    """Cumulative hazard ``-ln S`` with S clipped to [1e-12, 1]."""
    return F.transform(s, lambda x: -F.ln(F.greatest(F.least(x, F.lit(1.0)), F.lit(FLOOR))))


def _trapezoid(s: Column, t: Column) -> Column:
    area = lambda i: (F.get(t, i) - F.get(t, i - 1)) * (F.get(s, i) + F.get(s, i - 1)) / 2.0
    return F.when(F.size(s) < 2, F.lit(0.0)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.size(s) - 1), F.lit(0.0), lambda a, i: a + area(i)))


def expected_time(s: Column, grid: Column, from_origin: bool = False) -> Column:
    """Area under the curve; ``from_origin`` first adds the point (0, 1)."""
    if from_origin:
        s, grid = F.concat(F.array(F.lit(1.0)), s), F.concat(F.array(F.lit(0.0)), grid)
    return _trapezoid(s, grid)


def median_time(s: Column, grid: Column) -> Column:
    """First grid time with S <= 0.5, else NULL."""
    return F.get(F.filter(grid, lambda t, i: F.get(s, i) <= 0.5), F.lit(0))


def event_proba(s: Column) -> Column:
    """1 - S at the last grid time (0 for an empty curve)."""
    return F.when(F.size(s) == 0, F.lit(0.0)).otherwise(1.0 - F.element_at(s, -1))


def event_score(s: Column) -> Column:
    """1 - mean of the curve, the default event score."""
    return 1.0 - total(s) / F.size(s)


def at_true_time(s: Column, grid: Column, time: Column) -> Column:
    """S at the first grid time not before ``time`` (the last one beyond the grid)."""
    return F.get(s, F.least(search_left(grid, time), F.size(grid) - 1))


def step_at(s: Column, edges: Column, t: Column) -> Column:
    """Interval-model lookup: 1 before the first edge, then the value at the next edge."""
    return F.when(t < F.get(edges, F.lit(0)), F.lit(1.0)).otherwise(at_true_time(s, edges, t))


def step_before(s: Column, grid: Column, t: Column) -> Column:
    """Right-continuous lookup: value at the last grid time not after ``t``, 1 before it."""
    at = search_right(grid, t)
    return F.when(at == 0, F.lit(1.0)).otherwise(F.get(s, at - 1))


def interpolate(s: Column, grid: Column, t: Column) -> Column:
    """Linear interpolation, clamped at both ends."""
    at = search_right(grid, t)
    x0, x1 = F.get(grid, at - 1), F.get(grid, at)
    y0, y1 = F.get(s, at - 1), F.get(s, at)
    return (F.when(at == 0, F.get(s, F.lit(0)))
            .when(at >= F.size(grid), F.element_at(s, -1))
            .otherwise(y0 + (y1 - y0) * (t - x0) / (x1 - x0)))


def regrid(s: Column, grid: Column, target: Column, how: str = "step") -> Column:
    """Evaluate a curve on another grid with one of the lookups above."""
    look = {"step": step_at, "before": step_before, "linear": interpolate}[how]
    return F.transform(target, lambda t: look(s, grid, t))


def survival_from_rates(rates: Column) -> Column:
    """Cumulative product of ``1 - p`` with p clipped to [0, 1]."""
    keep = F.transform(rates, lambda p: 1.0 - F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(keep)), lambda n: F.aggregate(
        F.slice(keep, F.lit(1), n), F.lit(1.0), lambda a, x: a * x))


def constant_curve(p: Column, n: int) -> Column:
    """Event probability as a flat curve of ``n`` points."""
    return F.array_repeat(1.0 - p, n)


def indicator_curve(predicted: Column, grid: Column) -> Column:
    """Predicted time as the curve 1 before it and 0 from it on."""
    return F.transform(grid, lambda t: F.when(t < predicted, F.lit(1.0)).otherwise(F.lit(0.0)))
