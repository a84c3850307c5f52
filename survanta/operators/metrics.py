"""Quality metrics of event, time and survival predictions.

Every function takes one row per subject and returns one row per ``by`` group. None
of them pairs subjects up or sorts a group in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import curve
from ..functions.arrays import doubles
from .estimators import censor_km, evaluate
from .joins import join_keys
from .prefix import place, quantiles, rank_cells, running

# Fixed value: smallest double spacing at 1.0, the clipping bound of the log loss.
EPS = 2.220446049250313e-16


def with_event_score(df: DataFrame, s: str, grid: Column | None = None, time: str | None = None,
                     score: str = "mean", name: str = "score") -> DataFrame:
    """Event score of a curve: ``mean`` = 1 - mean(S), ``sf_at_time`` = S at the true time."""
    if score == "mean":
        return df.withColumn(name, curve.event_score(F.col(s)))
    return df.withColumn(name, curve.at_true_time(F.col(s), grid, F.col(time)))


def _agg(df: DataFrame, by, *cols: Column) -> DataFrame:
    return df.groupBy(*by).agg(*cols)


def auc(df: DataFrame, label: str, score: str, by=(), name: str = "auc_event") -> DataFrame:
    """ROC AUC as a rank sum over distinct scores, ties counted one half."""
    by = list(by)
    y = F.col(label).cast("long")
    cells = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(
        F.array(F.sum(y), F.sum(1 - y)).alias("_pn"))
    placed = place(cells, by, score, F.element_at("_pn", 1)).withColumns(
        {"_pos": F.element_at("_pn", 1), "_neg": F.element_at("_pn", 2)})
    seen = running(placed, [score], {"_under": "_neg"}, before=True)
    wins = F.sum(F.col("_pos") * (F.col("_under") + F.col("_neg") / 2.0))
    pairs = F.sum("_pos").cast("double") * F.sum("_neg")
    return _agg(seen, by, F.try_divide(wins, pairs).alias(name))


def logloss_column(label: Column, score: Column) -> Column:
    p = F.greatest(F.least(score, F.lit(1.0 - EPS)), F.lit(EPS))
    y = label.cast("double")
    return F.avg(-(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p)))


def rmse_column(truth: Column, guess: Column) -> Column:
    d = truth.cast("double") - guess
    return F.sqrt(F.avg(d * d))


def r2_column(truth: Column, guess: Column) -> Column:
    d = truth - guess
    return 1.0 - F.try_divide(F.avg(d * d), F.var_pop(truth))


def _ape(truth: Column, guess: Column) -> Column:
    return F.abs((truth - guess) / F.greatest(truth, F.lit(1.0))) * 100.0


def mape_column(truth: Column, guess: Column) -> Column:
    return F.avg(_ape(truth, guess))


def rmsle_column(truth: Column, guess: Column) -> Column:
    d = F.log1p(F.greatest(truth, F.lit(0.0))) - F.log1p(F.greatest(guess, F.lit(0.0)))
    return F.sqrt(F.avg(d * d))


def logloss(df, label, score, by=(), name="logloss_event"):
    return _agg(df, by, logloss_column(F.col(label), F.col(score)).alias(name))


def rmse(df, truth, guess, by=(), name="rmse"):
    return _agg(df, by, rmse_column(F.col(truth), F.col(guess)).alias(name))


def r2(df, truth, guess, by=(), name="r2_time"):
    return _agg(df, by, r2_column(F.col(truth), F.col(guess)).alias(name))


def mape(df, truth, guess, by=(), name="mape_time"):
    return _agg(df, by, mape_column(F.col(truth), F.col(guess)).alias(name))


def rmsle(df, truth, guess, by=(), name="rmsle_time"):
    return _agg(df, by, rmsle_column(F.col(truth), F.col(guess)).alias(name))


def medape(df, truth, guess, by=(), name="medape_time"):
    """Median absolute percentage error (exact)."""
    err = df.select(*by, _ape(F.col(truth), F.col(guess)).alias("_err"))
    return quantiles(err, "_err", [0.5], by).select(*by, F.col("value").alias(name))


def custom(df: DataFrame, metric, by=(), name: str = "metric", **columns) -> DataFrame:
    """User metric: ``metric(**columns)`` gets Columns and returns an aggregate Column."""
    return _agg(df, by, metric(**{k: F.col(v) for k, v in columns.items()}).alias(name))


def spearman(df: DataFrame, truth: str, guess: str, by=(), name: str = "spearman_time") -> DataFrame:
    """Pearson correlation of average-tie ranks, computed on distinct (truth, guess) cells."""
    by = list(by)
    both = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    cells = both.groupBy(*by, truth, guess).agg(F.count(F.lit(1)).alias("_w"))
    for value, rank in ((truth, "_rt"), (guess, "_rg")):
        ranks = rank_cells(cells, by, value, "_w").select(*by, value, "n", "size", F.col("avg_rank").alias(rank))
        keep = ["n"] if rank == "_rg" else ["n", "size"]
        cells = join_keys(cells, ranks, by + [value]).drop(*keep)
    mid = (F.col("size") + 1) / 2.0
    a, b, w = F.col("_rt") - mid, F.col("_rg") - mid, F.col("_w")
    return _agg(cells, by, F.try_divide(
        F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias(name))


BASE = 4
BITS = 2


def concordance(df: DataFrame, time: str, cens: str, risk: str, by=(), require_event: bool = True,
                name: str = "ci") -> DataFrame:
    """Concordance index without pairing subjects; exact.

    A pair counts when the earlier subject has the event (with ``require_event``) and
    the later one is observed longer, or as long but censored. It is concordant when
    the earlier one has the higher ``risk``; equal risks count one half.

    The order of (time, event) is turned into positions. Two positions differ first
    at one base-4 digit, so each pair is counted once, at that digit level, inside
    the group of equal higher digits: there a running sum over risk counts, for every
    digit, how many subjects have a lower risk. Rows are aggregated to distinct
    (digit group, risk) before the running sum.
    """
    by = list(by)
    live = df.where(F.col(time).isNotNull() & F.col(risk).isNotNull())
    rows = live.groupBy(*by, time, cens, risk).agg(F.count(F.lit(1)).alias("_w"))
    marks = rows.groupBy(*by, time, cens).agg(F.sum("_w").alias("_m")).withColumn("_one", F.lit(1).cast("long"))
    spots = running(place(marks, by, time, F.col("_m")), [time, F.col(cens).desc()], {"_pos": "_one"},
                    before=True, whole={"_count": "_one"})
    spots = spots.select(*by, time, cens, "_m", "_pos", "_count")
    seated = join_keys(rows, spots, by + [time, cens])
    levels = F.ceil(F.log2(F.greatest(F.col("_count"), F.lit(2))) / BITS).cast("int")
    split = seated.withColumn("_level", F.explode(F.sequence(F.lit(0), levels - 1))).withColumns({
        "_digit": F.expr(f"shiftright(_pos, {BITS} * _level) & {BASE - 1}"),
        "_prefix": F.expr(f"shiftright(_pos, {BITS} * (_level + 1))")})
    lead = F.col("_w") if not require_event else F.when(F.col(cens), F.col("_w")).otherwise(0)
    at = lambda d, c: F.sum(F.when(F.col("_digit") == d, c).otherwise(0))
    group = by + ["_level", "_prefix"]
    cells = split.groupBy(*group, risk).agg(F.array(
        *[at(d, F.col("_w")) for d in range(1, BASE)], *[at(d, lead) for d in range(BASE - 1)]).alias("_c"))
    placed = place(cells, group, risk, F.element_at("_c", 1)).withColumns({
        f"_n{d}": F.element_at("_c", d) for d in range(1, BASE)})
    seen = running(placed, [risk], {f"_u{d}": f"_n{d}" for d in range(1, BASE)}, before=True,
                   whole={f"_a{d}": f"_n{d}" for d in range(1, BASE)})
    later = lambda p, d: sum((F.col(f"{p}{e}") for e in range(d + 1, BASE)), F.lit(0))
    leads = [F.element_at("_c", BASE + d) for d in range(BASE - 1)]
    dot = lambda p: sum((leads[d] * later(p, d) for d in range(BASE - 1)), F.lit(0))
    sums = seen.select(*by, dot("_u").alias("_win"), dot("_n").alias("_tie"), dot("_a").alias("_all"))
    return _agg(sums, by, F.try_divide(
        F.sum("_win") + F.sum("_tie") / 2.0, F.sum("_all").cast("double")).alias(name))


def _step_sums(rows: DataFrame, by, time: str, cens: str, grid) -> DataFrame:
    """Per task and group one row of fixed length: ``_n`` rows and, per grid point, the weighted squared curves of those with
    an event so far (``_done``) and the squared complements of those still at risk (``_alive``)."""
    pts, k = np.array(grid), len(grid)

    def add(batches):
        known: dict[tuple, int] = {}
        done, alive, sizes = [], [], []
        for batch in batches:
            names = batch.column_names
            cells = list(zip(*[batch.column(b).to_pylist() for b in by])) if by else [()] * batch.num_rows
            code = np.fromiter((known.setdefault(c, len(known)) for c in cells), np.int64, batch.num_rows)
            while len(done) < len(known):
                done.append(np.zeros(k))
                alive.append(np.zeros(k))
                sizes.append(0)
            at = lambda c, kind=float: batch.column(names.index(c)).to_numpy(zero_copy_only=False).astype(kind)
            t, e, g = at("_t"), batch.column(names.index("_e")).fill_null(False).to_numpy(zero_copy_only=False), at("_gb")
            lists = batch.column(names.index("_s"))
            full = np.flatnonzero(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == k)
            for c, n in zip(*np.unique(code, return_counts=True)):
                sizes[c] += int(n)
            if not len(full):
                continue
            s = np.nan_to_num(lists.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k))
            t, e, g, code = t[full], e[full], g[full], code[full]
            over = np.divide(1.0, g, out=np.zeros(len(g)), where=np.nan_to_num(g) > 0)
            first = np.where(e[:, None] & (t[:, None] <= pts), s * s * over[:, None], 0.0)
            second = np.where(t[:, None] > pts, (1 - s) ** 2, 0.0)
            for c in np.unique(code):
                done[c] += first[code == c].sum(axis=0)
                alive[c] += second[code == c].sum(axis=0)
        if known:
            keys = list(known)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([c[i] for c in keys], kinds[i]) for i in range(len(by))], pa.array(sizes, pa.int64()),
                 pa.array([d.tolist() for d in done], pa.list_(pa.float64())), pa.array([a.tolist() for a in alive], pa.list_(pa.float64()))],
                [*by, "_n", "_done", "_alive"])

    part = rows.select(*by, F.col(time).cast("double").alias("_t"), F.col(cens).cast("boolean").alias("_e"), F.col("_gb").cast("double"), "_s")
    kinds = [to_arrow_type(part.schema[b].dataType) for b in by]
    fields = "".join(f"`{b}` {part.schema[b].dataType.simpleString()}, " for b in by)
    return part.mapInArrow(add, fields + "_n long, _done array<double>, _alive array<double>")


def ibs(df: DataFrame, time: str, cens: str, s: str, grid, by=(), name: str = "ibs") -> DataFrame:
    """Integrated Brier score with inverse-probability-of-censoring weights.

    A row is joined with the censoring weight of its time; each task then adds its rows up to one array per group, and the
    arrays are added. No row goes with a single grid point.
    """
    by = list(by)
    grid = [float(t) for t in grid]
    table = censor_km(df, time, cens, by)
    ahead = evaluate(table, time, grid, by).select(*by, "k", F.col("value").alias("_g"))
    weights = table.select(*by, time, F.col("surv_before").alias("_gb"))
    rows = join_keys(df.select(*by, time, cens, F.col(s).cast("array<double>").alias("_s")), weights, by + [time], "left")
    parts = _step_sums(rows, by, time, cens, grid)
    points = parts.select(*by, "_n", F.posexplode(F.arrays_zip("_done", "_alive")).alias("k", "_c")).groupBy(*by, "k").agg(
        F.sum("_n").alias("_n"), F.sum("_c._done").alias("_done"), F.sum("_c._alive").alias("_alive"))
    score = F.col("_done") + F.when(F.col("_g") > 0, F.col("_alive") / F.col("_g")).otherwise(0.0)
    # Trapezoid weights of the grid turn the integral into one weighted sum.
    n = len(grid)
    gap = lambda i: grid[i] - grid[i - 1] if 0 < i < n else 0.0
    w = doubles([(gap(i) + gap(i + 1)) / 2.0 / grid[-1] for i in range(n)])
    return _agg(join_keys(points, ahead, by + ["k"]), by, (F.sum(score * F.get(w, F.col("k"))) / F.max("_n")).alias(name))


def auprc_column(s: Column, grid: Column, time: Column, cens: Column, steps: int = 100) -> Column:
    """Survival precision-recall area of one subject.

    Area over phi in [0, 1] of P(T*phi < T' < T/phi); a censored subject uses
    P(T' > T*phi). The curve keeps its last value beyond the grid.
    """
    def prob(i):
        phi = i / float(steps)
        low = curve.step_before(s, grid, time * phi)
        high = F.when(i == 0, F.element_at(s, -1)).otherwise(
            curve.step_before(s, grid, time / F.greatest(phi, F.lit(1.0 / steps))))
        return F.when(cens, low - high).otherwise(low)

    weight = lambda i: F.when((i == 0) | (i == steps), F.lit(0.5)).otherwise(F.lit(1.0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0),
                       lambda a, i: a + weight(i) * prob(i)) / float(steps)


def auprc(df: DataFrame, time: str, cens: str, s: str, grid, by=(), steps: int = 100,
          name: str = "auprc") -> DataFrame:
    return _agg(df, by, F.avg(auprc_column(
        F.col(s), doubles(grid), F.col(time), F.col(cens), steps)).alias(name))
