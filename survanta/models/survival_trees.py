"""Survival trees and their ensembles on the common grower.

Features and times are cut into quantile bins, so a split is exact when a feature and the time have no more distinct values
than bins, and approximate otherwise; ``bins=None`` and ``time_bins=None`` make every distinct value a cut. Leaves hold their subjects and events by time bin as sparse entries; curves are formed
where they are read. Depth is unlimited unless set.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .grower import Binning, Forest, LogRank, Spec, bin_edges, draws, grow

#: Bytes of trees that one scoring function ships to the executors; more trees take more functions.
MODEL_BYTES = 1 << 28


@dataclass
class SurvivalForest:
    """Random survival forest; ``n_trees=1, sample=None`` is a single tree.

    ``min_leaf``: rows, or a share of all rows when below 1. ``sample``: expected share of rows per tree, drawn with
    replacement by a hash of ``row_id``; None uses every row once. ``signif``: stop when the best split's p-value is above
    it. ``categ``: features whose values are categories. ``local``: rows up to which a node is grown to its end in one group.
    """

    n_trees: int = 50
    max_depth: int | None = 5
    min_leaf: float = 0.01
    max_features: str | int | None = "sqrt"
    sample: float | None = 1.0
    criterion: str = "logrank"
    signif: float | None = None
    seed: int = 123
    bins: int = 32
    time_bins: int = 64
    row_id: str = "row_id"
    categ: tuple = ()
    local: int = 1 << 17

    def features_per_split(self, p: int) -> int:
        if self.max_features in (None, "all"):
            return p
        return max(1, int(math.sqrt(p))) if self.max_features == "sqrt" else min(p, int(self.max_features))

    def _hash(self):
        return F.xxhash64(self.row_id)

    def _sampled(self, base: DataFrame) -> DataFrame:
        """``base`` (with a column ``tree``) with each row's weight in its tree."""
        share, seed = self.sample, self.seed

        @pandas_udf("double")
        def weight(h: pd.Series, tree: pd.Series) -> pd.Series:
            out = np.zeros(len(h))
            for t in tree.unique():
                at = (tree == t).to_numpy()
                out[at] = draws(h[at].to_numpy(), int(t), share, seed)
            return pd.Series(out)

        return base.withColumn("w", weight(self._hash(), "tree")).where(F.col("w") > 0)

    def fit(self, df, features, time="time", cens="cens"):
        features = list(features)
        binning = Binning.fit(df, features, self.bins, tuple(f for f in self.categ if f in features))
        times = bin_edges(df, [time], self.time_bins)[0]
        cuts = np.array(times)

        @pandas_udf("int")
        def time_bin(t: pd.Series) -> pd.Series:
            return pd.Series(np.minimum(np.searchsorted(cuts, t.to_numpy()), len(cuts) - 1).astype(np.int32))

        base = binning.rows(df, self._hash(), time_bin(F.col(time).cast("double")), F.col(cens)).persist()
        try:
            spec = Spec(LogRank(self.criterion, self.signif), binning.bins, len(times), self.n_trees, self.max_depth, self.min_leaf,
                        per_split=self.features_per_split(len(features)), sample=self.sample, categorical=binning.categorical,
                        seed=self.seed, local=self.local, rows=base.count())
            nodes, roots = grow(base, spec)
        finally:
            base.unpersist()
        return ForestModel(binning, times, Forest.of(nodes, roots, 2))


@dataclass
class SurvivalTree(SurvivalForest):
    """One tree on all rows."""

    n_trees: int = 1
    max_depth: int | None = None
    min_leaf: float = 20
    max_features: str | int | None = None
    sample: float | None = None


def _no_leaf_penalty(l_reg: float) -> None:
    if l_reg:
        raise NotImplementedError("the leaf regularisation has no published definition; only l_reg=0 can be fitted")


@dataclass
class CraidTree(SurvivalTree):
    """Single tree with a weighted split statistic and a significance stop.

    ``criterion``: wilcoxon, logrank or tarone-ware; ``min_leaf`` is a share of rows. ``categ`` names categorical features,
    which are split by sets of categories.
    """

    criterion: str = "wilcoxon"
    max_depth: int | None = 4
    min_leaf: float = 0.05
    signif: float | None = 0.05
    l_reg: float = 0

    def __post_init__(self):
        _no_leaf_penalty(self.l_reg)


@dataclass
class CraidForest(SurvivalForest):
    """Bootstrap ensemble of such trees; ``sample`` is the share drawn per tree."""

    criterion: str = "tarone-ware"
    max_depth: int | None = 7
    min_leaf: float = 0.05
    sample: float | None = 0.7
    l_reg: float = 0

    def __post_init__(self):
        _no_leaf_penalty(self.l_reg)


def leaf_curves(forest: Forest, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Survival and cumulative hazard of the named leaves on the ``k`` time bins."""
    sizes = np.diff(forest.start)[leaves]
    at = np.repeat(forest.start[leaves] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    cells = np.zeros((len(leaves), k, 2))
    cells[np.repeat(np.arange(len(leaves)), sizes), forest.channel[at]] = forest.sums[at]
    y = cells[:, ::-1, 0].cumsum(axis=1)[:, ::-1]
    h = np.divide(cells[..., 1], y, out=np.zeros(y.shape), where=y > 0)
    return (1 - h).cumprod(axis=1), h.cumsum(axis=1)


@dataclass
class ForestModel:
    binning: Binning
    times: list
    forest: Forest

    @property
    def feat(self) -> np.ndarray:
        """Features of the trees' nodes, with the root of each at place 1; -1 where a node does not split."""
        trees = [self.forest.take([t]) for t in range(len(self.forest.roots))]
        out = np.full((len(trees), max(len(t.feature) for t in trees) + 1), -1)
        for i, t in enumerate(trees):
            out[i, 1:len(t.feature) + 1] = np.roll(t.feature, -int(t.roots[0]))
        return out

    def _mean_curve(self, df, grid, name, which, start):
        """Average of the leaf curves over trees, read as step functions on the grid."""
        at = np.searchsorted(np.array(self.times), np.array(grid, float), side="right") - 1
        binning, k, n = self.binning, len(self.times), len(self.forest.roots)
        sc = df.sparkSession.sparkContext

        def summed(part):
            held = sc.broadcast(part)  # bounded by MODEL_BYTES

            @pandas_udf("array<double>")
            def predict(values: pd.Series) -> pd.Series:
                forest, total = held.value, np.zeros((len(values), len(at)))
                node = forest.walk(binning.of(np.stack(values.to_numpy())))
                for t in range(node.shape[1]):
                    leaves, row = np.unique(node[:, t], return_inverse=True)
                    curve = leaf_curves(forest, leaves, k)[which]
                    total += np.where(at >= 0, curve[:, np.maximum(at, 0)], start)[row]
                return pd.Series(list(total / n))

            return predict(binning.values())

        columns = [summed(p) for p in self.forest.parts(MODEL_BYTES)]
        out = columns[0]
        for c in columns[1:]:
            out = F.zip_with(out, c, lambda a, b: a + b)
        return df.withColumn(name, out)

    def survival(self, df, grid, name="sf"):
        return self._mean_curve(df, grid, name, 0, 1.0)

    def hazard(self, df, grid, name="hf"):
        return self._mean_curve(df, grid, name, 1, 0.0)
