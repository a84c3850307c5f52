"""Metrics against brute force on small skewed inputs."""

import numpy as np
import pandas as pd
import pytest

from survanta.operators import metrics as M
from survanta.operators import prefix


@pytest.fixture(autouse=True)
def many_ranges(monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_CELLS", 1)


def sample(n=150, seed=3):
    rng = np.random.default_rng(seed)
    time = np.where(rng.random(n) < 0.35, 10.0, rng.integers(1, 40, n)).astype(float)
    return pd.DataFrame({"time": time, "cens": rng.random(n) < 0.6, "risk": rng.integers(0, 12, n).astype(float)})


def brute_ci(p, need_event=True):
    good = ties = all_ = 0
    for i in range(len(p)):
        if need_event and not p.cens[i]:
            continue
        for j in range(len(p)):
            later = p.time[j] > p.time[i] or (p.time[j] == p.time[i] and p.cens[i] and not p.cens[j])
            if later:
                all_ += 1
                good += p.risk[i] > p.risk[j]
                ties += p.risk[i] == p.risk[j]
    return (good + ties / 2) / all_


@pytest.mark.parametrize("need_event", [True, False])
def test_concordance(spark, need_event):
    p = sample()
    got = M.concordance(spark.createDataFrame(p), "time", "cens", "risk", require_event=need_event).first()["ci"]
    assert abs(got - brute_ci(p, need_event)) < 1e-12


def test_perfect_concordance(spark):
    p = sample().assign(risk=lambda d: -d.time, cens=True)
    assert M.concordance(spark.createDataFrame(p), "time", "cens", "risk").first()["ci"] == 1.0


def test_auc_and_spearman(spark):
    p = sample()
    df = spark.createDataFrame(p)
    pos, neg = p.risk[p.cens].to_numpy(), p.risk[~p.cens].to_numpy()
    wins = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert abs(M.auc(df, "cens", "risk").first()[0] - wins) < 1e-12
    assert abs(M.spearman(df, "time", "risk").first()[0] - p.time.rank().corr(p.risk.rank())) < 1e-12


def test_log_loss_is_finite_at_certain_scores(spark):
    df = spark.createDataFrame([(True, 0.0), (False, 1.0)], "y boolean, s double")
    assert np.isfinite(M.logloss(df, "y", "s").first()[0])
