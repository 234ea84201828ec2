import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from brindle.functions import evaluation as E
from brindle.functions import stats
from brindle.operators import backtest, selection
from brindle.refuse import Refused

DAY = datetime(2024, 1, 1)


def market(spark, n=80, seed=0, tickers=("A", "B")):
    rng, rows = random.Random(seed), []
    for t in tickers:
        c = 100.0
        for i in range(n):
            o, c = c * math.exp(rng.gauss(0, 0.002)), c * math.exp(rng.gauss(0.0, 0.02))
            rows.append((t, DAY + timedelta(days=i), DAY + timedelta(days=i + 1), o, max(o, c) * 1.01, min(o, c) * 0.99, c))
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close_ts timestamp, open double, high double, low double, close double")


def test_runs_and_replay():
    assert selection.runs([1.0, 1.0, 0.0, -1.0]) == [(1.0, 2), (0.0, 1), (-1.0, 1)]
    assert selection.replay(np.array([1.0, -1.0]), np.array([0.1, 0.1]), 0.01) == pytest.approx([0.09, -0.12])


def test_random_timing_does_not_depend_on_how_samples_are_dealt(spark):
    t = backtest.momentum(market(spark), (5,))
    a, b = (sorted(map(tuple, selection.random_timing(t, samples=12, per_task=k).collect())) for k in (4, 12))
    assert a == b and all(0 < r[3] <= 1 and r[5] == 12 for r in a)


def test_permuted_markets_keep_the_ends_and_the_shapes(spark):
    b = market(spark)
    real = sorted((r["ticker"], r["ts"], r["close"], r["high"] / r["open"]) for r in b.collect())
    for k in range(2):
        twin = sorted((r["ticker"], r["ts"], r["close"], r["high"] / r["open"]) for r in selection.permuted_markets(b, 2).where(f"sample = {k}").collect())
        for t in "AB":
            x, y = [r for r in real if r[0] == t], [r for r in twin if r[0] == t]
            assert y[0][2] == x[0][2] and y[-1][2] == pytest.approx(x[-1][2])
            assert sorted(r[3] for r in y) == pytest.approx(sorted(r[3] for r in x)) and [r[2] for r in y] != pytest.approx([r[2] for r in x])


def test_a_search_on_noise_is_not_significant(spark):
    out = selection.permutation_test(market(spark, seed=3), lambda b: backtest.momentum(b, (3, 5)), samples=10)
    assert 1 / 11 <= out["p_best"] <= 1
    frame = backtest.momentum(market(spark, seed=3), (3, 5))
    assert 0 <= selection.deflate(frame)["dsr"] <= 1
    cols = [f"mom_{n}|{t}" for n in (3, 5) for t in "AB"]
    m = backtest.matrix(frame, cols).orderBy("ts").select(*[f"`{c}`" for c in cols]).toPandas().to_numpy()
    assert selection.pbo(frame, cols, blocks=4)["splits"] == 6 == stats.pbo(m, 4)["splits"]


def test_evaluation():
    assert E.chi2_sf(3.841, 1) == pytest.approx(0.05, abs=1e-4) and E.chi2_sf(23.209, 10) == pytest.approx(0.01, abs=1e-4)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3)) + [0, 0, 0.5]
    p = E.model_confidence_set(x, reps=300)
    assert p[2] < 0.05 and max(p[0], p[1]) == 1.0
    assert E.performance_fee(np.full(10, 0.001), np.zeros(10), 1.0, 365) == pytest.approx(3650, rel=1e-6)
    f = rng.uniform(0.5, 2, 800)
    assert E.mincer_zarnowitz(f * rng.chisquare(5, 800) / 5, f)["p"] > 0.01
    d = rng.normal(size=(300, 4))
    assert E.multi_horizon(d - 0.5)["p_uniform"] < 0.05 < E.multi_horizon(d + 0.5)["p_average"]
    r = rng.normal(size=2000)
    out = E.var_backtest(r, np.full(2000, -1.6449), np.full(2000, -2.0627), 0.05)
    assert min(out["kupiec_p"], out["independence_p"], out["dq_p"]) > 0.005
    with pytest.raises(Refused):
        E.var_backtest(r, np.full(2000, -2.0), np.full(2000, -1.0), 0.05)
    assert E.expected_shortfall_t(1e5, 0.025) == pytest.approx(2.338, abs=0.01)
    assert E.sharpe_difference(r[:500] + 0.4, r[500:1000], reps=200)["p"] < 0.05
    assert E.target_position(np.array([1.0, 2, 0.1]), target=1.0, band=0.6).tolist() == [1.0, 1.0, 2.0]
