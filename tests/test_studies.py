import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import backtest, studies
from brindle.refuse import Refused

DAY = datetime(2024, 1, 1)


def walk(spark, n=120, step=timedelta(days=1), skip=(), seed=0):
    rng, c, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, c * math.exp(rng.gauss(0, 0.02))
        if i not in skip:
            rows.append(("A", DAY + i * step, DAY + (i + 1) * step, o, max(o, c) * 1.01, min(o, c) * 0.99, c))
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close_ts timestamp, open double, high double, low double, close double")


def test_edge_finds_a_simulated_spread():
    rng = np.random.default_rng(1)
    got = []
    for k in range(8):
        mid = np.cumsum(rng.normal(0, 0.03 / math.sqrt(390), (500, 390)).ravel()).reshape(500, 390)
        p = np.exp(mid + rng.choice([-0.005, 0.005], mid.shape))
        got.append(studies.edge(p[:, 0], p.max(axis=1), p.min(axis=1), p[:, -1]))
    assert np.mean(got) == pytest.approx(0.01, abs=0.002)
    assert math.isnan(studies.edge(np.ones(5), np.ones(5), np.ones(5), np.ones(5))) and math.isnan(studies.edge(*[np.ones(2)] * 4))


def test_edge_per_bucket(spark):
    assert studies.spread_edge(walk(spark, skip=(10,)), "1mo").count() == 4


def test_extremes_are_spaced(spark):
    b = walk(spark)
    got = studies.extremes(b, 5, by="return", spacing="10d").collect()
    assert len(got) == 5 and all(abs((x["ts"] - y["ts"]).days) >= 10 for x in got for y in got if x["ts"] != y["ts"])
    every = sorted((abs(r["r"]) for r in b.selectExpr("ln(close / lag(close) over (order by ts)) as r").collect() if r["r"] is not None), reverse=True)
    assert max(r["score"] for r in got) == pytest.approx(every[0])


def test_targets_are_null_across_a_hole(spark):
    rows = studies.targets(walk(spark, 10, skip=(5,)), 2, "1d", cost=0.0).orderBy("ts").collect()
    assert [r["r_ahead"] is None for r in rows] == [False, False, False, True, True, False, False, True, True]
    assert all(r["cls"] == (1 if r["y"] else -1) for r in rows if r["y"] is not None)


def test_independent_calls_are_not_skill(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 1), rng.randint(0, 1)) for _ in range(400)]
    df = spark.createDataFrame(rows, "c int, y int")
    assert studies.pesaran_timmermann(df, "c", "y")["p"] > 0.01 > studies.pesaran_timmermann(df.selectExpr("y as c", "y"), "c", "y")["p"]


def test_price_grid_carries_forward(spark):
    x = spark.createDataFrame([(DAY, 1.0), (DAY + timedelta(seconds=25), 2.0)], "ts timestamp, price double")
    y = spark.createDataFrame([(DAY + timedelta(seconds=5), 3.0)], "ts timestamp, price double")
    rows = studies.price_grid(x, y, "10s").orderBy("ts").collect()
    assert [round(math.exp(r["p1"]), 9) for r in rows] == [1.0, 1.0, 2.0] and all(math.exp(r["p2"]) == pytest.approx(3) for r in rows)


def test_elasticity_of_a_power_law(spark):
    rng = random.Random(3)
    rows = [(DAY + timedelta(hours=i), x := math.exp(rng.gauss(0, 1)), 5 * x**1.5) for i in range(300) if i != 7]
    df = spark.createDataFrame(rows, "ts timestamp, x double, y double")
    got = studies.log_elasticity(df, "y", "x", seasonal=False).first()
    assert got["slope"] == pytest.approx(1.5) and got["n"] == 299
    assert {r["lag"]: r["corr"] for r in studies.lagged_correlation(df, "x", "y", [0, 1], seasonal=False).collect()}[0] == pytest.approx(1)


def test_overlays_excursions_and_fees(spark):
    b = walk(spark)
    t = backtest.momentum(b, (5,), fee=0.001)
    assert studies.charged_fee(t) == pytest.approx(0.001)
    assert studies.overlay_grid(b, t, stops=(0.05,), takes=(None,)).select("trial").distinct().count() == 2
    x = studies.excursions(backtest.trades_table(t), b).collect()
    assert x and all(r["mae"] <= r["mfe"] for r in x)
    with pytest.raises(Refused):
        studies.charged_fee(backtest.momentum(b, (5,), fee=0.0).where("false"))


def test_instants_are_those_of_the_clock_in_summer_too():
    from datetime import datetime, timezone
    from zoneinfo import ZoneInfo

    from brindle.refuse import instant

    for month in (1, 7):
        t = datetime(2024, month, 1, 12, tzinfo=ZoneInfo("America/New_York"))
        assert instant("t", t) == t.timestamp() * 1_000_000 == instant("t", t.astimezone(timezone.utc))


def test_as_of_joins_across_days_are_brute_forces(spark):
    import random
    from datetime import datetime, timedelta

    from brindle.operators.asof import asof

    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    at = lambda: t0 + timedelta(hours=rng.randrange(24 * 12), minutes=rng.choice([0, 0, 30]))
    left = [(rng.choice(["a", "b", None]), at() if rng.random() < 0.95 else None, i) for i in range(150)]
    right = [(k, t, float(i)) for i, (k, t) in enumerate({(rng.choice(["a", "b", None, "c"]), at()) for _ in range(25)})]
    l = spark.createDataFrame(left, "k string, t timestamp, i int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, s timestamp, v double")
    for strict, tolerance in ((False, None), (True, None), (False, "30h")):
        got = {x["i"]: (x["s"], x["v"]) for x in asof(l, r, "t", "s", ["k"], strict=strict, tolerance=tolerance).collect()}
        assert len(got) == len(left)
        for k, t, i in left:
            seen = [(s, v) for kk, s, v in right if kk == k and t is not None and (s < t if strict else s <= t) and (tolerance is None or t - s <= timedelta(hours=30))]
            assert got[i] == max(seen, default=(None, None))


def test_false_discoveries_are_the_step_up_rule(spark):
    import random

    from brindle.operators.order_flow import false_discoveries

    rng = random.Random(5)
    for share in (0.0, 0.05, 0.3):
        p = [rng.random() ** (8 if rng.random() < share else 1) for _ in range(800)] + [0.0, 1.0]
        ranked = sorted(p)
        top = max((x for k, x in enumerate(ranked, 1) if x * len(p) <= k * 0.1), default=None)
        rows = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(-1, None)], "i int, p double")
        got = {r["i"]: r["discovery"] for r in false_discoveries(rows, "p", 0.1).collect()}
        assert got.pop(-1) is False and all(got[i] == (top is not None and x <= top) for i, x in enumerate(p))


def test_the_error_function(spark):
    import math

    from brindle.functions import columns as C

    rows = spark.createDataFrame([(x / 7,) for x in range(60)], "x double").select("x", C.erfc(F.col("x")).alias("e")).collect()
    assert all(r["e"] == pytest.approx(math.erfc(r["x"]), rel=2e-7) for r in rows)
