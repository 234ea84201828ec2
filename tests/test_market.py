"""Market operators: hand arithmetic, no-lookahead, refusals, round trips."""

import gzip
import json
import math
import random
import zipfile
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.functions import models as M
from brindle.functions import stats
from brindle.operators import asof, backtest, bars, fitted, indicators, liquidity, order_flow, portfolios, record
from brindle.refuse import Refused
from brindle.sources import archives, tape
from brindle.streaming import bars as streams

DAY = datetime(2024, 1, 1)


def daily(spark, closes, skip=(), ticker="A"):
    rows = [(ticker, DAY + timedelta(days=i), DAY + timedelta(days=i + 1), c, c * 1.01, c * 0.99, c, 10.0, 5) for i, c in enumerate(closes) if i not in skip]
    return spark.createDataFrame(rows, "ticker string, ts timestamp, close_ts timestamp, open double, high double, low double, close double, volume double, trade_count long")


def by_time(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.orderBy("ticker", "ts").collect()]


def walk(n, seed=0):
    rng = random.Random(seed)
    out = [100.0]
    for _ in range(n - 1):
        out.append(out[-1] * math.exp(rng.gauss(0, 0.02)))
    return out


def test_returns_are_null_across_a_hole(spark):
    assert by_time(bars.returns(daily(spark, [1.0, 2.0, 9.0, 3.0, 6.0], skip=(2,))), "return") == [None, 1.0, None, 1.0]


def test_unknown_choices_and_missing_columns_are_refused(spark):
    b = daily(spark, [1.0, 2.0])
    for bad in (lambda: bars.returns(b, "sqrt"), lambda: bars.realized(b, "nope", 5), lambda: bars.returns(b.drop("close")), lambda: bars.resample(b, "1h", "1d"), lambda: indicators.macd(20, 10), lambda: backtest.returns(b, F.lit(1.0), fee=-1), lambda: portfolios.weights(b, None, None, [], "up")):
        with pytest.raises(Refused):
            bad()


def test_whole_buckets_only(spark):
    rows = [("A", DAY + timedelta(hours=i), DAY + timedelta(hours=i + 1), 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i) for i in range(48) if i != 30]
    b = spark.createDataFrame(rows, "ticker string, ts timestamp, close_ts timestamp, open double, high double, low double, close double")
    assert by_time(bars.resample(b, "1d", "1h"), "open", "high", "low", "close", "n") == [(1.0, 25.0, 0.5, 24.5, 24)]


def test_asof_ties_tolerance_and_strictness(spark):
    t = lambda s: DAY + timedelta(seconds=s)
    left = spark.createDataFrame([("k", t(5), 1), ("k", t(10), 2), (None, t(5), 3)], "key string, ts timestamp, i int")
    right = spark.createDataFrame([("k", t(5), "a"), ("k", t(1), "b"), (None, t(4), "c")], "key string, at timestamp, v string")
    got = lambda **k: {r["i"]: r["v"] for r in asof.asof(left, right, "ts", "at", ["key"], **k).collect()}
    assert got() == {1: "a", 2: "a", 3: "c"}
    assert got(strict=True) == {1: "b", 2: "a", 3: "c"}
    assert got(tolerance="4s") == {1: "a", 2: None, 3: "c"}


def test_gaps_merge_when_they_touch(spark):
    t = lambda s: DAY + timedelta(seconds=s)
    g = spark.createDataFrame([("v", "A", t(0), t(5), "x"), ("v", "A", t(5), t(8), "y"), ("v", "A", t(9), t(10), "x"), ("v", None, t(0), t(1), "z")], "venue string, ticker string, from_ts timestamp, to_ts timestamp, cause string")
    assert sorted((r["ticker"] or "", r["causes"]) for r in record.merged_gaps(g).collect()) == [("", "z"), ("A", "x"), ("A", "x,y")]


def test_indicators_never_cross_a_hole_nor_look_ahead(spark):
    closes = walk(60)
    ind = dict(s=indicators.sma(5), e=indicators.ema(5), r=indicators.rsi(5), t=indicators.supertrend(5), z=indicators.zscore(5), k=indicators.stochastic(5, 2), d=indicators.donchian((5,)))
    whole = by_time(indicators.add(daily(spark, closes), **ind), *ind)
    part = by_time(indicators.add(daily(spark, closes[:40]), **ind), *ind)
    assert whole[:40] == part
    holed = by_time(indicators.add(daily(spark, closes, skip=(30,)), **ind), *ind)
    assert all(v is None for v in holed[30][:3]) and holed[:30] == whole[:30]


def test_rsi_by_hand():
    assert indicators._rsi(np.array([1.0, 2, 3, 4]), 2).tolist()[2:] == [100.0, 100.0]
    assert indicators._rsi(np.array([1.0, 2, 1]), 2)[2] == 50.0


def test_a_position_earns_the_next_bar_and_pays_for_turnover(spark):
    b = daily(spark, [100.0, 110.0, 99.0, 99.0]).withColumn("p", F.when(F.col("close") == 100, 1.0).otherwise(-1.0))
    rows = by_time(backtest.returns(b, "p", fee=0.01), "position", "gross", "cost", "net")
    assert rows[0] == (None, None, None, None)
    assert rows[1] == pytest.approx((1.0, 0.1, 0.01, 0.09)) and rows[2] == pytest.approx((-1.0, 0.1, 0.02, 0.08)) and rows[3] == pytest.approx((-1.0, 0.0, 0.0, 0.0))


def test_funding_is_charged_only_when_every_hour_is_known(spark):
    b = daily(spark, [1.0, 1.0, 1.0])
    hours = [("A", DAY + timedelta(hours=h, milliseconds=121), 0.001) for h in range(1, 73) if h != 60]
    f = spark.createDataFrame(hours, "ticker string, ts timestamp, rate double")
    rows = by_time(backtest.returns(b, F.lit(1.0), fee=0.0, funding=f), "funding", "funding_charged")
    assert rows[1] == (pytest.approx(0.024), True) and rows[2] == (None, False)


def test_a_stop_fills_inside_the_bar(spark):
    b = daily(spark, [100.0, 100.0, 100.0, 90.0, 90.0])
    trial = backtest.trials(b.withColumn("p", F.lit(1.0)), {"long": "p"}, fee=0.0)
    out = by_time(backtest.overlay(b, trial, stop=0.05, fee=0.0), "position", "gross")
    assert out[3][1] == pytest.approx(90 / 100 - 1) and out[4][0] == 0.0  # the bar opened beyond the stop


def test_trades_and_their_summary(spark):
    b = daily(spark, walk(40)).withColumn("p", F.when(F.dayofmonth("ts") % 10 < 5, 1.0).otherwise(0.0))
    t = backtest.trials(b, {"x": "p"})
    runs = backtest.trades_table(t).collect()
    assert backtest.trades_summary(t).first()["trades"] == len(runs) and all(r["side"] == "long" for r in runs)


def test_published_numbers():
    assert stats.expected_max_sharpe(100, 0.5**2 / 250 * 1) == pytest.approx(stats.expected_max_sharpe(100, 0.001), rel=1e-9)
    assert stats.t_sf(2.228, 10) == pytest.approx(0.025, abs=1e-4) and stats.t_sf(-2.228, 10) == pytest.approx(0.975, abs=1e-4)
    assert stats.ewma_n_eff(0.94) == pytest.approx(32.33, abs=0.01)
    assert stats.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])
    assert stats.pbo(np.random.default_rng(0).normal(size=(160, 8)))["splits"] == 12870
    x = np.random.default_rng(1).normal(0, 0.01, (400, 5))
    assert stats.reality_check(x, reps=300)["white"] > 0.05 and stats.reality_check(x + 0.005, reps=300)["white"] < 0.05
    i = stats.stationary_bootstrap(50, 10, 20)
    assert i.min() >= 0 and i.max() < 50 and (np.diff(i, axis=1) % 50 == 1).mean() > 0.8


def test_local_clock_knows_daylight_saving(spark):
    from brindle.functions import columns as C

    df = spark.createDataFrame([(datetime(2024, 1, 15, 15),), (datetime(2024, 7, 15, 15),)], "ts timestamp")
    rows = df.withColumns(C.local_clock(F.col("ts"), "America/New_York")).orderBy("ts").collect()
    assert [(r["local_hour"], r["local_dst"], r["local_weekday"]) for r in rows] == [(10, False, 1), (11, True, 1)]


def test_hayashi_yoshida_is_the_double_sum():
    rng = np.random.default_rng(2)
    t, s = np.sort(rng.choice(10**6, 60, False)), np.sort(rng.choice(10**6, 50, False))
    x, y = np.cumsum(rng.normal(size=60)), np.cumsum(rng.normal(size=50))
    want = sum((x[i] - x[i - 1]) * (y[j] - y[j - 1]) for i in range(1, 60) for j in range(1, 50) if max(t[i - 1], s[j - 1] - 100) < min(t[i], s[j] - 100))
    assert order_flow.hayashi_yoshida(t, x, s, y, 100) == pytest.approx(want)


def test_garch_recovers_its_parameters_and_forecasts_without_lookahead(spark):
    rng = np.random.default_rng(3)
    y, h = [], 1.0
    for _ in range(3000):
        y.append(math.sqrt(h) * rng.standard_normal() * 0.01)
        h = 0.05 + 0.08 * (y[-1] / 0.01) ** 2 + 0.87 * h
    f = M.fit_garch(np.array(y), "garch", "normal")
    assert f["persistence"] == pytest.approx(0.95, abs=0.04) and f["alpha"] == pytest.approx(0.08, abs=0.04)
    assert M.forecast_garch(f, "garch", np.array(y), 500)[-1] == pytest.approx(f["omega"] / (1 - f["persistence"]), rel=0.05)
    rets = lambda n: spark.createDataFrame([("A", DAY + timedelta(days=i), DAY + timedelta(days=i + 1), y[i]) for i in range(n)], "ticker string, ts timestamp, close_ts timestamp, return double")
    walk_ = lambda n: {r["ts"]: (r["variance"], r["fitted_through"] <= r["close_ts"]) for r in fitted.walk_forward(rets(n), dist="normal", first=200, every=50).collect()}
    a, b = walk_(320), walk_(280)
    assert len(a) == 121 and all(a[k] == b[k] for k in b) and all(v[1] for v in a.values())


def test_small_models():
    rng = np.random.default_rng(4)
    x = np.column_stack([np.ones(4000), rng.normal(size=(4000, 2))])
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [0.2, 1.0, -0.5])))).astype(float)
    assert M.fit_logit(x, y) == pytest.approx([0.2, 1.0, -0.5], abs=0.15)
    r = np.concatenate([rng.normal(0, 1, 400), rng.normal(0, 3, 400)])
    found = M.variance_breaks(r)
    assert len(found) == 1 and abs(found[0] - 400) < 30
    cov = np.array([[1.0, 0.9, 0.1], [0.9, 1.2, 0.0], [0.1, 0.0, 2.0]])
    w = M.minimum_variance(cov)
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and all(w @ cov @ w <= v @ cov @ v + 1e-9 for v in np.eye(3))
    assert stats.hrp(cov).sum() == pytest.approx(1)
    assert abs(M.local_whittle(rng.normal(size=4000))) < 0.1
    e = rng.normal(size=(3000, 2))
    p, q = np.cumsum(e[:, 0]), np.zeros(3000)
    for i in range(1, 3000):  # the second venue follows the first
        q[i] = q[i - 1] + 0.3 * (p[i - 1] - q[i - 1]) + e[i, 1]
    alpha, omega, _ = M.vecm(p, q, 5)
    assert M.discovery_shares(alpha, omega)["component_share"] > 0.8
    z = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 800)
    a, b, _ = M.fit_dcc(z)
    assert a < 0.1 and M.dcc_filter(z, a, b).shape == (801, 2, 2)
    assert M.kupiec(5, 500, 0.01) < 0.01 and M.christoffersen(np.tile([0] * 99 + [1], 5)) < 1


def test_the_tape_round_trips_one_row_per_event(spark, tmp_path):
    us = lambda d: int(d.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    rows = [("v", "A", us(DAY + timedelta(hours=i)), us(DAY + timedelta(hours=i, seconds=k)), k, "1h", 1.0 + k, 2.0, 0.5, 1.5 + k, 3.0, i % 3, True) for i in range(30) for k in (1, 2)]
    raw = spark.createDataFrame(rows, "venue string, ticker string, at_micros long, recv_micros long, stream_seq long, interval string, open double, high double, low double, close double, volume double, trade_count long, is_final boolean")
    tape.append(raw, str(tmp_path), "candles")
    start, end = DAY.replace(tzinfo=timezone.utc), (DAY + timedelta(days=2)).replace(tzinfo=timezone.utc)
    got = tape.candles(spark, str(tmp_path), ["A"], "1h", start, end)
    assert got.count() == 19 and {r["close"] for r in got.collect()} == {3.5}  # 29 closed hours, two in three with trades
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert tape.frontier(spark, str(tmp_path), "candles").first()["days"] == 2
    with pytest.raises(Refused):
        tape.wanted(tape.scan(spark, str(tmp_path), "candles"), ["A", "B"])
    with pytest.raises(Refused):
        tape.candles(spark, str(tmp_path), ["A"], "1h", DAY, DAY)


def test_upsert_replaces_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/manifest"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        tape.upsert(spark, path, spark.createDataFrame(rows, "k int, v string"), ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_account_snapshots(spark):
    state = {"dex": "", "mode": {"answer": "unifiedAccount"}, "clearinghouseState": {"marginSummary": {"accountValue": "10.5", "totalNtlPos": "1", "totalRawUsd": "2", "totalMarginUsed": "3"}, "crossMaintenanceMarginUsed": "0", "withdrawable": "4", "time": 1700000000123, "assetPositions": [{"position": {"coin": "X", "szi": "-2", "entryPx": "5", "positionValue": "12", "unrealizedPnl": "1", "marginUsed": "1", "leverage": {"type": "cross", "value": 3}, "cumFunding": {"allTime": "0.5"}}}]}}
    bad = {**state, "clearinghouseState": {**state["clearinghouseState"], "withdrawable": None}}
    df = lambda s: spark.createDataFrame([("v", "acc", 7, 1, bytearray(json.dumps(s).encode()))], "venue string, account string, seq long, recv_micros long, payload binary")
    m = tape.margin(df(state)).first()
    assert (m["account_value"], m["equity_held"], m["positions"]) == (10.5, False, 1)
    assert tape.positions(df(state)).first()["mark_px"] == 6.0
    with pytest.raises(Exception, match="carries no withdrawable"):
        tape.margin(df(bad)).collect()


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "S-2024-01-02.zip", "w") as z:
        z.writestr("x.csv", "id,price,qty,f,l,time,maker\n1,10.5,2,1,1,1704153600000,true\n2,10.6,1,2,2,1704153601000,false\n")
    got = archives.with_file_day(archives.read(spark, f"{tmp_path}/*.zip", "aggregate_trades")).orderBy("ts").collect()
    assert [(r["price"], r["aggressor"], str(r["day"])) for r in got] == [(10.5, "ask", "2024-01-02"), (10.6, "bid", "2024-01-02")]
    text = b"timestamp,symbol,side,size,price,tick,id\n1704153601.25,S,Sell,1,5,x,b\n1704153600.1234,S,Buy,2,4,x,a\n"
    assert archives.timed_trades(archives.unpack(gzip.compress(text), "t.csv.gz"), "t")["trade_id"].tolist() == ["a", "b"]
    lines = [{"type": "snapshot", "ts": 1000, "data": {"b": [["10", "1"]], "a": [["11", "2"]]}}, {"type": "delta", "ts": 1500, "data": {"b": [["10.5", "3"]]}}, {"type": "delta", "ts": 2100, "data": {"b": [["10.5", "0"]]}}]
    b = archives.book("\n".join(map(json.dumps, lines)).encode(), "b")
    assert b["bid_px"].tolist() == [10.5, 10.0]
    assert archives.rate_decisions("<b>January 30-31</b> July 30-31", 2024) == [datetime(2024, 1, 31, 19, tzinfo=timezone.utc), datetime(2024, 7, 31, 18, tzinfo=timezone.utc)]
    assert archives.sampled_days(date(2024, 1, 1), date(2024, 2, 29), "monthly:Mon") == [date(2024, 1, 1), date(2024, 2, 5)]
    with pytest.raises(Refused):
        archives.klines(b"1,1,1,1,1,1,1,1,1\n", "k")


def test_streamed_bars_are_the_batch_ones(spark, tmp_path):
    rows = [("A", DAY + timedelta(minutes=i), float(i % 7 + 1), 1.0, "v", str(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "ticker string, ts timestamp, price double, size double, venue string, trade_id string")
    df.unionByName(df).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = streams.bars(streams.deduplicated(stream), "1h", late=None).writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    batch = {r["ts"]: (r["open"], r["close"], r["volume"]) for r in bars.bars(df.drop("venue"), "1h").collect()}
    got = {r["ts"]: (r["open"], r["close"], r["volume"]) for r in spark.table("streamed").collect()}
    assert got and all(batch[k] == v for k, v in got.items())


def test_shocks_take_the_higher_quantile(spark):
    f = spark.createDataFrame([("A", DAY + timedelta(minutes=i), float(i)) for i in range(101)], "ticker string, ts timestamp, flow double")
    assert sorted(r["flow"] for r in liquidity.shocks(f, share=0.055).collect()) == [95.0, 96.0, 97.0, 98.0, 99.0, 100.0]


def test_every_query_runs_and_matches_its_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    con = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("events", "lineitem", "orders", "customer"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    sql = entry.oracle_sql()
    for name in ("bars_hourly", "gaps_masked", "effective_spread", "backtest_trades", "factor_members", "carry_always", "jumps_lee_mykland"):
        got = entry.queries()[name](spark, sf)
        want = con.execute(sql[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(got.columns), name
        assert pd.DataFrame(got.select(*cols).collect(), columns=cols).astype(str).sort_values(cols).values.tolist() == pd.DataFrame(want.fetchall(), columns=cols).astype(str).sort_values(cols).values.tolist(), name
