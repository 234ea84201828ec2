import datetime
import json
from datetime import date, timezone

import pytest
from pyspark.sql import functions as F

from brindle.refuse import Refused
from brindle.sources import archives, fills, venues

T0 = datetime.datetime(2025, 6, 1, 12)


def test_addresses():
    d = date(2025, 3, 4)
    assert venues.url("trades", "binance-um", "BTC", d).endswith("/daily/aggTrades/BTCUSDT/BTCUSDT-aggTrades-2025-03-04.zip")
    assert venues.url("candles", "binance-um", "SOL", d).endswith("/daily/klines/SOLUSDT/1m/SOLUSDT-1m-2025-03-04.zip")
    assert venues.url("daily", "binance-um", "BTC", d).endswith("/monthly/klines/BTCUSDT/1d/BTCUSDT-1d-2025-03.zip")
    assert venues.url("funding", "binance-um", "BTC", d).endswith("/monthly/fundingRate/BTCUSDT/BTCUSDT-fundingRate-2025-03.zip")
    assert venues.url("book", "bybit-linear", "BTC", d).endswith("2025-03-04_BTCUSDT_ob500.data.zip") and "ob200" in venues.url("book", "bybit-linear", "BTC", date(2025, 8, 21))
    assert venues.url("trades", "okx-swap", "ETH", d).endswith("/20250304/ETH-USDT-SWAP-trades-2025-03-04.zip")
    assert venues.listing_url("a b/", "c").endswith("?prefix=a%20b/&delimiter=/&marker=c") and venues.monthly_prefix("daily", "BTCUSDT").endswith("klines/BTCUSDT/1d/")
    assert venues.checksum_url("binance-um", "x") == "x.CHECKSUM" and venues.checksum_url("okx-swap", "x") is None
    for bad in (lambda: venues.url("book", "binance-um", "BTC", d), lambda: venues.instrument("binance-um", "CL"), lambda: venues.instrument("okx-swap", "HYPE"), lambda: venues.url("candles", "hyperliquid-s3", "BTC", d), lambda: venues.monthly_prefix("trades")):
        with pytest.raises(Refused):
            bad()


def test_instruments_and_days():
    assert venues.instrument("okx-swap", "BTC") == venues.Instrument("BTC-USDT-SWAP", date(2021, 10, 1), 0.01)
    assert venues.first_day("okx-swap", "trades", "BTC") == date(2021, 11, 1) and venues.first_day("hyperliquid-s3", "candles", "CL") == date(2026, 1, 6)
    assert venues.archive_days("okx-swap", date(2024, 1, 31)) == [date(2024, 1, 31), date(2024, 2, 1)] and venues.archive_days("binance-um", date(2024, 1, 31)) == [date(2024, 1, 31)]
    utc = timezone.utc
    assert venues.format_at(datetime.datetime(2025, 1, 1, tzinfo=utc)) is None and venues.format_at(datetime.datetime(2025, 7, 27, 8, 50, 10, 273000, utc)) == "node_fills_by_block"
    keys = venues.hour_keys(date(2025, 6, 1))
    assert len(keys) == 25 and "node_fills/hourly/20250601/0.lz4" in keys and "node_fills/hourly/20250602/0.lz4" in keys and all(map(venues.allowed, keys))
    assert {"node_fills/hourly/20250727/8.lz4", "node_fills_by_block/hourly/20250727/8.lz4"} <= set(venues.hour_keys(date(2025, 7, 27)))
    assert not venues.allowed("node_fills/hourly/../x") and not venues.allowed("other/hourly/1")


def fill(tid, px, sz, side, at, crossed, coin="BTC", **more):
    ms = int((T0.replace(tzinfo=timezone.utc) + datetime.timedelta(seconds=at)).timestamp() * 1000)
    return ["0xabc", {"coin": coin, "px": str(px), "sz": str(sz), "side": side, "time": ms, "crossed": crossed, "tid": tid, **more}]


def table(spark, files):
    rows = [(name, (0, i), line if isinstance(line, str) else json.dumps(line)) for name, ls in files.items() for i, line in enumerate(ls)]
    return spark.createDataFrame(rows, "file string, seq struct<block:bigint,line:bigint>, value string")


def test_fills_become_trades_bars_and_gaps(spark):
    pair = lambda tid, px, sz, side, at, **more: [fill(tid, px, sz, side, at, True, **more), fill(tid, px, sz, "A" if side == "B" else "B", at, False, more.get("coin", "BTC"))]
    a = [*pair(1, 100, 2, "B", 1), *pair(2, 101, 1, "A", 5), *pair(3, 90, 1, "A", 9, liquidation={"x": 1}), {"events": [*pair(4, 102, 3, "B", 61), *pair(5, 7, 1, "B", 62, coin="ETH")]}]
    b = [json.dumps({"coin": "BTC", "side": "A", "time": "2025-06-01T13:00:00.5", "px": "50", "sz": "1", "trade_dir_override": "Na", "side_info": []}),
         json.dumps({"coin": "BTC", "side": "B", "time": "2025-06-01T13:00:01", "px": "51", "sz": "1", "trade_dir_override": {"LiquidatedCross": "B"}, "side_info": []}),
         json.dumps({"coin": "BTC", "side": "B", "time": "2025-06-01T13:00:02", "px": "52", "sz": "1", "trade_dir_override": "NetChildVaultPositions", "side_info": []})]
    files = {"a": a, "b": b, "c": [*pair(8, 1, 1, "B", 7300), {"what": 1}], "d": [fill(9, 1, 1, "B", 10800, True), fill(9, 1, 1, "A", 10800, True)]}
    rows = fills.parsed(table(spark, files))
    assert {r["file"]: r["cause"] for r in fills.failed(rows).collect()} == {"c": "unparsed", "d": "unparsed"}
    t = fills.trades(rows, {"BTC": "BTC"})
    got = sorted((r["ts"], r["price"], r["size"], r["taker_buy"], r["liquidation"]) for r in t.collect())
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    assert got == [(at(1), 100, 2, True, False), (at(5), 101, 1, False, False), (at(9), 90, 1, False, True), (at(61), 102, 3, True, False), (at(3600.5), 50, 1, False, False), (at(3601), 51, 1, True, True)]
    bars = {r["ts"]: r for r in fills.minute_bars(t).collect()}
    first = bars[T0]
    assert (first["open"], first["high"], first["low"], first["close"], first["high_all"], first["low_all"]) == (100, 101, 100, 90, 101, 90)
    assert (first["volume"], first["trade_count"], first["taker_buy_volume"], first["liquidations"], first["notional"]) == (4, 3, 2, 1, 391)
    hours = spark.createDataFrame([(T0,), (T0 + datetime.timedelta(hours=1),)], "ts timestamp")
    gaps = fills.silences(rows, hours)
    assert sorted((r["from_ts"], r["to_ts"]) for r in gaps.collect()) == [(at(9), at(61)), (at(62), at(3600)), (at(3602), at(7200))]
    assert [r["ts"] for r in fills.day_of_bars(fills.minute_bars(t).where("ticker = 'BTC'"), gaps).collect()] == []
    assert fills.day_of_bars(fills.minute_bars(t), gaps.where(F.col("from_ts") == at(62))).count() == 2


def test_lines_keep_their_order(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\n" for i in range(50)) + "\n")
    got = fills.lines(spark, str(tmp_path)).orderBy("file", "seq").collect()
    assert [r["value"] for r in got] == [f"{n}{i}" for n in "xy" for i in range(50)]


def test_contracts_and_releases():
    text = b"instrument_name,trade_id,side,price,size,created_time\nBTC-USDT-SWAP, 2,SELL,10,3,1700000001000\nBTC-USDT-SWAP,1,buy,11,4,1700000000000\n"
    out = archives.contract_trades(text, "f", 0.01)
    assert out["aggressor"].tolist() == ["bid", "ask"] and out["size"].tolist() == [0.04, 0.03]
    with pytest.raises(Refused):
        archives.contract_trades(text.replace(b" 2,", b"1,"), "f")
    assert archives.releases('<a href="/archives/cpi_01132021.htm"><a href="archives/cpi_07142021.htm">', "cpi") == [datetime.datetime(2021, 1, 13, 13, 30, tzinfo=timezone.utc), datetime.datetime(2021, 7, 14, 12, 30, tzinfo=timezone.utc)]
