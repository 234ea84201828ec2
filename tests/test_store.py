from datetime import datetime, timedelta, timezone

import pytest

from brindle.refuse import Refused
from brindle.sources import store

DAY = datetime(2024, 1, 1)
UTC = timezone.utc


def test_a_store_reads_its_window_and_fills_missing_columns(spark, tmp_path):
    rows = [("v", "A", DAY + timedelta(hours=i), 1.0 + i, 1.0, "bid", str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "venue string, ticker string, ts timestamp, price double, size double, aggressor string, trade_id string")
    store.save(df, str(tmp_path), "trades")
    got = store.load(spark, str(tmp_path), "trades", DAY.replace(tzinfo=UTC), (DAY + timedelta(days=1)).replace(tzinfo=UTC), tickers=["A"], venues=["v"])
    assert got.count() == 24 and got.where("rpi is not null").count() == 0
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString()
    assert store.load(spark, str(tmp_path), "trades", DAY.replace(tzinfo=UTC), (DAY + timedelta(days=9)).replace(tzinfo=UTC), as_of=DAY.replace(tzinfo=UTC) + timedelta(hours=3)).count() == 4
    with pytest.raises(Refused):
        store.load(spark, str(tmp_path), "nope", DAY.replace(tzinfo=UTC), DAY.replace(tzinfo=UTC) + timedelta(1))


def test_ledgers_are_found_by_their_path(spark, tmp_path):
    us = int(DAY.replace(tzinfo=UTC).timestamp() * 1e6)
    spark.createDataFrame([("x", "A", us, us, "buy", 1.0, 2.0)], "dex string, ticker string, at_micros long, recv_micros long, side string, price double, size double").write.parquet(f"{tmp_path}/venue=v/account=me/kind=fills")
    got = store.ledger(spark, str(tmp_path), "fills", DAY.replace(tzinfo=UTC), DAY.replace(tzinfo=UTC) + timedelta(1), accounts=["me"]).first()
    assert (got["account"], got["price"], got["fee"]) == ("me", 1.0, None)
