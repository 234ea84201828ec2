"""Other venues' archives once parsed: Parquet under kind/venue/ticker/date, a manifest of what is held, and account ledgers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.refuse import Refused, one_of, require, window

_BASE = "venue string, ticker string, date date, ts timestamp"
#: Columns of each kind; a venue that lacks one reads null.
KINDS = {
    "trades": f"{_BASE}, price double, size double, aggressor string, trade_id string, rpi boolean",
    "depth": f"{_BASE}, band_pct double, depth double, notional double",
    "book": f"{_BASE}, bid_px double, ask_px double, bid_sz double, ask_sz double, bid_depth_2 double, ask_depth_2 double, bid_depth_10 double, ask_depth_10 double",
    "candles": f"{_BASE}, interval string, close_ts timestamp, open double, high double, low double, close double, volume double, trade_count long, high_all double, low_all double",
    "funding": f"{_BASE}, rate double, interval_hours int",
    "premium": f"{_BASE}, interval string, close_ts timestamp, open double, high double, low double, close double",
    "daily": f"{_BASE}, interval string, close_ts timestamp, open double, high double, low double, close double, volume double, trade_count long",
    "gaps": "venue string, ticker string, date date, from_ts timestamp, to_ts timestamp, cause string",
}
LEDGERS = {
    "fills": "dex string, ticker string, at_micros long, recv_micros long, side string, price double, size double, start_position double, direction string, closed_pnl double, fee double, fee_token string",
    "funding_payments": "dex string, ticker string, at_micros long, recv_micros long, size double, rate double, amount double",
    "ledger_updates": "dex string, ticker string, at_micros long, recv_micros long, kind_of string, amount double",
}


def save(df: DataFrame, root: str, kind: str) -> None:
    """Add rows of a kind under venue, ticker and UTC day."""
    one_of("kind", kind, tuple(KINDS))
    at = "from_ts" if kind == "gaps" else "ts"
    require(df, ["venue", at])
    df.withColumn("date", F.to_date(at)).write.mode("append").partitionBy("venue", "ticker", "date").parquet(f"{root.rstrip('/')}/{kind}")


def load(spark: SparkSession, root: str, kind: str, start: datetime, end: datetime, *, tickers: list[str] | None = None, venues: list[str] | None = None, as_of: datetime | None = None, rpi: bool | None = None) -> DataFrame:
    """Rows of a kind in a window; venue, ticker and day are partitions, so only theirs are read.  ``as_of`` is on the close where there is one."""
    one_of("kind", kind, tuple(KINDS))
    lo, hi = window(start, end)
    a, b = F.timestamp_micros(F.lit(lo)), F.timestamp_micros(F.lit(hi))
    df = spark.read.schema(KINDS[kind]).parquet(f"{root.rstrip('/')}/{kind}")
    if venues is not None:
        df = df.where(F.col("venue").isin(venues))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(tickers) | (F.col("ticker").isNull() if kind == "gaps" else F.lit(False)))
    if kind == "gaps":
        return df.where((F.col("from_ts") < b) & (F.col("to_ts") > a)).drop("date")
    df = df.where(F.col("date").between(F.to_date(a), F.to_date(F.timestamp_micros(F.lit(hi - 1)))) & (F.col("ts") >= a) & (F.col("ts") < b))
    if as_of is not None:
        df = df.where(F.col("close_ts" if "close_ts" in df.columns else "ts") <= F.lit(as_of))
    if rpi is not None:
        if kind != "trades":
            raise Refused("only trades say whether they improved a retail price")
        df = df.where(F.coalesce("rpi", F.lit(False)) == rpi)
    return df.drop("date")


def events(spark: SparkSession, path: str, start: datetime, end: datetime, sources: list[str] | None = None) -> DataFrame:
    """Scheduled releases (source, event, ts) of a window."""
    lo, hi = window(start, end)
    df = spark.read.schema("source string, event string, ts timestamp, url string").parquet(path).where((F.unix_micros("ts") >= lo) & (F.unix_micros("ts") < hi))
    return df if sources is None else df.where(F.col("source").isin(sources))


def ledger(spark: SparkSession, root: str, kind: str, start: datetime, end: datetime, *, accounts: list[str] | None = None, venue: str | None = None) -> DataFrame:
    """Fills, funding payments or updates of accounts, by the venue, account and kind in their path."""
    one_of("kind", kind, tuple(LEDGERS))
    lo, hi = window(start, end)
    df = spark.read.schema(LEDGERS[kind] + ", venue string, account string, kind string").parquet(root).where(F.col("kind") == kind)
    if accounts is not None:
        df = df.where(F.col("account").isin(accounts))
    if venue is not None:
        df = df.where(F.col("venue") == venue)
    rows = df.where((F.col("at_micros") >= lo) & (F.col("at_micros") < hi))
    return rows.withColumns({"ts": F.timestamp_micros("at_micros"), "recv_ts": F.timestamp_micros("recv_micros")}).drop("at_micros", "recv_micros", "kind")
