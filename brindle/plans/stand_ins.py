"""Market-shaped views of the driver's tables, as DataFrames and as the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import bars as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades: ticker is the type, price the value plus one, size from the properties, the side from the id."""
    k = F.get_json_object("props", "$.k").cast("long") + 1
    side = F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask")
    return table(spark, sf_dir, "events").select(F.lit("v").alias("venue"), F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 1).alias("price"), k.alias("size"), side.alias("aggressor"), "event_id", "user_id")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes around the value, a cent and a half wide per cent of size."""
    t = ticks(spark, sf_dir)
    return t.select("venue", "ticker", "ts", (F.col("price") - 0.01).alias("bid_px"), (F.col("price") + 0.01).alias("ask_px"), F.col("size").cast("double").alias("bid_sz"), (F.col("event_id") % 7 + 1).cast("double").alias("ask_sz"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.bars(ticks(spark, sf_dir).drop("venue"), "1h")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as daily bars of each return flag; price is the unit price."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("timestamp").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber")
    return B.bars(t, "1d", ("l_orderkey", "l_linenumber"))


TICKS = """ticks AS (SELECT 'v' AS venue, event_type AS ticker, ts, value + 1 AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS size,
  CASE WHEN event_id % 2 = 0 THEN 'bid' ELSE 'ask' END AS aggressor, event_id, user_id FROM events)"""
QUOTES = TICKS + """, quotes AS (SELECT venue, ticker, ts, price - 0.01::DOUBLE AS bid_px, price + 0.01::DOUBLE AS ask_px, size::DOUBLE AS bid_sz, (event_id % 7 + 1)::DOUBLE AS ask_sz FROM ticks)"""
HOURLY = TICKS + """, bars AS (SELECT ticker, date_trunc('hour', ts) AS ts, date_trunc('hour', ts) + INTERVAL 1 HOUR AS close_ts, arg_min(price, ticks.ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ticks.ts) AS close, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count FROM ticks GROUP BY ticker, date_trunc('hour', ts))"""
DAILY = """raw AS (SELECT l_returnflag AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size, l_orderkey * 16 + l_linenumber AS o FROM lineitem),
 bars AS (SELECT ticker, ts, ts + INTERVAL 1 DAY AS close_ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close, sum(size) AS volume, count(*) AS trade_count FROM raw GROUP BY ticker, ts)"""
#: Adds what returns need to bars: the previous close, whether the bar before is the one just before, and the log return.
RETURNS = """, r AS (SELECT *, lag(close) OVER w AS prev, coalesce(lag(close_ts) OVER w = ts, false) AS nxt,
  CASE WHEN coalesce(lag(close_ts) OVER w = ts, false) THEN ln(close / lag(close) OVER w) END AS lr,
  CASE WHEN coalesce(lag(close_ts) OVER w = ts, false) THEN close / lag(close) OVER w - 1 END AS sr FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""
