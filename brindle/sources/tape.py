"""The record on disk: Parquet partitioned by kind and UTC day, its readers, its sinks, and a manifest of what is held."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators import record as R
from brindle.refuse import Refused, instant, micros, require, window

_TICK = "venue string, ticker string, at_micros long, recv_micros long, stream_seq decimal(20,0)"
_D = "decimal(38,18)"
#: Columns of each kind of record; a file that lacks one reads null, a column that isn't here is not read.
KINDS = {
    "candles": f"{_TICK}, interval string, open {_D}, high {_D}, low {_D}, close {_D}, volume {_D}, trade_count long, is_final boolean",
    "trades": f"{_TICK}, price {_D}, size {_D}, aggressor string, trade_id string",
    "quotes": f"{_TICK}, bid_px {_D}, ask_px {_D}, bid_sz {_D}, ask_sz {_D}",
    "funding": f"{_TICK}, rate {_D}, next_micros long, premium {_D}",
    "marks": f"{_TICK}, mark {_D}, index {_D}, oracle {_D}, open_interest {_D}, mid {_D}, premium {_D}",
    "gaps": "venue string, ticker string, series string, from_micros long, to_micros long, cause string, clipped string",
    "signals": "signal string, horizon string, measure string, ticker_i string, ticker_j string, h long, value double, absent string, asof_micros long, computed_micros long, model string, run_id string",
}


def schema(kind: str) -> T.StructType:
    if kind not in KINDS:
        raise Refused(f"kind={kind!r} is not one of {', '.join(KINDS)}")
    return T.StructType.fromDDL(KINDS[kind] + ", date date")


def scan(spark: SparkSession, root: str, kind: str, start: datetime | None = None, end: datetime | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Rows of a kind with decimals as doubles.  The days a window touches are named to the reader, so other partitions aren't listed open."""
    df = spark.read.schema(schema(kind)).parquet(f"{root.rstrip('/')}/kind={kind}")
    if start is not None and end is not None:
        lo, hi = window(start, end)
        df = df.where(F.col("date").between(F.to_date(F.timestamp_micros(F.lit(lo))), F.to_date(F.timestamp_micros(F.lit(hi - 1)))))
    elif start is not None:
        df = df.where(F.col("date") >= F.to_date(F.timestamp_micros(F.lit(instant("start", start)))))
    elif end is not None:
        df = df.where(F.col("date") <= F.to_date(F.timestamp_micros(F.lit(instant("end", end)))))
    if tickers is not None:
        df = df.where(F.col("ticker").isin(tickers) | (F.col("ticker").isNull() if kind == "gaps" else F.lit(False)))
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) and f.name != "stream_seq" else F.col(f.name) for f in df.schema.fields])


def wanted(df: DataFrame, tickers: list[str]) -> list[str]:
    """The tickers asked for, all of which must be held."""
    held = {r[0] for r in df.where(F.col("ticker").isin(tickers)).select("ticker").distinct().collect()}
    missing = sorted(set(tickers) - held)
    if missing:
        raise Refused(f"the record has no {', '.join(missing)}")
    return tickers


def _clock(name: str) -> Column:
    return F.timestamp_micros(name)


def candles(spark: SparkSession, root: str, tickers: list[str], interval: str, start: datetime, end: datetime, *, as_of: datetime | None = None, traded_only: bool = True, closed_only: bool = True) -> DataFrame:
    """Closed bars of a window, one row each.  Whether a bar is closed is judged by the whole record of its series."""
    series = ["venue", "ticker"]
    raw = scan(spark, root, "candles", start, end, tickers).where(F.col("interval") == interval)
    lo, hi = window(start, end)
    rows = R.latest(raw.where((F.col("at_micros") >= lo) & (F.col("at_micros") < hi)), [*series, "at_micros"], ["recv_micros", "stream_seq"])
    if closed_only:
        # a bar is closed if its series has a later one, which lies in the window's first day or after
        last = scan(spark, root, "candles", start, None, tickers).where(F.col("interval") == interval).groupBy(*series).agg(F.max("at_micros").alias("_last"))
        rows = rows.join(last, series).where("at_micros < _last")
    if traded_only:
        rows = rows.where("trade_count > 0")
    out = rows.select("venue", "ticker", "interval", _clock("at_micros").alias("ts"), F.timestamp_micros(F.col("at_micros") + micros(interval)).alias("close_ts"), "open", "high", "low", "close", "volume", "trade_count", _clock("recv_micros").alias("recv_ts"))
    return out if as_of is None else out.where(F.col("close_ts") <= F.lit(as_of))


def trades(spark: SparkSession, root: str, tickers: list[str], start: datetime, end: datetime, *, as_of: datetime | None = None) -> DataFrame:
    """Executions, the first receipt of each; ``as_of`` is on the venue's clock."""
    lo, hi = window(start, end)
    raw = scan(spark, root, "trades", start, end, tickers).where((F.col("at_micros") >= lo) & (F.col("at_micros") < hi))
    rows = R.earliest(raw, ["venue", "ticker", "trade_id"], ["recv_micros", "stream_seq"])
    out = rows.select("venue", "ticker", _clock("at_micros").alias("ts"), _clock("recv_micros").alias("recv_ts"), "stream_seq", "price", "size", "aggressor", "trade_id")
    return out if as_of is None else out.where(F.col("ts") <= F.lit(as_of))


def quotes(spark: SparkSession, root: str, tickers: list[str], start: datetime, end: datetime) -> DataFrame:
    lo, hi = window(start, end)
    raw = scan(spark, root, "quotes", start, end, tickers).where((F.col("at_micros") >= lo) & (F.col("at_micros") < hi))
    return raw.select("venue", "ticker", _clock("at_micros").alias("ts"), _clock("recv_micros").alias("recv_ts"), "stream_seq", "bid_px", "ask_px", "bid_sz", "ask_sz")


def funding(spark: SparkSession, root: str, tickers: list[str], start: datetime, end: datetime) -> DataFrame:
    """Settled funding: rows with a venue time, the first receipt of each."""
    lo, hi = window(start, end)
    raw = scan(spark, root, "funding", start, end, tickers).where((F.col("at_micros") >= lo) & (F.col("at_micros") < hi))
    return R.earliest(raw, ["venue", "ticker", "at_micros"], ["recv_micros", "stream_seq"]).select("venue", "ticker", _clock("at_micros").alias("ts"), "rate", "premium", _clock("recv_micros").alias("recv_ts"))


def received(spark: SparkSession, root: str, kind: str, values: list[str], tickers: list[str], start: datetime, end: datetime, *, collapse: bool = False) -> DataFrame:
    """Rows without a venue time (marks, live funding) on the receipt clock; ``collapse`` keeps changes only."""
    lo, hi = window(start, end)
    rows = scan(spark, root, kind, start, end, tickers).where(F.col("at_micros").isNull() & (F.col("recv_micros") >= lo) & (F.col("recv_micros") < hi))
    if collapse:
        rows = R.collapse(rows, ["venue", "ticker"], ["recv_micros", "stream_seq"], values)
    return rows.select("venue", "ticker", _clock("recv_micros").alias("recv_ts"), *values)


def gaps(spark: SparkSession, root: str, start: datetime, end: datetime, *, tickers: list[str] | None = None, series: str | None = None) -> DataFrame:
    """Gaps that overlap a window; those of a whole venue have no ticker and stay."""
    lo, hi = window(start, end)
    rows = scan(spark, root, "gaps", end=end, tickers=tickers).where((F.col("from_micros") < hi) & (F.col("to_micros") > lo))
    rows = rows if series is None else rows.where(F.col("series") == series)
    return rows.select("venue", "ticker", "series", _clock("from_micros").alias("from_ts"), _clock("to_micros").alias("to_ts"), "cause")


def history(spark: SparkSession, root: str, signal: str, start: datetime, end: datetime, *, as_of: datetime | None = None) -> DataFrame:
    """Stored signals of a window as they were known at ``as_of``: the latest computation of each key by then."""
    lo, hi = window(start, end)
    rows = scan(spark, root, "signals").where((F.col("signal") == signal) & (F.col("asof_micros") >= lo) & (F.col("asof_micros") < hi))
    if as_of is not None:
        rows = rows.where(_clock("computed_micros") <= F.lit(as_of))
    return R.latest(rows, ["signal", "horizon", "measure", "ticker_i", "ticker_j", "h", "asof_micros"], ["computed_micros", "run_id"]).withColumns({"ts": _clock("asof_micros"), "computed_ts": _clock("computed_micros")}).drop("asof_micros", "computed_micros", "date")


def known_at(signals: DataFrame, when: datetime, lookback_days: int = 14) -> DataFrame:
    """Each horizon's newest rows known at an instant."""
    rows = signals.where((F.col("computed_ts") <= F.lit(when)) & (F.col("ts") > F.lit(when) - F.expr(f"INTERVAL {int(lookback_days)} DAYS")))
    newest = rows.groupBy("horizon").agg(F.max("ts").alias("ts"))
    return rows.join(newest, ["horizon", "ts"], "left_semi")


def pair_matrix(rows: DataFrame, tickers: list[str]) -> DataFrame:
    """Pair rows (ticker_i, ticker_j, value) as a square, both halves."""
    both = rows.select("ticker_i", "ticker_j", "value").unionByName(rows.select(F.col("ticker_j").alias("ticker_i"), F.col("ticker_i").alias("ticker_j"), "value")).dropDuplicates(["ticker_i", "ticker_j"])
    return both.groupBy(F.col("ticker_i").alias("ticker")).pivot("ticker_j", tickers).agg(F.first("value"))


def frontier(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """last_stream_seq, max_ts, max_recv_ts and days of a kind: one aggregate, which Parquet answers from its footers where that is on."""
    return scan(spark, root, kind).agg(F.max("stream_seq").alias("last_stream_seq"), F.timestamp_micros(F.max("at_micros")).alias("max_ts"), F.timestamp_micros(F.max("recv_micros")).alias("max_recv_ts"), F.countDistinct("date").alias("days"))


def append(df: DataFrame, root: str, kind: str) -> None:
    """Add rows under their UTC day (the receipt's day for rows without a venue time)."""
    declared = [f for f in schema(kind).fields if f.name != "date"]
    require(df, [f.name for f in declared[:2]])
    at = [F.col(c) for c in ("at_micros", "from_micros", "recv_micros", "asof_micros") if c in df.columns]
    rows = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared], F.to_date(F.timestamp_micros(F.coalesce(*at))).alias("date"))
    rows.write.mode("append").partitionBy("date").parquet(f"{root.rstrip('/')}/kind={kind}")


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Replace rows by key: what stays and what is new are written beside the table, which is then renamed into place."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    out = rows
    if fs.exists(here):
        old = spark.read.parquet(path)
        out = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    before = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}-{uuid.uuid4().hex}")
    out.write.parquet(str(beside))
    if fs.exists(here):
        fs.rename(here, before)
    fs.rename(beside, here)
    fs.delete(before, True)


_NUMBER = "string"
_SNAPSHOT = f"""dex string, mode struct<answer:string>, clearinghouseState struct<marginSummary:struct<accountValue:{_NUMBER},totalNtlPos:{_NUMBER},totalRawUsd:{_NUMBER},totalMarginUsed:{_NUMBER}>,
  crossMaintenanceMarginUsed:{_NUMBER}, withdrawable:{_NUMBER}, time:bigint, assetPositions:array<struct<position:struct<coin:string,szi:{_NUMBER},entryPx:{_NUMBER},positionValue:{_NUMBER},unrealizedPnl:{_NUMBER},liquidationPx:{_NUMBER},marginUsed:{_NUMBER},leverage:struct<type:string,value:{_NUMBER}>,maxLeverage:{_NUMBER},returnOnEquity:{_NUMBER},
  cumFunding:struct<allTime:{_NUMBER},sinceOpen:{_NUMBER},sinceChange:{_NUMBER}>>>>>"""


def _decoded(ledger: DataFrame) -> DataFrame:
    require(ledger, ["venue", "account", "seq", "recv_micros", "payload"])
    return ledger.withColumn("_p", F.from_json(F.col("payload").cast("string"), _SNAPSHOT)).withColumn("_s", F.col("_p.clearinghouseState"))


def _must(value: Column, path: str) -> Column:
    """A number printed as text; a row without it fails with its place, as a guess would be worse."""
    where = F.concat(F.col("venue"), F.lit("/"), F.col("account"), F.lit(" seq "), F.col("seq").cast("string"), F.lit(f" carries no {path}"))
    return F.when(value.isNull(), F.raise_error(where).cast("double")).otherwise(value.cast("double"))


def margin(ledger: DataFrame) -> DataFrame:
    """One row per account snapshot, from its JSON payload."""
    s = F.col("_s")
    summary = {name: _must(s["marginSummary"][key], f"marginSummary.{key}").alias(name) for key, name in (("accountValue", "account_value"), ("totalNtlPos", "total_notional"), ("totalRawUsd", "total_raw_usd"), ("totalMarginUsed", "total_margin_used"))}
    return _decoded(ledger).select("venue", "account", F.col("_p.dex").alias("dex"), F.timestamp_millis(s["time"]).alias("ts"), F.timestamp_micros("recv_micros").alias("recv_ts"), F.col("_p.mode.answer").alias("mode"), (F.col("_p.mode.answer") != "unifiedAccount").alias("equity_held"), *summary.values(), _must(s["withdrawable"], "withdrawable").alias("withdrawable"), F.size(s["assetPositions"]).alias("positions"))


def positions(ledger: DataFrame) -> DataFrame:
    """One row per position of each snapshot; the mark is value over size, null when flat."""
    rows = _decoded(ledger).select("venue", "account", "seq", F.col("_p.dex").alias("dex"), F.timestamp_millis(F.col("_s")["time"]).alias("ts"), F.explode(F.col("_s")["assetPositions"]).alias("_e")).withColumn("p", F.col("_e.position"))
    size, value = _must(F.col("p.szi"), "szi"), _must(F.col("p.positionValue"), "positionValue")
    return rows.select("venue", "account", "dex", "ts", F.col("p.coin").alias("coin"), size.alias("size"), F.col("p.entryPx").cast("double").alias("entry_px"), F.try_divide(value, F.nullif(F.abs(size), F.lit(0.0))).alias("mark_px"), value.alias("position_value"), _must(F.col("p.unrealizedPnl"), "unrealizedPnl").alias("unrealized_pnl"), F.col("p.liquidationPx").cast("double").alias("liquidation_px"), F.col("p.leverage.type").alias("leverage_type"), F.col("p.leverage.value").cast("double").alias("leverage"), F.col("p.cumFunding.allTime").cast("double").alias("cum_funding_all_time"))
