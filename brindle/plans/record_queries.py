"""Queries through the record on disk: the driver's events are written as a partitioned record in the shared folder and read back by its readers."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.plans import stand_ins as S
from brindle.plans.queries import query, r6
from brindle.refuse import Refused
from brindle.sources import fills, store, tape

START, END = datetime(2024, 1, 1, tzinfo=timezone.utc), datetime(2025, 1, 1, tzinfo=timezone.utc)
TICKERS = ["click", "error", "purchase", "signup", "view"]
#: A record once written serves every query of its session.
_written: dict[tuple[str, str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share; a temporary one in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise Refused("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brindle-record-")
    return found.rstrip("/")


def _root(spark: SparkSession, d: str, name: str, write) -> str:
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/record-{uuid.uuid4().hex}"
        write(path)
        _written[key] = path
    return _written[key]


def _received(t: DataFrame) -> DataFrame:
    """Ticks with the clocks and the order of a record; every fifth is received a second time, a second later."""
    at = F.unix_micros("ts")
    rows = t.withColumns({"at_micros": at, "recv_micros": at + 1000 * (F.col("event_id") % 500), "stream_seq": F.col("event_id")})
    again = rows.where("event_id % 5 = 0").withColumns({"recv_micros": F.col("recv_micros") + 1_000_000, "stream_seq": F.col("stream_seq") + 1_000_000_000})
    return rows.unionByName(again)


def _trades(spark, d):
    rows = _received(S.ticks(spark, d)).withColumn("trade_id", F.col("event_id").cast("string"))
    return _root(spark, d, "trades", lambda p: tape.append(rows, p, "trades"))


@query(f"WITH {S.TICKS} SELECT venue, ticker, epoch_us(ts) AS ts, epoch_us(ts) + 1000 * (event_id % 500) AS recv_ts, {r6('price')}, size::DOUBLE AS size, aggressor, CAST(event_id AS VARCHAR) AS trade_id FROM ticks")
def record_trades(spark, d):
    return tape.trades(spark, _trades(spark, d), TICKERS, START, END).drop("stream_seq")


@query(f"WITH {S.TICKS} SELECT venue, ticker, epoch_us(ts) AS ts, {r6('price')} FROM ticks WHERE ticker IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND ts <= TIMESTAMP '2024-01-11 12:00:00'")
def record_trades_window(spark, d):
    root = _trades(spark, d)
    tickers = tape.wanted(tape.scan(spark, root, "trades"), ["click", "view"])
    return tape.trades(spark, root, tickers, datetime(2024, 1, 10, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc), as_of=datetime(2024, 1, 11, 12, tzinfo=timezone.utc)).select("venue", "ticker", "ts", "price")


@query("SELECT CAST(max(CASE WHEN event_id % 5 = 0 THEN event_id + 1000000000 ELSE event_id END) AS BIGINT) AS last_stream_seq, epoch_us(max(ts)) AS max_ts, max(epoch_us(ts) + 1000 * (event_id % 500) + CASE WHEN event_id % 5 = 0 THEN 1000000 ELSE 0 END) AS max_recv_ts, count(DISTINCT CAST(ts AS DATE)) AS days FROM events")
def record_frontier(spark, d):
    return tape.frontier(spark, _trades(spark, d), "trades").withColumn("last_stream_seq", F.col("last_stream_seq").cast("long"))


@query(f"WITH {S.QUOTES} SELECT venue, ticker, epoch_us(ts) AS ts, {r6('bid_px', 'ask_px')}, bid_sz, ask_sz FROM quotes")
def record_quotes(spark, d):
    q = S.quotes(spark, d).withColumn("event_id", F.monotonically_increasing_id())
    rows = q.withColumns({"at_micros": F.unix_micros("ts"), "recv_micros": F.unix_micros("ts") + 1, "stream_seq": F.col("event_id")})
    return tape.quotes(spark, _root(spark, d, "quotes", lambda p: tape.append(rows, p, "quotes")), TICKERS, START, END).drop("recv_ts", "stream_seq")


@query(f"WITH {S.HOURLY} SELECT 'v' AS venue, ticker, '1h' AS interval, epoch_us(ts) AS ts, epoch_us(close_ts) AS close_ts, {r6('open', 'high', 'low', 'close')}, volume::DOUBLE AS volume, trade_count FROM bars WHERE ts < (SELECT max(b.ts) FROM bars b WHERE b.ticker = bars.ticker)")
def record_candles(spark, d):
    b = S.hourly(spark, d)
    end = b.withColumns({"venue": F.lit("v"), "interval": F.lit("1h"), "at_micros": F.unix_micros("ts"), "recv_micros": F.unix_micros("close_ts"), "stream_seq": F.unix_micros("ts"), "is_final": F.lit(True)})
    # a bar is received unfinished first, with its open as its close
    early = end.withColumns({"close": F.col("open"), "recv_micros": F.col("recv_micros") - 1_800_000_000, "is_final": F.lit(False)})
    root = _root(spark, d, "candles", lambda p: tape.append(end.unionByName(early), p, "candles"))
    return tape.candles(spark, root, TICKERS, "1h", START, END).drop("recv_ts")


_FUNDING = f"""{S.TICKS}, f AS (SELECT ticker, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 8 HOUR AS ts, max(price) / 1000 AS rate FROM ticks GROUP BY ALL)"""


def _funding(spark, d):
    settled = S.ticks(spark, d).groupBy("venue", "ticker", C.plus(C.bucket(F.col("ts"), "8h"), "8h").alias("ts")).agg((F.max("price") / 1000).alias("rate"))
    at = F.unix_micros("ts")
    rows = settled.withColumns({"at_micros": at, "recv_micros": at + 121_000, "stream_seq": at, "premium": F.col("rate") / 2})
    # the rate to come is received every hour before, twice at the same value
    live = rows.withColumn("_h", F.explode(F.sequence(F.lit(1), F.lit(7)))).withColumns({"next_micros": F.col("at_micros"), "recv_micros": at - F.col("_h") * F.lit(3_600_000_000), "stream_seq": at - F.col("_h")}).withColumn("at_micros", F.lit(None).cast("long")).withColumn("rate", F.col("rate") * F.floor((8 - F.col("_h")) / 2)).drop("_h")
    return _root(spark, d, "funding", lambda p: tape.append(rows.unionByName(live, allowMissingColumns=True), p, "funding"))


@query(f"WITH {_FUNDING} SELECT 'v' AS venue, ticker, epoch_us(ts) AS ts, {r6('rate')}, round(rate / 2, 6) + 0.0 AS premium, epoch_us(ts) + 121000 AS recv_ts FROM f WHERE ts < TIMESTAMP '2025-01-01'")
def record_funding(spark, d):
    return tape.funding(spark, _funding(spark, d), TICKERS, START, END)


@query(f"""WITH {_FUNDING}, l AS (SELECT ticker, ts - to_hours(h) AS recv_ts, round(rate * floor((8 - h) / 2.0::DOUBLE), 6) AS rate FROM f, (SELECT unnest(generate_series(1, 7)) AS h)), c AS (SELECT *, lag(rate) OVER (PARTITION BY ticker ORDER BY recv_ts) AS was FROM l WHERE recv_ts >= TIMESTAMP '2024-01-01' AND recv_ts < TIMESTAMP '2025-01-01')
  SELECT 'v' AS venue, ticker, epoch_us(recv_ts) AS recv_ts, rate + 0.0 AS rate FROM c WHERE was IS DISTINCT FROM rate""")
def record_funding_live(spark, d):
    rounded = tape.received(spark, _funding(spark, d), "funding", ["rate"], TICKERS, START, END).withColumn("rate", F.round("rate", 6))
    from brindle.operators import record as R

    return R.collapse(rounded, ["venue", "ticker"], ["recv_ts"], ["rate"])


@query(f"WITH {S.TICKS} SELECT venue, ticker, epoch_us(ts) + 1000 * (event_id % 500) AS recv_ts, round(price, 6) + 0.0 AS mark, round(price / 2, 6) + 0.0 AS oracle FROM ticks")
def record_marks(spark, d):
    rows = S.ticks(spark, d).withColumns({"at_micros": F.lit(None).cast("long"), "recv_micros": F.unix_micros("ts") + 1000 * (F.col("event_id") % 500), "stream_seq": F.col("event_id"), "mark": F.col("price"), "oracle": F.col("price") / 2})
    return tape.received(spark, _root(spark, d, "marks", lambda p: tape.append(rows, p, "marks")), "marks", ["mark", "oracle"], TICKERS, START, END)


@query("""SELECT 'v' AS venue, event_type AS ticker, 'trades' AS series, epoch_us(ts) AS from_ts, epoch_us(ts) + 60000000 * (event_id % 90) AS to_ts, 'cause' || (event_id % 3) AS cause FROM events
  WHERE event_id % 50 = 0 AND ts < TIMESTAMP '2024-01-20' AND epoch_us(ts) + 60000000 * (event_id % 90) > epoch_us(TIMESTAMP '2024-01-05')""")
def record_gaps(spark, d):
    t = S.ticks(spark, d).where("event_id % 50 = 0")
    at = F.unix_micros("ts")
    rows = t.select("venue", "ticker", F.lit("trades").alias("series"), at.alias("from_micros"), (at + 60_000_000 * (F.col("event_id") % 90)).alias("to_micros"), F.concat(F.lit("cause"), F.col("event_id") % 3).alias("cause"))
    root = _root(spark, d, "gaps", lambda p: tape.append(rows, p, "gaps"))
    return tape.gaps(spark, root, datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc), series="trades")


_SIGNALS = """s AS (SELECT 'corr' AS signal, CASE WHEN event_id % 2 = 0 THEN '1d' ELSE '4h' END AS horizon, event_type AS ticker_i, CASE WHEN event_type = 'view' THEN 'click' ELSE 'view' END AS ticker_j, CAST(event_id % 3 AS BIGINT) AS h, date_trunc('day', ts) AS day0, epoch_us(ts) + 1000000 * (user_id % 7) AS computed, CAST(event_id AS VARCHAR) AS run_id, value FROM events),
 k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY horizon, ticker_i, ticker_j, h, day0 ORDER BY computed DESC, run_id DESC) AS r FROM s WHERE computed <= epoch_us(TIMESTAMP '2024-01-20 12:00:00')) WHERE r = 1)"""


def _signals(spark, d):
    t = S.table(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    rows = t.select(
        F.lit("corr").alias("signal"), F.when(F.col("event_id") % 2 == 0, "1d").otherwise("4h").alias("horizon"), F.lit("rho").alias("measure"), F.col("event_type").alias("ticker_i"), F.when(F.col("event_type") == "view", "click").otherwise("view").alias("ticker_j"),
        (F.col("event_id") % 3).cast("long").alias("h"), "value", F.unix_micros(F.date_trunc("day", ts)).alias("asof_micros"), (F.unix_micros(ts) + 1_000_000 * (F.col("user_id") % 7)).alias("computed_micros"), F.col("event_id").cast("string").alias("run_id"),
    )
    root = _root(spark, d, "signals", lambda p: tape.append(rows, p, "signals"))
    return tape.history(spark, root, "corr", START, END, as_of=datetime(2024, 1, 20, 12, tzinfo=timezone.utc))


@query(f"WITH {_SIGNALS} SELECT horizon, ticker_i, ticker_j, h, epoch_us(day0) AS ts, computed AS computed_ts, round(value, 6) + 0.0 AS value FROM k")
def record_signals(spark, d):
    return _signals(spark, d).select("horizon", "ticker_i", "ticker_j", "h", "ts", "computed_ts", "value")


@query(f"WITH {_SIGNALS}, n AS (SELECT *, max(day0) OVER (PARTITION BY horizon) AS newest FROM k WHERE computed <= epoch_us(TIMESTAMP '2024-01-15') AND day0 > TIMESTAMP '2024-01-01') SELECT horizon, ticker_i, h, epoch_us(day0) AS ts, round(value, 6) + 0.0 AS value FROM n WHERE day0 = newest")
def record_signals_known(spark, d):
    return tape.known_at(_signals(spark, d), datetime(2024, 1, 15, tzinfo=timezone.utc)).select("horizon", "ticker_i", "h", "ts", "value")


@query(f"""WITH {_SIGNALS}, p AS (SELECT ticker_i AS a, ticker_j AS b, round(max(value), 6) + 0.0 AS v FROM k WHERE horizon = '1d' AND h = 0 AND ticker_i <> 'view' GROUP BY ALL), q AS (SELECT a, b, v FROM p UNION ALL SELECT b, a, v FROM p)
  SELECT a AS ticker, {', '.join(f"max(CASE WHEN b = '{t}' THEN v END) AS {t}" for t in TICKERS)} FROM q GROUP BY a""")
def record_pair_matrix(spark, d):
    pairs = _signals(spark, d).where("horizon = '1d' and h = 0 and ticker_i <> 'view'").groupBy("ticker_i", "ticker_j").agg(F.max("value").alias("value"))
    return tape.pair_matrix(pairs, TICKERS)


def _ledger(spark, d):
    c = S.table(spark, d, "customer")
    text = lambda x: F.format_number(x, 4).cast("string")
    plain = lambda x: F.regexp_replace(text(x), ",", "")
    position = F.struct(
        F.col("c_mktsegment").alias("coin"), plain(F.col("c_acctbal") / 10).alias("szi"), plain(F.abs("c_acctbal") + 1).alias("entryPx"), plain(F.abs("c_acctbal") * 2).alias("positionValue"), plain(F.col("c_acctbal")).alias("unrealizedPnl"), F.struct(F.lit("cross").alias("type"), F.lit("5").alias("value")).alias("leverage")
    )
    state = F.struct(
        F.struct(plain(F.col("c_acctbal") + 10000).alias("accountValue"), plain(F.abs("c_acctbal") * 2).alias("totalNtlPos"), plain(F.col("c_acctbal")).alias("totalRawUsd"), F.lit("0.0").alias("totalMarginUsed")).alias("marginSummary"),
        plain(F.col("c_acctbal") + 5000).alias("withdrawable"), F.array(F.struct(position.alias("position"))).alias("assetPositions"), (F.lit(1_704_067_200_000) + F.col("c_custkey")).alias("time"),
    )
    payload = F.to_json(F.struct(F.lit("main").alias("dex"), F.struct(F.lit("ok").alias("answer")).alias("mode"), state.alias("clearinghouseState")))
    return c.select(F.lit("v").alias("venue"), F.concat(F.lit("acct"), F.col("c_nationkey")).alias("account"), F.col("c_custkey").alias("seq"), (F.lit(1_704_067_200_000_000) + F.col("c_custkey")).alias("recv_micros"), payload.cast("binary").alias("payload"))


@query("SELECT 'v' AS venue, 'acct' || c_nationkey AS account, (1704067200000 + c_custkey) * 1000 AS ts, round(c_acctbal + 10000, 3) + 0.0 AS account_value, round(abs(c_acctbal) * 2, 3) + 0.0 AS total_notional, round(c_acctbal + 5000, 3) + 0.0 AS withdrawable, CAST(1 AS INTEGER) AS positions FROM customer", digits=3)
def account_margin(spark, d):
    return tape.margin(_ledger(spark, d)).select("venue", "account", "ts", "account_value", "total_notional", "withdrawable", "positions")


@query("SELECT 'v' AS venue, 'acct' || c_nationkey AS account, (1704067200000 + c_custkey) * 1000 AS ts, c_mktsegment AS coin, round(c_acctbal / 10, 3) + 0.0 AS size, round(abs(c_acctbal) * 2, 3) + 0.0 AS position_value, CASE WHEN round(c_acctbal / 10, 4) <> 0 THEN round(round(abs(c_acctbal) * 2, 4) / abs(round(c_acctbal / 10, 4)), 3) + 0.0 END AS mark_px, 5.0::DOUBLE AS leverage FROM customer", digits=3)
def account_positions(spark, d):
    return tape.positions(_ledger(spark, d)).select("venue", "account", "ts", "coin", "size", "position_value", "mark_px", "leverage")


@query("SELECT 'v' AS venue, 'acct' || (user_id % 4) AS account, event_type AS ticker, epoch_us(ts) AS ts, CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side, round(value + 1, 6) + 0.0 AS price FROM events WHERE user_id % 4 IN (1, 3) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28'")
def account_fills(spark, d):
    t = S.table(spark, d, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.select(F.lit("v").alias("venue"), F.concat(F.lit("acct"), F.col("user_id") % 4).alias("account"), F.lit("fills").alias("kind"), F.lit("main").alias("dex"), F.col("event_type").alias("ticker"), at.alias("at_micros"), (at + 5).alias("recv_micros"), F.when(F.col("event_id") % 2 == 0, "B").otherwise("A").alias("side"), (F.col("value") + 1).alias("price"))
    root = _root(spark, d, "ledger", lambda p: rows.write.partitionBy("venue", "account", "kind").parquet(p))
    got = store.ledger(spark, root, "fills", datetime(2024, 1, 3, tzinfo=timezone.utc), datetime(2024, 1, 28, tzinfo=timezone.utc), accounts=["acct1", "acct3"], venue="v")
    return got.select("venue", "account", "ticker", "ts", "side", "price")


@query(f"WITH {S.HOURLY} SELECT 'v' AS venue, ticker, epoch_us(ts) AS ts, {r6('close')}, volume::DOUBLE AS volume FROM bars WHERE ts >= TIMESTAMP '2024-01-04' AND ts < TIMESTAMP '2024-01-25' AND close_ts <= TIMESTAMP '2024-01-24 06:00:00' AND ticker <> 'error'")
def store_candles(spark, d):
    b = S.hourly(spark, d).withColumns({"venue": F.lit("v"), "interval": F.lit("1h"), "volume": F.col("volume").cast("double")})
    names = [f.split()[0] for f in store.KINDS["candles"].split(", ") if f.split()[0] in b.columns]
    root = _root(spark, d, "store", lambda p: store.save(b.select(*names), p, "candles"))
    got = store.load(spark, root, "candles", datetime(2024, 1, 4, tzinfo=timezone.utc), datetime(2024, 1, 25, tzinfo=timezone.utc), tickers=[t for t in TICKERS if t != "error"], venues=["v"], as_of=datetime(2024, 1, 24, 6, tzinfo=timezone.utc))
    return got.select("venue", "ticker", "ts", "close", "volume")


def _fill_lines(spark, d):
    """Each event as a taker's fill and its maker's, a line each, in an hour's file: at the nearest millisecond, a half away from 1970 as in the SQL, and under a number of its own."""
    time = F.expr("(unix_micros(ts) + if(unix_micros(ts) < 0, -500, 500)) div 1000")
    t = S.ticks(spark, d).withColumns({"time": time, "ts": F.timestamp_millis(time), "tid": F.monotonically_increasing_id()})
    one = lambda side, crossed: F.to_json(F.struct(F.col("ticker").alias("coin"), F.col("price").cast("string").alias("px"), F.col("size").cast("string").alias("sz"), side.alias("side"), "time", F.lit(crossed).alias("crossed"), "tid"))
    buys = F.col("aggressor") == "bid"
    taker, maker = one(F.when(buys, "B").otherwise("A"), True), one(F.when(buys, "A").otherwise("B"), False)
    line = F.explode(F.array(*[F.concat(F.lit('["0x0",'), x, F.lit("]")) for x in (taker, maker)]))
    rows = t.withColumn("value", line).select(F.date_format("ts", "yyyyMMddHH").alias("hour"), "ts", "value")
    return _root(spark, d, "fills", lambda p: rows.repartition("hour").sortWithinPartitions("hour", "ts").drop("ts").write.partitionBy("hour").text(p))


@query(f"""WITH {S.TICKS}, t AS (SELECT *, epoch_ms(epoch_ms(ts)) AS moment FROM ticks) SELECT ticker, epoch_us(date_trunc('minute', moment)) AS ts, {', '.join(f"round({x}, 6) + 0.0 AS {n}" for n, x in (('high', 'max(price)'), ('low', 'min(price)'), ('notional', 'sum(price * size)')))}, sum(size)::DOUBLE AS volume, count(*) AS trade_count, coalesce(sum(CASE WHEN aggressor = 'bid' THEN size END), 0)::DOUBLE AS taker_buy_volume, CAST(0 AS BIGINT) AS liquidations FROM t GROUP BY ticker, date_trunc('minute', moment)""")
def fill_bars(spark, d):
    rows = fills.parsed(fills.lines(spark, f"{_fill_lines(spark, d)}/*"))
    return fills.minute_bars(fills.trades(rows, {t: t for t in TICKERS})).select("ticker", "ts", "high", "low", "notional", "volume", "trade_count", "taker_buy_volume", "liquidations")
