"""Every query over the driver's tables with its SQL.  Times come out as microseconds, and floats rounded, so that both sides compare exactly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import asof as A
from brindle.operators import backtest as T
from brindle.operators import bars as B
from brindle.operators import indicators as I
from brindle.operators import liquidity as L
from brindle.operators import record as R
from brindle.plans import stand_ins as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Timestamps as microseconds, doubles rounded, -0.0 as 0.0."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        out.append((F.unix_micros(c) if kind == "timestamp" else F.round(c, digits) + F.lit(0.0) if kind == "double" else c).alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, digits: int = 6) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


US = "epoch_us(ts) AS ts, epoch_us(close_ts) AS close_ts"


@query(f"WITH {S.HOURLY} SELECT ticker, {US}, {r6('open', 'high', 'low', 'close')}, volume, trade_count FROM bars")
def bars_hourly(spark, d):
    return S.hourly(spark, d)


@query(f"WITH {S.HOURLY}{S.RETURNS} SELECT ticker, {US}, {r6('lr')} FROM r")
def returns_log(spark, d):
    return B.returns(S.hourly(spark, d), "log").withColumnRenamed("return", "lr")


@query(f"WITH {S.DAILY}{S.RETURNS} SELECT ticker, {US}, {r6('sr')} FROM r")
def returns_simple_daily(spark, d):
    return B.returns(S.daily(spark, d), "simple").withColumnRenamed("return", "sr")


def _realized_sql(term: str, agg: str) -> str:
    return f"""WITH {S.DAILY}{S.RETURNS}, t AS (SELECT *, CASE WHEN nxt THEN {term} END AS x, CAST(nxt AS BIGINT) AS c FROM r)
      SELECT ticker, {US}, CAST(sum(c) OVER w AS BIGINT) AS n, CASE WHEN sum(c) OVER w >= 10 THEN round(sqrt({agg}), 6) + 0.0 END AS sigma FROM t
      WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


@query(_realized_sql("lr", "pow(stddev_samp(x) OVER w, 2)"))
def realized_close_to_close(spark, d):
    return B.realized(S.daily(spark, d), "close_to_close", 20, min_periods=10)


@query(_realized_sql("pow(ln(high / low), 2) / (4 * ln(2))", "avg(x) OVER w"))
def realized_parkinson(spark, d):
    return B.realized(S.daily(spark, d), "parkinson", 20, min_periods=10)


@query(_realized_sql("0.5::DOUBLE * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)", "avg(x) OVER w"))
def realized_garman_klass(spark, d):
    # with few prints a day the term's mean can be below 0, and there is no sigma then
    out = B.realized(S.daily(spark, d), "garman_klass", 20, min_periods=10)
    return out.withColumn("sigma", F.nanvl("sigma", F.lit(None).cast("double")))


SQL["realized_garman_klass"] = SQL["realized_garman_klass"].replace("sqrt(avg(x) OVER w)", "sqrt(CASE WHEN avg(x) OVER w >= 0 THEN avg(x) OVER w END)")


@query(_realized_sql("ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)", "greatest(avg(x) OVER w, 0)"))
def realized_rogers_satchell(spark, d):
    return B.realized(S.daily(spark, d), "rogers_satchell", 20, min_periods=10)


@query(f"""WITH {S.DAILY}{S.RETURNS}, t AS (SELECT *, CASE WHEN nxt THEN ln(open / prev) END AS a, CASE WHEN nxt THEN ln(close / open) END AS b,
    CASE WHEN nxt THEN ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) END AS x, CAST(nxt AS BIGINT) AS c FROM r),
  v AS (SELECT ticker, ts, close_ts, CAST(sum(c) OVER w AS BIGINT) AS n, var_samp(a) OVER w AS va, var_samp(b) OVER w AS vb, avg(x) OVER w AS vx FROM t WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
  SELECT ticker, {US}, n, CASE WHEN n >= 10 THEN round(sqrt(va + 0.34::DOUBLE / (1.34::DOUBLE + (n + 1.0::DOUBLE) / (n - 1)) * vb + (1 - 0.34::DOUBLE / (1.34::DOUBLE + (n + 1.0::DOUBLE) / (n - 1))) * vx), 6) + 0.0 END AS sigma FROM v""")
def realized_yang_zhang(spark, d):
    return B.realized(S.daily(spark, d), "yang_zhang", 20, min_periods=10)


@query(f"""WITH {S.HOURLY}, b AS (SELECT ticker, date_trunc('day', ts) AS d, count(*) AS n, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM bars GROUP BY 1, 2)
  SELECT ticker, epoch_us(d) AS ts, epoch_us(d + INTERVAL 1 DAY) AS close_ts, {r6('open', 'high', 'low', 'close')}, volume, trade_count, n FROM b WHERE n = 24""")
def resample_whole_days(spark, d):
    return B.resample(S.hourly(spark, d), "1d", "1h")


@query(f"""WITH {S.HOURLY}, b AS (SELECT ticker, time_bucket(INTERVAL 4 HOUR, ts) AS d, count(*) AS n, max(high) AS high, min(low) AS low FROM bars GROUP BY 1, 2)
  SELECT ticker, epoch_us(d) AS ts, {r6('high', 'low')}, n FROM b WHERE n = 4""")
def resample_4h(spark, d):
    return B.resample(S.hourly(spark, d), "4h", "1h").select("ticker", "ts", "high", "low", "n")


@query(f"""WITH {S.HOURLY}{S.RETURNS}, b AS (SELECT ticker, time_bucket(INTERVAL 4 HOUR, ts) AS d, count(lr) AS n, sum(lr * lr) AS rv, sum(CASE WHEN lr IS NOT NULL THEN pow(ln(high / low), 2) / (4 * ln(2)) END) AS rr,
    coalesce(sum(CASE WHEN lr > 0 THEN lr * lr END), 0) AS rs_plus, coalesce(sum(CASE WHEN lr < 0 THEN lr * lr END), 0) AS rs_minus, sum(pow(lr, 4)) AS q FROM r GROUP BY 1, 2)
  SELECT ticker, epoch_us(d) AS ts, epoch_us(d + INTERVAL 4 HOUR) AS close_ts, n, CAST(4 AS BIGINT) AS expected, {', '.join(f"CASE WHEN n = 4 THEN round({c}, 6) + 0.0 END AS {c}" for c in ('rv', 'rr', 'rs_plus', 'rs_minus'))}, CASE WHEN n = 4 THEN round(n / 3.0::DOUBLE * q, 6) + 0.0 END AS rq FROM b""")
def realized_variance_4h(spark, d):
    return B.realized_from(S.hourly(spark, d), "4h", "1h")


@query(f"""WITH {S.HOURLY}{S.RETURNS}, b AS (SELECT ticker, date_trunc('day', close_ts - INTERVAL 1 MICROSECOND) AS d, count(*) AS n, sum(lr * lr) AS rv, sum(pow(lr, 3)) AS s3, sum(pow(lr, 4)) AS s4 FROM r WHERE lr IS NOT NULL GROUP BY 1, 2)
  SELECT ticker, epoch_us(d) AS ts, n, round(rv, 6) + 0.0 AS rv, CASE WHEN n >= 5 AND rv > 0 THEN round(sqrt(n) * s3 / pow(rv, 1.5), 6) + 0.0 END AS skew, CASE WHEN n >= 5 AND rv > 0 THEN round(n * s4 / pow(rv, 2), 6) + 0.0 END AS kurt FROM b""")
def realized_moments(spark, d):
    return B.realized_moments(B.returns(S.hourly(spark, d), "log"), "1d", min_n=5)


@query(f"""WITH {S.HOURLY}, g AS (SELECT ticker, close_ts, close, unnest([60, 120, 240]) AS minutes FROM bars), f AS (SELECT * FROM g WHERE epoch_us(close_ts) % (minutes * 60000000::BIGINT) = 0),
  r AS (SELECT *, CASE WHEN epoch_us(close_ts) - lag(epoch_us(close_ts)) OVER w = minutes * 60000000::BIGINT THEN ln(close / lag(close) OVER w) END AS x, CAST(make_timestamp(epoch_us(close_ts) - minutes * 60000000::BIGINT) AS DATE) AS day FROM f WINDOW w AS (PARTITION BY ticker, minutes ORDER BY close_ts)),
  d AS (SELECT ticker, minutes, day, count(x) AS n, sum(x * x) AS rv FROM r GROUP BY ALL HAVING count(x) * minutes = 1440)
  SELECT ticker, minutes, count(*) AS days, round(avg(rv), 6) + 0.0 AS mean_rv FROM d GROUP BY ticker, minutes""")
def signature_plot(spark, d):
    return B.signature(S.hourly(spark, d), (60, 120, 240))


@query(f"""WITH {S.HOURLY}{S.RETURNS}, c AS (SELECT ticker, isodow(ts) AS weekday, hour(ts) AS hour, avg(abs(lr)) AS factor FROM r WHERE lr IS NOT NULL GROUP BY ALL)
  SELECT ticker, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, round(factor / nullif(sqrt(avg(factor * factor) OVER (PARTITION BY ticker)), 0), 6) + 0.0 AS factor FROM c""")
def seasonal_hour_of_week(spark, d):
    return B.seasonal_factors(B.returns(S.hourly(spark, d), "log"), "hour_of_week")


@query(f"""WITH {S.HOURLY}{S.RETURNS}, x AS (SELECT ticker, isodow(ts) AS weekday, hour(ts) AS hour, abs(lr) AS a FROM r WHERE lr IS NOT NULL), h AS (SELECT ticker, hour, avg(a) AS fh FROM x GROUP BY ALL), w AS (SELECT ticker, weekday, avg(a) AS fw FROM x GROUP BY ALL),
  c AS (SELECT h.ticker, weekday, hour, fh * fw AS factor FROM h JOIN w ON h.ticker = w.ticker), f AS (SELECT *, factor / sqrt(avg(factor * factor) OVER (PARTITION BY ticker)) AS g FROM c)
  SELECT r.ticker, epoch_us(r.ts) AS ts, round(lr / g, 6) + 0.0 AS deseasonalized FROM r LEFT JOIN f ON r.ticker = f.ticker AND isodow(r.ts) = f.weekday AND hour(r.ts) = f.hour""")
def deseasonalized_returns(spark, d):
    rets = B.returns(S.hourly(spark, d), "log")
    return B.deseasonalize(rets, B.seasonal_factors(rets)).select("ticker", "ts", "deseasonalized")


@query(f"WITH RECURSIVE {S.DAILY}{S.RETURNS}, q AS (SELECT ticker, ts, lr, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM r WHERE lr IS NOT NULL), e AS (SELECT ticker, ts, i, lr * lr AS s FROM q WHERE i = 1 UNION ALL SELECT q.ticker, q.ts, q.i, 0.94::DOUBLE * e.s + 0.06::DOUBLE * q.lr * q.lr FROM e JOIN q ON q.ticker = e.ticker AND q.i = e.i + 1) SELECT ticker, epoch_us(ts) AS ts, i AS n, round(sqrt(s), 6) + 0.0 AS sigma FROM e WHERE i > 75")
def ewma_volatility(spark, d):
    w = W.partitionBy("ticker", "n").orderBy("ts")
    # a hole repeats the last value; the oracle lists returns only
    return B.ewma_vol(S.daily(spark, d)).where("sigma is not null").withColumn("_k", F.row_number().over(w)).where("_k = 1").select("ticker", "ts", "n", "sigma")


@query(f"""WITH {S.DAILY}{S.RETURNS} SELECT ticker, epoch_us(date_trunc('month', ts)) AS period, round(product(1 + sr) - 1, 6) + 0.0 AS period_return, count(*) AS n FROM r WHERE sr IS NOT NULL GROUP BY ALL""")
def monthly_returns(spark, d):
    return B.period_returns(B.returns(S.daily(spark, d)).withColumnRenamed("return", "net"), "1mo")


# record


@query(f"""WITH {S.TICKS}, copies AS (SELECT *, unnest([0, 1, 2]) AS k FROM ticks) SELECT event_id, arg_max(price * (k + 1), k) AS price, CAST(max(k) AS BIGINT) AS seq FROM copies GROUP BY event_id""".replace("arg_max(price * (k + 1), k) AS price", "round(arg_max(price * (k + 1), k), 6) + 0.0 AS price"))
def latest_receipt(spark, d):
    t = S.ticks(spark, d).select("event_id", "price", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    raw = t.select("event_id", (F.col("price") * (F.col("k") + 1)).alias("price"), F.col("k").cast("long").alias("seq"))
    return R.latest(raw, ["event_id"], ["seq"])


@query(f"""WITH {S.TICKS}, copies AS (SELECT *, unnest([0, 1, 2]) AS k FROM ticks) SELECT event_id, round(arg_min(price * (k + 1), k), 6) + 0.0 AS price, CAST(min(k) AS BIGINT) AS seq FROM copies GROUP BY event_id""")
def first_receipt(spark, d):
    t = S.ticks(spark, d).select("event_id", "price", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return R.earliest(t.select("event_id", (F.col("price") * (F.col("k") + 1)).alias("price"), F.col("k").cast("long").alias("seq")), ["event_id"], ["seq"])


@query(f"""WITH {S.HOURLY}, l AS (SELECT *, max(ts) OVER (PARTITION BY ticker) AS last FROM bars) SELECT ticker, epoch_us(ts) AS ts, trade_count FROM l WHERE ts < last AND trade_count > 0 AND close_ts <= TIMESTAMP '2024-01-20 00:00:00'""")
def candles_closed_as_of(spark, d):
    h = S.hourly(spark, d).withColumns({"venue": F.lit("v"), "interval": F.lit("1h"), "recv_ts": F.col("close_ts"), "stream_seq": F.lit(0)})
    raw = h.unionByName(h.withColumn("recv_ts", C.plus(F.col("recv_ts"), "1s")))
    return R.candles(raw, as_of=F.lit("2024-01-20 00:00:00").cast("timestamp")).select("ticker", "ts", "trade_count")


@query(f"""WITH {S.TICKS}, w AS (SELECT ticker, ts, event_id, size % 3 AS v, lag(size % 3) OVER (PARTITION BY ticker ORDER BY ts) AS p, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM ticks) SELECT ticker, epoch_us(ts) AS ts, event_id, v FROM w WHERE i = 1 OR v IS DISTINCT FROM p""")
def collapse_repeats(spark, d):
    return R.collapse(S.ticks(spark, d).select("ticker", "ts", "event_id", (F.col("size") % 3).alias("v")), ["ticker"], ["ts"], ["v"])


_GAPS = S.TICKS + """, gaps AS (SELECT venue, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'click' END AS ticker, ts AS lo, ts + INTERVAL 10 MINUTE AS hi, 'c' || (event_id % 2) AS cause FROM ticks WHERE ticker = 'error'),
  g AS (SELECT *, max(hi) OVER (PARTITION BY ticker ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT venue, ticker, lo - INTERVAL 1 SECOND AS lo, hi, cause FROM gaps)),
  m AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY lo, hi) AS run FROM g),
  win AS (SELECT venue, ticker, min(lo) AS lo, max(hi) AS hi, string_agg(DISTINCT cause, ',' ORDER BY cause) AS causes FROM m GROUP BY venue, ticker, run)"""


def _gaps(spark, d):
    e = S.ticks(spark, d).where("ticker = 'error'")
    return e.select("venue", F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise("click").alias("ticker"), F.col("ts").alias("from_ts"), C.plus(F.col("ts"), "10m").alias("to_ts"), F.concat(F.lit("c"), F.col("event_id") % 2).alias("cause"))


@query(f"WITH {_GAPS} SELECT venue, ticker, epoch_us(lo) AS lo, epoch_us(hi) AS hi, causes FROM win")
def gaps_merged(spark, d):
    return R.merged_gaps(_gaps(spark, d), "1s")


@query(f"""WITH {_GAPS}, j AS (SELECT t.event_id, list_sort(list_distinct(flatten(list(string_split(w.causes, ','))))) AS c FROM ticks t JOIN win w ON t.ts >= w.lo AND t.ts < w.hi AND (w.ticker IS NULL OR w.ticker = t.ticker) GROUP BY t.event_id)
  SELECT t.event_id, j.c IS NOT NULL AS in_gap, array_to_string(j.c, ',') AS gap_cause FROM ticks t LEFT JOIN j ON t.event_id = j.event_id""")
def gaps_masked(spark, d):
    return R.mask_gaps(S.ticks(spark, d), _gaps(spark, d), "trades").select("event_id", "in_gap", "gap_cause")


@query(f"""WITH {S.TICKS}, slots AS (SELECT ticker, price, time_bucket(INTERVAL 8 HOUR, ts, TIMESTAMP '2000-01-01') + INTERVAL 8 HOUR AS h FROM ticks), s AS (SELECT ticker, h, max(price / 1000) AS rate, 8 AS n FROM slots GROUP BY ALL),
  x AS (SELECT ticker, h, rate, unnest(generate_series(h - INTERVAL 7 HOUR, h, INTERVAL 1 HOUR)) AS t FROM s) SELECT 'v' AS venue, ticker, epoch_us(t) AS ts, round(coalesce(max(CASE WHEN t = h THEN rate END), 0), 6) + 0.0 AS rate FROM x GROUP BY ticker, t""")
def funding_by_hour(spark, d):
    # every event counts towards the settlement that ends its eight hours
    settled = S.ticks(spark, d).groupBy("venue", "ticker", C.plus(C.bucket(F.col("ts"), "8h"), "8h").alias("ts")).agg(F.max(F.col("price") / 1000).alias("rate")).withColumn("interval_hours", F.lit(8))
    return R.funding_hours(settled)


@query("""WITH m AS (SELECT event_type AS kind, 'v' AS venue, CAST(user_id % 5 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'absent' ELSE 'mismatch' END AS status FROM events)
  SELECT kind, venue, ticker, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, count(DISTINCT date) AS days, CAST(sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN status = 'partial' THEN 1 ELSE 0 END) AS BIGINT) AS partial, CAST(sum(CASE WHEN status = 'absent' THEN 1 ELSE 0 END) AS BIGINT) AS absent,
  CAST(sum(CASE WHEN status = 'mismatch' THEN 1 ELSE 0 END) AS BIGINT) AS mismatch, CAST(date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT) AS days_missing FROM m GROUP BY ALL""")
def coverage(spark, d):
    status = F.element_at(F.array(*map(F.lit, ("ok", "partial", "absent", "mismatch"))), (F.col("event_id") % 4 + 1).cast("int"))
    m = S.table(spark, d, "events").select(F.col("event_type").alias("kind"), F.lit("v").alias("venue"), (F.col("user_id") % 5).cast("string").alias("ticker"), F.to_date("ts").alias("date"), status.alias("status"))
    return R.coverage(m).withColumns({"first": F.col("first").cast("string"), "last": F.col("last").cast("string")})


@query(f"""WITH {S.HOURLY}, a AS (SELECT * FROM bars WHERE hour(ts) <> 3), b AS (SELECT ticker, ts, CASE WHEN hour(ts) = 5 THEN close + 1 ELSE close END AS close FROM bars WHERE hour(ts) <> 7)
  SELECT coalesce(a.ticker, b.ticker) AS ticker, epoch_us(coalesce(a.ts, b.ts)) AS ts, CASE WHEN b.ticker IS NULL THEN 'left_only' WHEN a.ticker IS NULL THEN 'right_only' WHEN abs(a.close - b.close) <= 1e-9 * greatest(abs(a.close), abs(b.close)) THEN 'same' ELSE 'differs' END AS state FROM a FULL JOIN b ON a.ticker = b.ticker AND a.ts = b.ts""")
def compare_sources(spark, d):
    h = S.hourly(spark, d)
    other = h.where("hour(ts) <> 7").withColumn("close", F.when(F.hour("ts") == 5, F.col("close") + 1).otherwise(F.col("close")))
    return R.compare(h.where("hour(ts) <> 3"), other, ["ticker", "ts"], ["close"]).select("ticker", "ts", "state")


# joins


@query(f"""WITH {S.TICKS}, l AS (SELECT * FROM ticks WHERE ticker = 'click'), r AS (SELECT 'click' AS ticker, ts AS recv, price AS mark FROM ticks WHERE ticker = 'view')
  SELECT l.event_id, CASE WHEN epoch_us(l.ts) - epoch_us(r.recv) <= 3600000000 THEN round(r.mark, 6) + 0.0 END AS mark_recv, CASE WHEN epoch_us(l.ts) - epoch_us(r.recv) <= 3600000000 THEN epoch_us(r.recv) END AS matched_recv_ts FROM l ASOF LEFT JOIN r ON l.ticker = r.ticker AND l.ts >= r.recv""")
def join_received(spark, d):
    t = S.ticks(spark, d)
    right = t.where("ticker = 'view'").select("venue", F.lit("click").alias("ticker"), F.col("ts").alias("recv_ts"), F.col("price").alias("mark"))
    return A.join_recv(t.where("ticker = 'click'"), right, tolerance="1h").select("event_id", "mark_recv", "matched_recv_ts")


@query(f"""WITH {S.QUOTES}, t AS (SELECT * FROM ticks), e AS (SELECT t.*, CASE WHEN epoch_us(t.ts) - epoch_us(q.ts) <= 7200000000 THEN (bid_px + ask_px) / 2 END AS mid FROM t ASOF LEFT JOIN quotes q ON t.ticker = q.ticker AND t.ts > q.ts),
  f AS (SELECT e.*, (q.bid_px + q.ask_px) / 2 AS m2, CASE aggressor WHEN 'bid' THEN 1 ELSE -1 END AS q_ FROM e ASOF LEFT JOIN quotes q ON e.ticker = q.ticker AND e.ts + INTERVAL 60 SECOND >= q.ts)
  SELECT event_id, round(2 * q_ * (price - mid) / mid * 10000, 4) + 0.0 AS effective_bps, round(2 * q_ * (price - m2) / mid * 10000, 4) + 0.0 AS realized_bps_60s FROM f""", digits=4)
def effective_spread(spark, d):
    return L.effective(S.ticks(spark, d), S.quotes(spark, d), tolerance="2h", horizons=("60s",)).select("event_id", "effective_bps", "realized_bps_60s")


# liquidity

_FLOW = f"""{S.TICKS}, b AS (SELECT ticker, date_trunc('hour', ts) AS ts, coalesce(sum(CASE WHEN aggressor = 'bid' THEN price * size END), 0) AS buy, coalesce(sum(CASE WHEN aggressor = 'ask' THEN price * size END), 0) AS sell, arg_max(price, ticks.ts) AS last, count(*) AS trades FROM ticks GROUP BY ticker, date_trunc('hour', ts)),
  flow AS (SELECT *, buy - sell AS flow, buy + sell AS traded, CASE WHEN lag(ts) OVER w + INTERVAL 1 HOUR = ts THEN ln(last / lag(last) OVER w) * 10000 END AS return_bps FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""


def _flow(spark, d):
    return L.flow(S.ticks(spark, d).drop("venue"), "1h")


@query(f"WITH {_FLOW} SELECT ticker, epoch_us(ts) AS ts, {r6('buy', 'sell', 'last')}, trades, {r6('flow', 'traded')}, round(flow / traded, 6) + 0.0 AS imbalance, {r6('return_bps')} FROM flow")
def order_flow(spark, d):
    return _flow(spark, d)


@query(f"WITH {_FLOW} SELECT ticker, round(regr_slope(return_bps, flow / 1000000), 2) + 0.0 AS slope, round(regr_r2(return_bps, flow / 1000000), 6) + 0.0 AS r2, count(return_bps) AS n FROM flow GROUP BY ticker", digits=6)
def kyle_lambda(spark, d):
    return L.kyle_lambda(_flow(spark, d)).select("ticker", F.round("slope", 2).alias("slope"), "r2", "n")


@query(f"WITH {_FLOW} SELECT ticker, round(avg(abs(return_bps) / (traded / 1000000)), 4) + 0.0 AS amihud, count(*) AS n FROM flow WHERE return_bps IS NOT NULL AND traded > 0 GROUP BY ticker", digits=4)
def amihud(spark, d):
    return L.amihud(_flow(spark, d))


@query(f"""WITH {_FLOW}, k AS (SELECT *, CAST(ts AS DATE) AS day FROM flow), t AS (SELECT ticker, day, list_sort(list(abs(flow))) AS v FROM k GROUP BY ALL)
  SELECT k.ticker, epoch_us(ts) AS ts, round(flow, 6) + 0.0 AS flow FROM k JOIN t ON k.ticker = t.ticker AND k.day = t.day WHERE abs(flow) >= v[CAST(ceil(0.9::DOUBLE * (len(v) - 1)) AS BIGINT) + 1]""")
def flow_shocks(spark, d):
    return L.shocks(_flow(spark, d), share=0.1).select("ticker", "ts", "flow")


@query(f"""WITH {S.QUOTES}, p AS (SELECT *, lag(bid_px) OVER w AS pb, lag(ask_px) OVER w AS pa, lag(bid_sz) OVER w AS pbs, lag(ask_sz) OVER w AS pas, lag(ts) OVER w AS pt FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  x AS (SELECT *, CASE WHEN bid_px < ask_px AND pb < pa AND epoch_us(ts) - epoch_us(pt) <= 3600000000 THEN CASE WHEN bid_px >= pb THEN bid_sz ELSE 0 END - CASE WHEN bid_px <= pb THEN pbs ELSE 0 END - (CASE WHEN ask_px <= pa THEN ask_sz ELSE 0 END - CASE WHEN ask_px >= pa THEN pas ELSE 0 END) END AS term FROM p)
  SELECT 'v' AS venue, ticker, epoch_us(date_trunc('hour', ts)) AS ts, round(sum(term), 6) + 0.0 AS ofi, count(term) AS n, round(avg((bid_sz + ask_sz) / 2), 6) + 0.0 AS depth FROM x GROUP BY ticker, date_trunc('hour', ts)""")
def order_flow_imbalance(spark, d):
    return L.ofi(S.quotes(spark, d), "1h", max_gap_us=3_600_000_000).select("venue", "ticker", "ts", "ofi", "n", "depth")


@query(f"""WITH {S.DAILY}{S.RETURNS}, x AS (SELECT ticker, date_trunc('month', ts) AS m, CASE WHEN nxt THEN ln(close) - ln(prev) END AS d, nxt, lag(date_trunc('month', ts)) OVER w AS pm, lag(CASE WHEN nxt THEN ln(close) - ln(prev) END) OVER w AS p FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  c AS (SELECT ticker, m, count(*) AS n, covar_samp(d, p) AS c FROM x WHERE d IS NOT NULL AND p IS NOT NULL AND nxt AND pm = m GROUP BY ALL) SELECT ticker, epoch_us(m) AS ts, n, CASE WHEN c < 0 THEN round(2 * sqrt(-c) * 10000, 3) + 0.0 END AS spread_bps FROM c""", digits=3)
def spread_roll(spark, d):
    return L.spreads(S.daily(spark, d), "roll", "1mo")


@query(f"""WITH {S.DAILY}, x AS (SELECT *, lag(close_ts) OVER w = ts AS ok, pow(ln(high / low), 2) + pow(ln(lag(high) OVER w / lag(low) OVER w), 2) AS beta, pow(ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)), 2) AS gamma FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  a AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) AS alpha FROM x WHERE ok) SELECT ticker, epoch_us(date_trunc('month', ts)) AS ts, count(*) AS n, round(avg(greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0)) * 10000, 4) + 0.0 AS spread_bps FROM a GROUP BY ticker, date_trunc('month', ts)""", digits=4)
def spread_corwin_schultz(spark, d):
    return L.spreads(S.daily(spark, d), "corwin_schultz", "1mo")


@query(f"""WITH {S.DAILY}, e AS (SELECT *, (ln(high) + ln(low)) / 2 AS eta, lag(close_ts) OVER w = ts AS ok FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)), x AS (SELECT *, 4 * (lag(ln(close)) OVER w - lag(eta) OVER w) * (lag(ln(close)) OVER w - eta) AS s FROM e WINDOW w AS (PARTITION BY ticker ORDER BY ts))
  SELECT ticker, epoch_us(date_trunc('month', ts)) AS ts, count(*) AS n, round(sqrt(greatest(avg(s), 0)) * 10000, 4) + 0.0 AS spread_bps FROM x WHERE ok AND s IS NOT NULL GROUP BY ticker, date_trunc('month', ts)""", digits=4)
def spread_abdi_ranaldo(spark, d):
    return L.spreads(S.daily(spark, d), "abdi_ranaldo", "1mo")


# indicators

_STRETCH = f"""{S.DAILY}{S.RETURNS}, st AS (SELECT *, sum(CASE WHEN nxt THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY ts) AS stretch FROM r)"""


@query(f"""WITH {_STRETCH} SELECT ticker, epoch_us(ts) AS ts, CASE WHEN count(close) OVER w = 10 THEN round(avg(close) OVER w, 6) + 0.0 END AS sma, CASE WHEN count(close) OVER w = 10 AND stddev_pop(close) OVER w > 0 THEN round((close - avg(close) OVER w) / stddev_pop(close) OVER w, 6) + 0.0 END AS z,
  CASE WHEN count(close) OVER w = 10 THEN round(avg(close) OVER w + 2 * stddev_pop(close) OVER w, 6) + 0.0 END AS upper FROM st WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def indicators_rolling(spark, d):
    return I.add(S.daily(spark, d), sma=I.sma(10), z=I.zscore(10), upper=I.bollinger(10, 2.0)).select("ticker", "ts", "sma", "z", "upper")


@query(f"""WITH RECURSIVE {_STRETCH}, q AS (SELECT ticker, stretch, ts, close, row_number() OVER (PARTITION BY ticker, stretch ORDER BY ts) AS i, avg(close) OVER (PARTITION BY ticker, stretch ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM st),
  e AS (SELECT ticker, stretch, ts, i, m AS y FROM q WHERE i = 10 UNION ALL SELECT q.ticker, q.stretch, q.ts, q.i, 2.0::DOUBLE / 11 * q.close + 9.0::DOUBLE / 11 * e.y FROM e JOIN q ON q.ticker = e.ticker AND q.stretch = e.stretch AND q.i = e.i + 1) SELECT ticker, epoch_us(ts) AS ts, round(y, 6) + 0.0 AS ema FROM e""")
def indicator_ema(spark, d):
    return I.add(S.daily(spark, d), ema=I.ema(10)).where("ema is not null").select("ticker", "ts", "ema")


def _smoothed(name: str, x: str, n: int, seed_at: int, alpha: str) -> str:
    """A seeded average's next value within the recursion below: q has the row, e the state before it."""
    return f"CASE WHEN q.i = {seed_at} THEN q.{name}_seed WHEN q.i > {seed_at} THEN {alpha} * q.{x} + (1 - {alpha}) * e.{name} END AS {name}"


#: Wilder's averages of 14 and 10 bars, exponential ones of 12 and 26, a signal of 9, Supertrend's bands and two channels, one row after another.
_RECURSIVE = f"""{_STRETCH}, p AS (SELECT ticker, stretch, ts, open, high, low, close, row_number() OVER w AS i, lag(close) OVER w AS before FROM st WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts)),
  d AS (SELECT *, greatest(close - before, 0.0::DOUBLE) AS up, greatest(before - close, 0.0::DOUBLE) AS dn, greatest(high - low, coalesce(abs(high - before), 0), coalesce(abs(low - before), 0)) AS tr, (high + low) / 2 AS mid FROM p),
  q AS (SELECT *, avg(close) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS fast_seed, avg(close) OVER (w ROWS BETWEEN 25 PRECEDING AND CURRENT ROW) AS slow_seed, avg(up) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS u_seed, avg(dn) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS v_seed,
    avg(tr) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS a_seed, avg(tr) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b_seed,
    max(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS hi20, min(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS lo20, max(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS hi50, min(close) OVER (w ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS lo50 FROM d WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts)),
  e AS (SELECT ticker, stretch, ts, i, close, NULL::DOUBLE AS fast, NULL::DOUBLE AS slow, NULL::DOUBLE AS u, NULL::DOUBLE AS v, NULL::DOUBLE AS a, NULL::DOUBLE AS b, 0.0::DOUBLE AS total, NULL::DOUBLE AS signal, NULL::DOUBLE AS top, NULL::DOUBLE AS bottom, NULL::DOUBLE AS trend, NULL::DOUBLE AS on20, NULL::DOUBLE AS stop20, NULL::DOUBLE AS on50, NULL::DOUBLE AS stop50 FROM q WHERE i = 1
    UNION ALL SELECT ticker, stretch, ts, i, close, fast, slow, u, v, a, b, total + coalesce(fast - slow, 0) AS total,
      CASE WHEN i = 34 THEN (total + fast - slow) / 9 WHEN i > 34 THEN 0.2::DOUBLE * (fast - slow) + 0.8::DOUBLE * signal END AS signal, new_top, new_bottom,
      CASE WHEN i = 10 THEN CASE WHEN close >= mid THEN 1 ELSE -1 END WHEN i > 10 THEN CASE WHEN trend < 0 AND close > new_top THEN 1 WHEN trend > 0 AND close < new_bottom THEN -1 ELSE trend END END AS trend,
      CASE WHEN i >= 20 THEN CASE WHEN coalesce(on20, 0) = 0 THEN CASE WHEN close >= hi20 THEN 1 ELSE 0 END WHEN close < greatest(stop20, (hi20 + lo20) / 2) THEN 0 ELSE 1 END END, CASE WHEN coalesce(on20, 0) = 0 THEN (hi20 + lo20) / 2 ELSE greatest(stop20, (hi20 + lo20) / 2) END,
      CASE WHEN i >= 50 THEN CASE WHEN coalesce(on50, 0) = 0 THEN CASE WHEN close >= hi50 THEN 1 ELSE 0 END WHEN close < greatest(stop50, (hi50 + lo50) / 2) THEN 0 ELSE 1 END END, CASE WHEN coalesce(on50, 0) = 0 THEN (hi50 + lo50) / 2 ELSE greatest(stop50, (hi50 + lo50) / 2) END
    FROM (SELECT *, CASE WHEN i = 10 THEN mid + 3 * b WHEN i > 10 THEN CASE WHEN was <= top THEN least(mid + 3 * b, top) ELSE mid + 3 * b END END AS new_top, CASE WHEN i = 10 THEN mid - 3 * b WHEN i > 10 THEN CASE WHEN was >= bottom THEN greatest(mid - 3 * b, bottom) ELSE mid - 3 * b END END AS new_bottom
      FROM (SELECT q.ticker, q.stretch, q.ts, q.i, q.close, q.mid, e.close AS was, q.hi20, q.lo20, q.hi50, q.lo50, {_smoothed('fast', 'close', 12, 12, '(2.0::DOUBLE / 13)')}, {_smoothed('slow', 'close', 26, 26, '(2.0::DOUBLE / 27)')}, {_smoothed('u', 'up', 14, 15, '(1.0::DOUBLE / 14)')}, {_smoothed('v', 'dn', 14, 15, '(1.0::DOUBLE / 14)')},
        {_smoothed('a', 'tr', 14, 14, '(1.0::DOUBLE / 14)')}, {_smoothed('b', 'tr', 10, 10, '(1.0::DOUBLE / 10)')}, e.total, e.signal, e.top, e.bottom, e.trend, e.on20, e.stop20, e.on50, e.stop50 FROM e JOIN q ON q.ticker = e.ticker AND q.stretch = e.stretch AND q.i = e.i + 1) x) y)"""


@query(f"""WITH RECURSIVE {_RECURSIVE} SELECT ticker, epoch_us(ts) AS ts, round(CASE WHEN v > 0 THEN 100 - 100 / (1 + u / v) WHEN u > 0 THEN 100 END, 6) + 0.0 AS rsi, round(fast - slow, 6) + 0.0 AS macd, round(signal, 6) + 0.0 AS signal, round(a, 6) + 0.0 AS atr, round(trend, 6) + 0.0 AS trend, round((on20 + on50) / 2, 6) + 0.0 AS dc FROM e""")
def indicators_recursive(spark, d):
    out = I.add(S.daily(spark, d), rsi=I.rsi(), macd=I.macd(), signal=I.macd_signal(), atr=I.atr(), trend=I.supertrend(), dc=I.donchian((20, 50)))
    return out.select("ticker", "ts", "rsi", "macd", "signal", "atr", "trend", "dc")


# backtests

_MA = f"""{S.DAILY}{S.RETURNS}, m AS (SELECT *, CASE WHEN count(close) OVER a = 5 THEN avg(close) OVER a END AS f, CASE WHEN count(close) OVER b = 20 THEN avg(close) OVER b END AS s FROM r WINDOW a AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  p AS (SELECT *, sign(f - s)::DOUBLE AS pos FROM m), h AS (SELECT *, lag(pos) OVER w AS held FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts)), t AS (SELECT *, abs(held - coalesce(lag(held) OVER w, 0)) AS turn FROM h WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  trial AS (SELECT 'ma_5_20_long_short' AS trial, ticker, ts, close_ts, held AS position, CASE WHEN nxt THEN held * sr END AS gross, CASE WHEN nxt THEN turn * 0.00045::DOUBLE END AS cost, CASE WHEN nxt THEN held * sr END - CASE WHEN nxt THEN turn * 0.00045::DOUBLE END AS net FROM t)"""


def _ma(spark, d):
    return T.moving_average(S.daily(spark, d), (5,), (20,), sides=("long_short",))


@query(f"WITH {_MA} SELECT trial, ticker, {US}, {r6('position', 'gross', 'cost', 'net')} FROM trial")
def backtest_moving_average(spark, d):
    return _ma(spark, d).select("trial", "ticker", "ts", "close_ts", "position", "gross", "cost", "net")


@query(f"""WITH {_MA} SELECT trial, ticker, count(net) AS periods, CASE WHEN count(net) >= 30 THEN round(avg(net) / stddev_samp(net), 6) + 0.0 END AS sharpe, round(log10(abs(product(1 + coalesce(net, 0)) - 1) + 1), 6) + 0.0 AS log_total FROM trial GROUP BY ALL""")
def backtest_summary(spark, d):
    return T.summary(_ma(spark, d)).select("trial", "ticker", "periods", "sharpe", F.log10(F.abs("total_net") + 1).alias("log_total"))


@query(f"""WITH {_MA}, s AS (SELECT *, sign(coalesce(position, 0)) AS side FROM trial), n AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY ticker ORDER BY ts) THEN 1 ELSE 0 END AS fresh FROM s), u AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM n)
  SELECT trial, ticker, CASE WHEN max(side) > 0 THEN 'long' ELSE 'short' END AS side, epoch_us(min(ts)) AS entry_ts, epoch_us(max(close_ts)) AS exit_ts, count(*) AS bars, round(product(1 + coalesce(net, 0)) - 1, 5) + 0.0 AS net FROM u WHERE side <> 0 GROUP BY trial, ticker, run""")
def backtest_trades(spark, d):
    return T.trades_table(_ma(spark, d)).select("trial", "ticker", "side", "entry_ts", "exit_ts", "bars", F.round("net", 5).alias("net"))


@query(f"""WITH {_MA}, v AS (SELECT *, CASE WHEN net > -1 THEN ln(1 + net) ELSE 0 END AS g, CASE WHEN net <= -1 THEN 1 ELSE 0 END AS ruin FROM trial WHERE net IS NOT NULL), c AS (SELECT *, CASE WHEN max(ruin) OVER (PARTITION BY ticker ORDER BY ts) = 1 THEN 0 ELSE exp(sum(g) OVER (PARTITION BY ticker ORDER BY ts)) END AS wealth FROM v), d AS (SELECT *, 1 - wealth / greatest(max(wealth) OVER (PARTITION BY ticker ORDER BY ts), 1) AS dd FROM c)
  SELECT trial, ticker, count(*) AS n, round(avg(net) / stddev_samp(net), 6) + 0.0 AS sharpe, round(avg(net) / sqrt(avg(pow(least(net, 0), 2))), 6) + 0.0 AS sortino, round(sum(greatest(net, 0)) / sum(greatest(-net, 0)), 6) + 0.0 AS omega, round(max(dd), 6) + 0.0 AS max_drawdown, round(sqrt(avg(dd * dd)), 6) + 0.0 AS ulcer FROM d GROUP BY trial, ticker""")
def backtest_describe(spark, d):
    return T.describe(_ma(spark, d), 365).select("trial", "ticker", "n", "sharpe", "sortino", "omega", "max_drawdown", "ulcer")


@query(f"""WITH {S.DAILY}{S.RETURNS}, p AS (SELECT *, sign(close / lag(close, 10) OVER w - 1)::DOUBLE AS pos FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)), h AS (SELECT *, lag(pos) OVER w AS held FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts)) SELECT 'mom_10' AS trial, ticker, epoch_us(ts) AS ts, round(CASE WHEN nxt THEN held * sr END, 6) + 0.0 AS gross FROM h""")
def backtest_momentum(spark, d):
    return T.momentum(S.daily(spark, d), (10,)).select("trial", "ticker", "ts", "gross")


@query()
def backtest_indicator_families(spark, d):
    b = S.daily(spark, d)
    return T.summary(T.indicator_signals(b)).drop("skew", "kurt")


@query(f"""WITH {_MA}, s AS (SELECT *, sign(coalesce(position, 0)) AS side FROM trial), n AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (PARTITION BY ticker ORDER BY ts) THEN 1 ELSE 0 END AS fresh FROM s), u AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM n),
  x AS (SELECT trial, ticker, min(ts) AS entry_ts, count(*) AS held, product(1 + coalesce(net, 0)) - 1 AS net FROM u WHERE side <> 0 GROUP BY trial, ticker, run), y AS (SELECT *, CASE WHEN net > 0 THEN 1 ELSE 0 END AS won FROM x), z AS (SELECT *, sum(won) OVER (PARTITION BY ticker ORDER BY entry_ts) AS streak FROM y), l AS (SELECT *, sum(1 - won) OVER (PARTITION BY ticker, streak) AS losing FROM z),
  a AS (SELECT trial, ticker, count(*) AS trades, avg(won) AS win_rate, avg(CASE WHEN net > 0 THEN net END) AS mean_win, avg(CASE WHEN net <= 0 THEN net END) AS mean_loss, sum(CASE WHEN net > 0 THEN net END) / nullif(-sum(CASE WHEN net <= 0 THEN net END), 0) AS profit_factor, CAST(max(losing) AS BIGINT) AS losing_streak, sum(held) AS held FROM l GROUP BY trial, ticker)
  SELECT trial, ticker, n.bars, trades, {r6('win_rate', 'mean_win', 'mean_loss', 'profit_factor')}, losing_streak, round(held / n.bars, 6) + 0.0 AS exposure FROM a JOIN (SELECT trial, ticker, count(*) AS bars FROM trial GROUP BY ALL) n USING (trial, ticker)""")
def backtest_trades_summary(spark, d):
    return T.trades_summary(_ma(spark, d))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of every ticker with log return and rolling volatility, one pass over the events."""
    b = S.hourly(spark, sf_dir)
    r = F.when(C.contiguous(), C.log_return())
    rows = b.withColumn("log_return", r).withColumn("n", F.count("log_return").over(C.trailing(6))).withColumn("sigma", F.when(F.col("n") >= 3, F.stddev_samp("log_return").over(C.trailing(6))))
    return plain(rows)
