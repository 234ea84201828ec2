"""Factor, carry, order-flow, jump and lead-lag queries over the driver's tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import bars as B
from brindle.operators import liquidity as L
from brindle.operators import order_flow as O
from brindle.operators import portfolios as P
from brindle.plans import stand_ins as S
from brindle.plans.queries import query, r6

#: Line items as daily closes of 20 made-up tickers, by part; volume is the quantity.
UNIVERSE = """u AS (SELECT 'p' || (l_partkey % 20) AS ticker, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, arg_max(l_extendedprice / l_quantity, l_orderkey * 16 + l_linenumber) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL),
 panel AS (SELECT ticker, ts, close, CASE WHEN lag(ts) OVER w + INTERVAL 1 DAY = ts THEN close / lag(close) OVER w - 1 END AS ret, close * volume AS dollar_volume, row_number() OVER w AS bars FROM u WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""
MEMBERS = UNIVERSE + """, dv AS (SELECT *, CASE WHEN count(dollar_volume) OVER w = 10 THEN avg(dollar_volume) OVER w END AS dv FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
 el AS (SELECT *, bars >= 20 AND dv IS NOT NULL AND ticker <> 'p7' AS eligible FROM dv), members AS (SELECT *, eligible AND row_number() OVER (PARTITION BY ts ORDER BY CASE WHEN eligible THEN dv END DESC NULLS LAST, ticker) <= 5 AS traded FROM el)"""


def _panel(spark, d):
    u = S.table(spark, d, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("ticker"), C.bucket(F.col("l_shipdate").cast("timestamp"), "1d").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("o"))
    daily = u.groupBy("ticker", "ts").agg(F.max_by("price", "o").alias("close"), F.sum("l_quantity").alias("volume")).withColumn("close_ts", C.plus(F.col("ts"), "1d"))
    return P.panel(daily)


def _members(spark, d):
    return P.members(_panel(spark, d), exclude=("p7",), top=5, history=20, window=10)


@query(f"WITH {UNIVERSE} SELECT ticker, epoch_us(ts) AS ts, round(close, 8) + 0.0 AS close, round(ret, 8) + 0.0 AS ret, round(dollar_volume, 8) + 0.0 AS dollar_volume, bars FROM panel", digits=8)
def factor_panel(spark, d):
    p = _panel(spark, d)
    return p.select("ticker", "ts", "close", "ret", "dollar_volume", F.col("bars").cast("long").alias("bars"))


@query(f"WITH {MEMBERS} SELECT ticker, epoch_us(ts) AS ts, eligible, traded FROM members")
def factor_members(spark, d):
    return _members(spark, d).select("ticker", "ts", "eligible", "traded")


@query(f"""WITH {UNIVERSE}, x AS (SELECT ticker, ts, CASE WHEN count(ret) OVER w = 7 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS mom_7, CASE WHEN count(ret) OVER m = 30 THEN -stddev_samp(ret) OVER m END AS lowvol FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), m AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT ticker, epoch_us(ts) AS ts, {r6('mom_7', 'lowvol')} FROM x""")
def factor_scores(spark, d):
    return P.scores(_panel(spark, d), _members(spark, d), market="p1").select("ticker", "ts", "mom_7", "lowvol")


_START, _END = datetime(1995, 1, 1), datetime(2002, 1, 1)
#: Every seventh day from the first with a full traded set, and the days that each rebalance is held.
_ON = """first AS (SELECT min(ts) AS f FROM (SELECT ts FROM members WHERE traded GROUP BY ts HAVING count(*) >= 5)), reb AS (SELECT unnest(generate_series(f, TIMESTAMP '2001-12-31', INTERVAL 7 DAY)) AS r FROM first)"""


def _on(m):
    return P.rebalances(m, _START, _END, top=5, every=7)


@query(f"""WITH {MEMBERS}, {_ON}, t AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY dv DESC, ticker) AS r, count(*) OVER (PARTITION BY ts) AS n FROM members WHERE traded AND ts IN (SELECT r FROM reb)), k AS (SELECT *, greatest(CAST(round_even(n * 0.4::DOUBLE, 0) AS BIGINT), 1) AS k FROM t)
  SELECT epoch_us(ts) AS rebalance, ticker, round(CASE WHEN r <= k THEN 0.5::DOUBLE / k ELSE -0.5::DOUBLE / k END, 6) + 0.0 AS w FROM k WHERE r <= k OR r > n - k""")
def factor_weights(spark, d):
    m = _members(spark, d)
    return P.weights(m, m.select("ticker", "ts", F.col("dv").alias("s")), "s", _on(m), "long_short", fifth=0.4)


@query(f"""WITH {MEMBERS}, {_ON}, w AS (SELECT ts AS rebalance, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY ts) AS w FROM members WHERE traded AND ts IN (SELECT r FROM reb)),
  days AS (SELECT r AS rebalance, unnest(generate_series(r + INTERVAL 1 DAY, r + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS ts FROM reb), d AS (SELECT * FROM days WHERE ts < TIMESTAMP '2002-01-01'),
  g AS (SELECT d.ts, sum(w.w * coalesce(p.ret, 0)) AS gross, sum(abs(w.w)) AS position FROM d JOIN w ON d.rebalance = w.rebalance LEFT JOIN panel p ON p.ticker = w.ticker AND p.ts = d.ts GROUP BY d.ts),
  turn AS (SELECT coalesce(a.rebalance, b.rebalance) + INTERVAL 1 DAY AS ts, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) AS turnover FROM w a FULL JOIN (SELECT rebalance + INTERVAL 7 DAY AS rebalance, ticker, w FROM w WHERE rebalance < (SELECT max(r) FROM reb)) b ON a.rebalance = b.rebalance AND a.ticker = b.ticker GROUP BY 1)
  SELECT epoch_us(d.ts) AS ts, round(coalesce(gross, 0), 6) + 0.0 AS gross, round(coalesce(position, 0), 6) + 0.0 AS position, round(coalesce(turnover, 0), 6) + 0.0 AS turnover, round(coalesce(gross, 0) - coalesce(turnover, 0) * 0.0005::DOUBLE, 6) + 0.0 AS net FROM d LEFT JOIN g ON d.ts = g.ts LEFT JOIN turn ON d.ts = turn.ts""")
def factor_portfolio(spark, d):
    m = _members(spark, d)
    on = _on(m)
    return P.portfolio(spark, _panel(spark, d), P.weights(m, None, None, on, "long_only"), on, _END, "ew").select("ts", "gross", "position", "turnover", "net")


@query()
def factor_rules(spark, d):
    return P.rules(spark, _panel(spark, d), datetime(1995, 1, 1, tzinfo=timezone.utc), datetime(2002, 1, 1, tzinfo=timezone.utc), market="p1", top=5).groupBy("trial").agg(F.sum("net").alias("net"), F.count(F.lit(1)).alias("days"))


_CARRY = S.TICKS + """, prem AS (SELECT ticker, date_trunc('hour', ts) AS ts, arg_max(price / 10000, ticks.ts) AS close FROM ticks GROUP BY ticker, date_trunc('hour', ts)), p AS (SELECT ticker, date_trunc('day', ts) AS day, arg_max(close, prem.ts) AS premium, count(DISTINCT ts) AS n FROM prem GROUP BY ticker, date_trunc('day', ts) HAVING count(DISTINCT ts) >= 20),
  s AS (SELECT k.ticker, unnest(generate_series(TIMESTAMP '2024-01-01 08:00:00', TIMESTAMP '2024-01-30 00:00:00', INTERVAL 8 HOUR)) AS ts FROM (SELECT DISTINCT ticker FROM ticks) k), f AS (SELECT ticker, date_trunc('day', ts - INTERVAL 1 MICROSECOND) AS day, sum((day(ts) + hour(ts)) / 10000.0::DOUBLE) AS funding FROM s GROUP BY ALL HAVING count(*) = 3)"""


def _carry(spark, d):
    t = S.ticks(spark, d)
    hour = C.bucket(F.col("ts"), "1h")
    prem = t.groupBy("ticker", hour.alias("h")).agg(F.max_by(F.col("price") / 10000, "ts").alias("close")).withColumnRenamed("h", "ts")
    whole = prem.groupBy("ticker", C.bucket(F.col("ts"), "1d").alias("day")).agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    prem = prem.join(whole.select("ticker", "day"), (prem["ticker"] == whole["ticker"]) & (C.bucket(prem["ts"], "1d") == whole["day"]), "left_semi")
    hours = t.select("ticker").distinct().withColumn("ts", F.expr("explode(sequence(timestamp'2024-01-01 08:00:00', timestamp'2024-01-30 00:00:00', interval 8 hours))"))
    settled = hours.select("ticker", "ts", ((F.dayofmonth("ts") + F.hour("ts")) / 10000).alias("rate"), F.lit(8).alias("interval_hours"))
    # the premium here is hourly with holes allowed: a day counts with 20 of its hours
    p = prem.groupBy("ticker", C.bucket(F.col("ts"), "1d").alias("day")).agg(F.max_by("close", "ts").alias("close")).select("ticker", F.col("day").alias("ts"), "close")
    return P.carry_days(p, settled, minutes=1)


@query(f"WITH {_CARRY} SELECT p.ticker, epoch_us(p.day) AS ts, {r6('premium', 'funding')} FROM p JOIN f ON p.ticker = f.ticker AND p.day = f.day")
def carry_days(spark, d):
    return _carry(spark, d).drop("close_ts")


@query(f"""WITH {_CARRY}, c AS (SELECT p.ticker, p.day AS ts, premium, funding FROM p JOIN f ON p.ticker = f.ticker AND p.day = f.day), x AS (SELECT *, lag(ts) OVER w + INTERVAL 1 DAY = ts AS nxt, (premium - lag(premium) OVER w) / (1 + lag(premium) OVER w) AS basis, lag(-1.0::DOUBLE) OVER w AS held FROM c WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  y AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY ticker ORDER BY ts), 0)) AS turn FROM x) SELECT 'always' AS trial, ticker, epoch_us(ts) AS ts, round(CASE WHEN nxt THEN held * basis - turn * 0.0015::DOUBLE - held * funding END, 6) + 0.0 AS net FROM y""")
def carry_always(spark, d):
    return P.carry_rules(_carry(spark, d)).where("trial = 'always'").select("trial", "ticker", "ts", "net")


def _carry_rule(n: int, hurdle: float, side: str) -> str:
    beyond = f"abs(f{n}) > {hurdle}::DOUBLE" if side == "both" else f"f{n} > {hurdle}::DOUBLE"
    return f"SELECT 'carry {n} {hurdle:g} {side}' AS trial, ticker, ts, nxt, premium, funding, CASE WHEN f{n} IS NOT NULL THEN CASE WHEN {beyond} THEN -sign(f{n}) ELSE 0 END END AS p FROM m"


@query(f"""WITH {_CARRY}, c AS (SELECT p.ticker, p.day AS ts, premium, funding, coalesce(lag(p.day) OVER (PARTITION BY p.ticker ORDER BY p.day) + INTERVAL 1 DAY = p.day, false) AS nxt FROM p JOIN f ON p.ticker = f.ticker AND p.day = f.day), st AS (SELECT *, sum(CASE WHEN nxt THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY ts) AS stretch FROM c),
  m AS (SELECT *, {', '.join(f"CASE WHEN count(funding) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(funding) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS f{n}" for n in (1, 7, 30))} FROM st WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts)),
  a AS (SELECT 'always' AS trial, ticker, ts, nxt, premium, funding, -1.0::DOUBLE AS p FROM m UNION ALL {' UNION ALL '.join(_carry_rule(n, h, s) for s in ('both', 'short_only') for n in (1, 7, 30) for h in (0.0, 0.0003))}),
  h AS (SELECT *, lag(p) OVER w AS held, (premium - lag(premium) OVER w) / (1 + lag(premium) OVER w) AS basis FROM a WINDOW w AS (PARTITION BY trial, ticker ORDER BY ts)), t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY trial, ticker ORDER BY ts), 0)) AS turn FROM h),
  n AS (SELECT trial, CASE WHEN nxt THEN held * basis - turn * 0.0015::DOUBLE - held * funding END AS net FROM t) SELECT trial, round(sum(net), 6) + 0.0 AS net, count(net) AS days FROM n GROUP BY trial""")
def carry_rules(spark, d):
    return P.carry_rules(_carry(spark, d)).groupBy("trial").agg(F.sum("net").alias("net"), F.count("net").alias("days"))


_GRID = S.QUOTES + """, g AS (SELECT ticker, date_trunc('minute', ts) AS ts, arg_max(bid_px, quotes.ts) AS bid_px, arg_max(ask_px, quotes.ts) AS ask_px, arg_max(bid_sz, quotes.ts) AS bid_sz, arg_max(ask_sz, quotes.ts) AS ask_sz FROM quotes GROUP BY ticker, date_trunc('minute', ts)),
  grid AS (SELECT *, (bid_px + ask_px) / 2 AS mid, (bid_px * ask_sz + ask_px * bid_sz) / (bid_sz + ask_sz) AS wmid, CAST(ts AS DATE) AS day FROM g WHERE ask_px > bid_px)"""


def _grid(spark, d):
    q = S.quotes(spark, d)
    g = q.groupBy("ticker", C.bucket(F.col("ts"), "1m").alias("m")).agg(*[F.max_by(c, "ts").alias(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz")])
    return O.seconds(g.withColumnRenamed("m", "ts"))


@query(f"WITH {_GRID} SELECT ticker, epoch_us(ts) AS ts, round(mid, 8) + 0.0 AS mid, round(wmid, 8) + 0.0 AS wmid FROM grid", digits=8)
def touch_grid(spark, d):
    return _grid(spark, d).select("ticker", "ts", "mid", "wmid")


@query(f"""WITH {_GRID}, s AS (SELECT ticker, ts, CASE WHEN minute(ts) % 2 = 0 THEN 1 ELSE -1 END AS side FROM grid) SELECT s.ticker, epoch_us(s.ts) AS ts, s.side::DOUBLE AS side, round(10000 * s.side * (CASE WHEN s.side > 0 THEN b.bid_px / a.ask_px ELSE b.ask_px / a.bid_px END - 1), 4) + 0.0 AS gross_bps
  FROM s JOIN grid a ON a.ticker = s.ticker AND a.ts = s.ts JOIN grid b ON b.ticker = s.ticker AND b.ts = s.ts + INTERVAL 10 MINUTE AND b.day = a.day""", digits=4)
def taker_trades(spark, d):
    g = _grid(spark, d)
    s = g.select("ticker", "ts", F.when(F.minute("ts") % 2 == 0, 1).otherwise(-1).alias("side"))
    return O.taker(g, s, 600).select("ticker", "ts", "side", "gross_bps")


@query(f"""WITH {_GRID} SELECT a.ticker, epoch_us(a.ts) AS ts, round(pow(10000 * (b.mid - a.mid) / a.mid, 2) / 1000000, 6) + 0.0 AS e_mid, round(pow(10000 * (b.mid - a.wmid) / a.mid, 2) / 1000000, 6) + 0.0 AS e_wmid FROM grid a JOIN grid b ON a.ticker = b.ticker AND b.ts = a.ts + INTERVAL 5 MINUTE AND a.day = b.day""")
def microprice_errors(spark, d):
    m = O.microprice_frame(_grid(spark, d), 300)
    return m.select("ticker", "ts", (F.col("e_mid") / 1e6).alias("e_mid"), (F.col("e_wmid") / 1e6).alias("e_wmid"))


def _even(spark, d):
    g = _grid(spark, d)
    s = g.select("ticker", "ts", F.when(F.minute("ts") % 2 == 0, 1).otherwise(-1).alias("side"), F.lit("even").alias("rule"))
    return O.score(O.taker(g, s, 600), min_trades=5)


@query(f"""WITH {_GRID}, s AS (SELECT ticker, ts, CASE WHEN minute(ts) % 2 = 0 THEN 1 ELSE -1 END AS side FROM grid), t AS (SELECT s.ticker, a.day, 10000 * s.side * (CASE WHEN s.side > 0 THEN b.bid_px / a.ask_px ELSE b.ask_px / a.bid_px END - 1) - 20000 * 0.00055::DOUBLE AS net
  FROM s JOIN grid a ON a.ticker = s.ticker AND a.ts = s.ts JOIN grid b ON b.ticker = s.ticker AND b.ts = s.ts + INTERVAL 10 MINUTE AND b.day = a.day), d AS (SELECT ticker, day, avg(net) AS m, count(*) AS n, sum(net) AS s FROM t GROUP BY ALL)
  SELECT 'even' AS rule, ticker, CAST(sum(n) AS BIGINT) AS trades, count(*) AS days, CASE WHEN sum(n) >= 5 THEN round(sum(s) / sum(n), 4) + 0.0 END AS mean_bps, CASE WHEN sum(n) >= 5 AND count(*) >= 2 THEN round(avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0), 4) + 0.0 END AS t FROM d GROUP BY ticker""", digits=4)
def taker_scores(spark, d):
    return _even(spark, d)


@query()
def taker_p_values(spark, d):
    return O.p_values(_even(spark, d))


_LM = f"""{S.DAILY}{S.RETURNS}, b AS (SELECT *, abs(lr) * abs(lag(lr) OVER w) AS bp FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)), c AS (SELECT *, CASE WHEN count(bp) OVER p = 14 THEN sqrt(sum(bp) OVER p / 14) END AS sigma FROM b WINDOW p AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_LM} SELECT ticker, epoch_us(ts) AS ts, round(sigma, 6) + 0.0 AS sigma_local, round(lr / nullif(sigma, 0), 6) + 0.0 AS l, coalesce(abs(lr / nullif(sigma, 0)) > (sqrt(2 * ln(4.0)) / sqrt(2 / pi()) - (ln(pi()) + ln(ln(4.0))) / (2 * sqrt(2 / pi()) * sqrt(2 * ln(4.0))) - ln(-ln(1 - 0.01::DOUBLE)) / (sqrt(2 / pi()) * sqrt(2 * ln(4.0)))), false) AS jump FROM c")
def jumps_lee_mykland(spark, d):
    return O.lee_mykland(B.returns(S.daily(spark, d), "log"), per_day=4, window=16).select("ticker", "ts", "sigma_local", F.col("L").alias("l"), "jump")


_ERFC = lambda x: (lambda t: f"({t}) * exp({' + '.join(f'{c}::DOUBLE * pow({t}, {k})' for k, c in enumerate(C.ERFC))} - {x} * {x})")(f"(1 / (1 + {x} / 2))")


@query(f"""WITH {_LM}, p AS (SELECT ticker, ts, lr / nullif(sigma, 0) AS l, abs(lr / nullif(sigma, 0)) / sqrt(2) AS z FROM c), v AS (SELECT *, {_ERFC('z')} AS p FROM p), k AS (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM v WHERE p IS NOT NULL), top AS (SELECT max(p) AS t FROM k WHERE p * n <= r * 0.5::DOUBLE)
  SELECT ticker, epoch_us(ts) AS ts, round(p, 6) + 0.0 AS p_value, coalesce(p <= t, false) AS jump FROM v, top""")
def jumps_false_discovery(spark, d):
    return O.lee_mykland(B.returns(S.daily(spark, d), "log"), per_day=4, window=16, rule="bh", q=0.5).select("ticker", "ts", "p_value", "jump")


@query()
def jump_periodicity(spark, d):
    return O.periodicity(B.returns(S.hourly(spark, d), "log"), slot_minutes=60, per_day=12, by="time_of_day")


_LAGS = (-60000, -1000, 0, 1000, 60000)


@query(f"""WITH {S.TICKS}, px AS (SELECT ticker, date_trunc('day', ts) AS day, epoch_us(ts) AS t, max(ln(price)) AS p FROM ticks GROUP BY ALL), n AS (SELECT ticker, day, count(*) AS n, min(t) AS lo, max(t) AS hi FROM px GROUP BY ALL),
  ch AS (SELECT *, lag(t) OVER w AS t0, p - lag(p) OVER w AS dp FROM px WINDOW w AS (PARTITION BY ticker, day ORDER BY t)), sq AS (SELECT ticker, day, sum(dp * dp) AS s FROM ch GROUP BY ALL),
  lags AS (SELECT unnest([{', '.join(map(str, _LAGS))}]) AS lag_ms), e AS (SELECT x.ticker, x.day, lag_ms, y.t0 - lag_ms * 1000 AS a, y.t - lag_ms * 1000 AS b, y.dp, x.lo, x.hi FROM n x JOIN ch y ON y.ticker = 'view' AND y.day = x.day AND y.dp IS NOT NULL, lags WHERE x.ticker <> 'view' AND x.n >= 2 AND y.t0 - lag_ms * 1000 < x.hi AND y.t - lag_ms * 1000 > x.lo),
  lo AS (SELECT e.*, greatest(e.a, e.lo) AS a1, least(e.b, e.hi) AS b1 FROM e), j1 AS (SELECT lo.*, px.p AS p0 FROM lo ASOF JOIN px ON px.ticker = lo.ticker AND px.day = lo.day AND lo.a1 >= px.t), j2 AS (SELECT j1.*, px.p AS p1 FROM j1 ASOF JOIN px ON px.ticker = j1.ticker AND px.day = j1.day AND j1.b1 <= px.t),
  c AS (SELECT ticker, day, lag_ms, sum((p1 - p0) * dp) AS c FROM j2 GROUP BY ALL), every AS (SELECT x.ticker, x.day, l.lag_ms, x.n AS x_ticks, y.n AS y_ticks, sqrt(sx.s * sy.s) AS scale FROM n x JOIN n y ON y.ticker = 'view' AND y.day = x.day JOIN sq sx ON sx.ticker = x.ticker AND sx.day = x.day JOIN sq sy ON sy.ticker = 'view' AND sy.day = x.day, lags l WHERE x.ticker <> 'view' AND x.n >= 2 AND y.n >= 2),
  r AS (SELECT v.*, coalesce(c.c, 0) / scale AS rho FROM every v LEFT JOIN c ON c.ticker = v.ticker AND c.day = v.day AND c.lag_ms = v.lag_ms WHERE scale > 0),
  best AS (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY round(abs(rho), 12) DESC, abs(lag_ms), lag_ms) AS k FROM r)
  SELECT ticker, epoch_us(day) AS ts, max(CASE WHEN k = 1 THEN lag_ms::DOUBLE END) AS lead_ms, {', '.join(f"round({x}, 6) + 0.0 AS {n}" for n, x in (('rho_lead', 'max(CASE WHEN k = 1 THEN rho END)'), ('rho_0', 'max(CASE WHEN lag_ms = 0 THEN rho END)'), ('llr', 'sum(CASE WHEN lag_ms > 0 THEN rho * rho END) / nullif(sum(CASE WHEN lag_ms < 0 THEN rho * rho END), 0)')))}, max(x_ticks) AS x_ticks, max(y_ticks) AS y_ticks FROM best GROUP BY ticker, day""")
def lead_lag_by_day(spark, d):
    t = S.ticks(spark, d)
    out = None
    for name in ("click", "error", "purchase", "signup"):
        one = O.lead_lag(t.where(F.col("ticker") == name), t.where("ticker = 'view'"), lags_ms=_LAGS, every="1d").withColumn("ticker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def _running(key: str, name: str) -> str:
    return f"""{name}s AS (SELECT ticker, week, {key}, sum(abs(lr)) AS a, count(*) AS n FROM x GROUP BY ALL), {name}g AS (SELECT w.ticker, w.week, k.{key}, sum(coalesce(s.a, 0)) OVER o / nullif(sum(coalesce(s.n, 0)) OVER o, 0) AS s FROM weeks w JOIN (SELECT DISTINCT ticker, {key} FROM x) k ON k.ticker = w.ticker LEFT JOIN {name}s s ON s.ticker = w.ticker AND s.week = w.week AND s.{key} = k.{key} WINDOW o AS (PARTITION BY w.ticker, k.{key} ORDER BY w.week)),
  {name} AS (SELECT ticker, week, {key}, CASE WHEN count(s) OVER (PARTITION BY ticker, week) = count(*) OVER (PARTITION BY ticker, week) THEN s / avg(s) OVER (PARTITION BY ticker, week) END AS f FROM {name}g)"""


@query(f"""WITH {S.HOURLY}{S.RETURNS}, x AS (SELECT ticker, isodow(ts) AS weekday, hour(ts) AS hour, lr, date_trunc('week', close_ts - INTERVAL 1 MICROSECOND) + INTERVAL 7 DAY AS week FROM r WHERE lr IS NOT NULL), weeks AS (SELECT DISTINCT ticker, date_trunc('week', ts) AS week FROM r), {_running('hour', 'hh')}, {_running('weekday', 'dd')},
  cells AS (SELECT DISTINCT ticker, weekday, hour FROM x), t AS (SELECT w.ticker, w.week, c.weekday, c.hour, hh.f * dd.f AS f FROM weeks w JOIN cells c ON c.ticker = w.ticker LEFT JOIN hh ON hh.ticker = w.ticker AND hh.week = w.week AND hh.hour = c.hour LEFT JOIN dd ON dd.ticker = w.ticker AND dd.week = w.week AND dd.weekday = c.weekday)
  SELECT ticker, epoch_us(week) AS week, CAST(weekday AS INTEGER) AS weekday, CAST(hour AS INTEGER) AS hour, round(CASE WHEN count(f) OVER p = count(*) OVER p THEN f / nullif(sqrt(avg(f * f) OVER p), 0) END, 6) + 0.0 AS factor FROM t WINDOW p AS (PARTITION BY ticker, week)""")
def weekly_factors(spark, d):
    return O.weekly_factors(B.returns(S.hourly(spark, d), "log"))


@query(f"""WITH {S.QUOTES}, book AS (SELECT ticker, date_trunc('second', ts) AS ts, arg_max(bid_sz + ask_sz, quotes.ts) AS depth, arg_max((ask_px - bid_px) / ((ask_px + bid_px) / 2) * 10000, quotes.ts) AS spread_bps FROM quotes GROUP BY ticker, date_trunc('second', ts)),
  ev AS (SELECT ticker, ts + INTERVAL 1 SECOND AS ts FROM (SELECT *, lag(depth) OVER (PARTITION BY ticker ORDER BY ts) AS was FROM book) WHERE depth < was / 2), k AS (SELECT ticker, ts AS e, unnest(generate_series(-1, 600)) AS k FROM ev), j AS (SELECT k.ticker, e, k.k, depth, spread_bps FROM k LEFT JOIN book b ON b.ticker = k.ticker AND b.ts = e + to_seconds(k.k)), p AS (SELECT *, max(CASE WHEN k = -1 THEN depth END) OVER (PARTITION BY ticker, e) AS pre FROM j)
  SELECT ticker, epoch_us(e) AS event_ts, round(max(pre), 6) + 0.0 AS pre_depth, round(min(CASE WHEN k >= 0 THEN depth / pre END), 6) + 0.0 AS min_ratio, min(CASE WHEN k >= 0 AND depth / pre >= 1 THEN k END) AS recovered_s FROM p GROUP BY ticker, e""")
def book_resilience(spark, d):
    q = L.quoted(S.quotes(spark, d))
    book = q.groupBy("ticker", C.bucket(F.col("ts"), "1s").alias("s")).agg(F.max_by(F.col("bid_sz") + F.col("ask_sz"), "ts").alias("depth"), F.max_by("spread_bps", "ts").alias("spread_bps")).withColumnRenamed("s", "ts")
    # a shock is a book that holds less than half of what the one before it held
    events = book.withColumn("_was", F.lag("depth").over(C.by_ticker())).where("depth < _was / 2").select("ticker", C.plus(F.col("ts"), "1s").alias("ts"))
    out = L.resilience(book, events, horizon=600)
    return out.select("ticker", "event_ts", "pre_depth", "min_ratio", F.col("recovered_s").cast("long").alias("recovered_s"))


@query("""WITH p AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, abs(c_acctbal) + 1 AS q FROM customer), d AS (SELECT k, i * 2.0::DOUBLE AS x, sum(q) OVER (PARTITION BY k ORDER BY i) AS c FROM p), s AS (SELECT *, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(c) OVER w, 0) AS c0 FROM d WINDOW w AS (PARTITION BY k ORDER BY x)),
  z AS (SELECT s.*, size FROM s, (VALUES (1000.0::DOUBLE), (100000.0::DOUBLE)) v(size)), y AS (SELECT *, greatest(least(size, c) - c0, 0) AS part, x0 + greatest(least(size, c) - c0, 0) / (c - c0) * (x - x0) AS far FROM z) SELECT k, size, round(sum(part * (x0 + far) / 2) / sum(part), 6) + 0.0 AS cost_bps, size > max(c) AS beyond FROM y GROUP BY k, size""")
def cost_of_order_size(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("i")
    p = S.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("i"), (F.abs("c_acctbal") + 1).alias("q"))
    depth = p.select("k", (F.col("i") * 2.0).alias("distance_bps"), F.sum("q").over(w).alias("cumulative"))
    return L.cost_of_size(depth, (1000.0, 100000.0))


# fitted models


@query()
def garch_fit(spark, d):
    from brindle.operators import fitted as M

    return M.fit(B.returns(S.daily(spark, d), "log")).select("ticker", "model", "nobs", F.round("persistence", 2).alias("persistence"))


@query()
def garch_walk_forward(spark, d):
    from brindle.operators import fitted as M

    return M.walk_forward(B.returns(S.daily(spark, d), "log"), first=300, horizons=(1, 5)).groupBy("ticker", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("variance").alias("variance"))


@query()
def har_scorecard(spark, d):
    from brindle.operators import fitted as M

    rv = B.returns(S.daily(spark, d), "log").where("return is not null").select("ticker", "ts", "close_ts", (F.col("return") * F.col("return")).alias("rv"))
    return M.scorecard(M.align(M.har(rv, every=100), rv.withColumnRenamed("rv", "proxy")))


@query()
def variance_breaks(spark, d):
    from brindle.operators import fitted as M

    return M.variance_breaks(B.returns(S.daily(spark, d), "log"))


@query(f"""WITH RECURSIVE {S.DAILY}{S.RETURNS}, j AS (SELECT ts, max(CASE WHEN ticker = 'A' THEN lr END) AS a, max(CASE WHEN ticker = 'N' THEN lr END) AS n, max(CASE WHEN ticker = 'R' THEN lr END) AS r FROM r GROUP BY ts), w AS (SELECT *, row_number() OVER (ORDER BY ts) AS i FROM j WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL),
  e AS (SELECT i, ts, a * a AS aa, a * n AS an, a * r AS ar, n * n AS nn, n * r AS nr, r * r AS rr FROM w WHERE i = 1 UNION ALL SELECT w.i, w.ts, {', '.join(f'0.94::DOUBLE * e.{x}{y} + 0.06::DOUBLE * w.{x} * w.{y}' for x, y in ('aa', 'an', 'ar', 'nn', 'nr', 'rr'))} FROM e JOIN w ON w.i = e.i + 1),
  l AS ({' UNION ALL '.join(f"SELECT '{x.upper()}' AS ticker_i, '{y.upper()}' AS ticker_j, ts, i, {x}{y} AS cov, {x}{y} / sqrt({x}{x} * {y}{y}) AS rho FROM e" for x, y in ('aa', 'an', 'ar', 'nn', 'nr', 'rr'))}) SELECT ticker_i, ticker_j, epoch_us(ts) AS ts, round(cov, 6) + 0.0 AS cov, round(rho, 6) + 0.0 AS rho FROM l WHERE i > 33""")
def ewma_correlations(spark, d):
    from brindle.operators import fitted as M

    return M.ewma_pairs(B.returns(S.daily(spark, d), "log"), ["A", "N", "R"])


@query()
def direction_reliability(spark, d):
    from brindle.operators import fitted as M

    b = S.daily(spark, d).withColumns({"r1": F.ln(F.try_divide(F.col("close"), F.lag("close").over(C.by_ticker()))), "r5": F.ln(F.try_divide(F.col("close"), F.lag("close", 5).over(C.by_ticker())))})
    return M.reliability(M.direction(b, ["r1", "r5"], horizon=3, first=500, every=250))


# selection and calendars

_TRIALS = f"""{S.DAILY}{S.RETURNS}, p AS (SELECT *, sign(close / lag(close, 10) OVER w - 1)::DOUBLE AS pos FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)), h AS (SELECT *, lag(pos) OVER w AS held FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""


@query()
def random_timing(spark, d):
    from brindle.operators import backtest as T
    from brindle.operators import selection

    return selection.random_timing(T.momentum(S.daily(spark, d), (10, 20)))


@query(f"""WITH {S.DAILY}, n AS (SELECT count(DISTINCT ticker) AS n FROM bars), f AS (SELECT ts FROM bars GROUP BY ts HAVING count(DISTINCT ticker) = (SELECT n FROM n)) SELECT ticker, epoch_us(bars.ts) AS ts, round(close, 8) + 0.0 AS close FROM bars SEMI JOIN f ON bars.ts = f.ts""", digits=8)
def shared_times(spark, d):
    from brindle.operators import selection

    return selection.shared_times(S.daily(spark, d)).select("ticker", "ts", "close")


_SESSIONS = """s AS (SELECT CAST(x AS DATE) AS date, x + INTERVAL 14 HOUR + INTERVAL 30 MINUTE AS open_ts, x + INTERVAL 21 HOUR AS close_ts FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) g(x) WHERE isodow(x) < 6 AND day(x) NOT IN (1, 15, 24))"""


def _sessions(spark):
    days = spark.sql("select explode(sequence(timestamp'2024-01-01', timestamp'2024-01-31', interval 1 day)) as x").where("weekday(x) < 5 and dayofmonth(x) not in (1, 15, 24)")
    return days.select(F.to_date("x").alias("date"), (F.col("x") + F.expr("INTERVAL 870 MINUTES")).alias("open_ts"), (F.col("x") + F.expr("INTERVAL 21 HOURS")).alias("close_ts"))


@query(f"WITH {_SESSIONS}, {S.TICKS} SELECT event_id, coalesce(t.ts >= s.open_ts AND t.ts < s.close_ts, false) AS x_open, s.date IS NULL AND isodow(CAST(timezone('America/New_York', timezone('UTC', t.ts)) AS DATE)) < 6 AND CAST(timezone('America/New_York', timezone('UTC', t.ts)) AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-31' AS x_closed_day FROM ticks t LEFT JOIN s ON s.date = CAST(timezone('America/New_York', timezone('UTC', t.ts)) AS DATE)")
def sessions_marked(spark, d):
    from brindle.operators import calendars

    return calendars.mark_sessions(S.ticks(spark, d), _sessions(spark), "America/New_York", "x").select("event_id", "x_open", "x_closed_day")


@query(f"WITH {_SESSIONS}, l AS (SELECT *, lag(close_ts) OVER (ORDER BY open_ts) AS f FROM s) SELECT epoch_us(open_ts) AS open_ts, epoch_us(f) AS closed_from, round(date_diff('minute', f, open_ts) / 60.0::DOUBLE, 6) + 0.0 AS closed_hours, CASE WHEN isodow(f) + date_diff('day', CAST(f AS DATE), CAST(open_ts AS DATE)) >= 6 THEN CASE WHEN date_diff('minute', f, open_ts) <= 3600 THEN 'weekend' ELSE 'weekend+holiday' END ELSE 'holiday' END AS kind FROM l WHERE date_diff('minute', f, open_ts) > 1440")
def session_reopenings(spark, d):
    from brindle.operators import calendars

    return calendars.reopenings(_sessions(spark))


@query()
def component_garch_fit(spark, d):
    from brindle.operators import fitted as M

    return M.fit_variance(B.returns(S.daily(spark, d), "log"), model="cgarch").where("name = 'rho'").select("ticker", "name", F.round("value", 1).alias("value"))


@query(f"""WITH {S.HOURLY}{S.RETURNS}, x AS (SELECT ticker, date_trunc('day', close_ts - INTERVAL 1 MICROSECOND) AS bucket, close_ts, lr, abs(lr) AS a, lag(abs(lr)) OVER w AS b, lag(abs(lr), 2) OVER w AS c FROM r WHERE lr IS NOT NULL WINDOW w AS (PARTITION BY ticker, date_trunc('day', close_ts - INTERVAL 1 MICROSECOND) ORDER BY close_ts)),
  s AS (SELECT ticker, bucket, count(*) AS n, sum(lr * lr) AS rv, pi() / 2 * count(*) / (count(*) - 1) * sum(a * b) AS bv, sum(CASE WHEN c IS NOT NULL THEN pow(a + b + c - greatest(a, b, c) - least(a, b, c), 2) END) * pi() / (6 - 4 * sqrt(3) + pi()) * count(*) / (count(*) - 2) AS med_rv,
    count(*) * pow(pow(2, 2.0::DOUBLE / 3) * gamma(7.0::DOUBLE / 6) / gamma(0.5::DOUBLE), -3) * count(*) / (count(*) - 2) * sum(CASE WHEN c IS NOT NULL THEN pow(a * b * c, 4.0::DOUBLE / 3) END) AS tq FROM x GROUP BY ticker, bucket HAVING count(*) >= 10),
  z AS (SELECT *, (1 - bv / rv) / sqrt((pi() * pi() / 4 + pi() - 5) * greatest(1.0::DOUBLE, tq / (bv * bv)) / n) AS z FROM s) SELECT ticker, epoch_us(bucket) AS ts, n, {r6('rv', 'bv', 'med_rv', 'tq', 'z')}, round(CASE WHEN z > 3.090::DOUBLE THEN greatest(rv - bv, 0) ELSE 0 END, 6) + 0.0 AS jump FROM z""")
def realized_jumps(spark, d):
    from brindle.operators import fitted as M

    return M.realized_jumps(B.returns(S.hourly(spark, d), "log"))


@query()
def momentum_features(spark, d):
    from brindle.operators import fitted as M

    rets = B.returns(S.hourly(spark, d), "log")
    rows = S.hourly(spark, d).select("ticker", "ts", "close_ts", "close").join(rets.select("ticker", "ts", (F.col("return") * F.col("return")).alias("rv")), ["ticker", "ts"])
    return M.momentum_features(rows, O.weekly_factors(rets), {"1h": 1, "4h": 4}, half_life=3)


@query()
def volatility_targeted(spark, d):
    from brindle.operators import backtest as T
    from brindle.operators import fitted as M

    b = S.daily(spark, d)
    out = M.targeted(M.walk_forward(B.returns(b, "log"), first=300), b, target=0.1)
    return out.groupBy("trial", "ticker").agg(F.count("net").alias("n"), F.avg("position").alias("exposure"), F.max(F.abs("position")).alias("most"))


@query(f"WITH {S.DAILY}, x AS (SELECT ticker, ts, CASE WHEN lead(ts, 3) OVER w = ts + INTERVAL 3 DAY THEN ln(lead(close, 3) OVER w / close) END AS r FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY ts)) SELECT ticker, epoch_us(ts) AS ts, round(r, 6) + 0.0 AS r_ahead, CAST(r > 0 AS INTEGER) AS y, CASE WHEN r > 0.1 THEN 1 WHEN r < -0.1 THEN -1 WHEN r IS NOT NULL THEN 0 END AS cls FROM x")
def direction_targets(spark, d):
    from brindle.operators import studies

    return studies.targets(S.daily(spark, d), 3, "1d", cost=0.1).select("ticker", "ts", "r_ahead", "y", "cls")


@query(f"WITH {S.DAILY}{S.RETURNS} SELECT ticker, epoch_us(ts) AS ts, round(lr * lr, 6) + 0.0 AS proxy FROM r WHERE lr IS NOT NULL")
def variance_proxies(spark, d):
    from brindle.operators import studies

    return studies.proxies(S.daily(spark, d))


@query()
def spread_edge(spark, d):
    from brindle.operators import studies

    return studies.spread_edge(S.daily(spark, d), "1mo")


@query(f"""WITH RECURSIVE {S.DAILY}, k AS (SELECT ticker, ts, ln(high / low) AS score, row_number() OVER (PARTITION BY ticker ORDER BY ln(high / low) DESC, ts DESC) AS i FROM bars),
  e AS (SELECT ticker, i, [ts] AS taken, true AS took, ts, score FROM k WHERE i = 1 UNION ALL SELECT ticker, i, CASE WHEN free THEN list_append(taken, ts) ELSE taken END, free, ts, score FROM (SELECT k.ticker, k.i, e.taken, k.ts, k.score, len(list_filter(e.taken, lambda t: abs(epoch_us(k.ts) - epoch_us(t)) < 259200000000)) = 0 AS free FROM e JOIN k ON k.ticker = e.ticker AND k.i = e.i + 1 WHERE len(e.taken) < 5) x)
  SELECT ticker, epoch_us(ts) AS ts, round(score, 6) + 0.0 AS score FROM e WHERE took""")
def extreme_days(spark, d):
    from brindle.operators import studies

    return studies.extremes(S.daily(spark, d), 5).select("ticker", "ts", "score")


@query(f"""WITH {S.DAILY}{S.RETURNS}, p AS (SELECT *, sign(close / lag(close, 20) OVER w - 1)::DOUBLE AS pos, lag(close) OVER w AS was FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)), h AS (SELECT *, sign(coalesce(lag(pos) OVER w, 0)) AS side FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts)), f AS (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER w THEN 1 ELSE 0 END AS fresh FROM h WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  u AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS run FROM f), x AS (SELECT ticker, min(ts) AS entry_ts, max(side) AS side, max(high) AS hi, min(low) AS lo, arg_min(was, ts) AS base FROM u WHERE side <> 0 GROUP BY ticker, run)
  SELECT 'mom_20' AS trial, ticker, epoch_us(entry_ts) AS entry_ts, round(CASE WHEN side > 0 THEN lo / base - 1 ELSE -(hi / base - 1) END, 6) + 0.0 AS mae, round(CASE WHEN side > 0 THEN hi / base - 1 ELSE -(lo / base - 1) END, 6) + 0.0 AS mfe FROM x""")
def trade_excursions(spark, d):
    from brindle.operators import backtest as T
    from brindle.operators import studies

    b = S.daily(spark, d)
    return studies.excursions(T.trades_table(T.momentum(b, (20,))), b).select("trial", "ticker", "entry_ts", "mae", "mfe")
