"""Queries of trials, statistics, second-by-second studies and fitted families over the driver's tables."""

from __future__ import annotations

from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions import evaluation as E
from brindle.functions import models as M
from brindle.functions import stats
from brindle.operators import backtest as T
from brindle.operators import bars as B
from brindle.operators import fitted
from brindle.operators import indicators as I
from brindle.operators import liquidity as L
from brindle.operators import order_flow as O
from brindle.operators import portfolios as P
from brindle.operators import selection, studies, walks
from brindle.plans import more_queries as Q
from brindle.plans import queries as base
from brindle.plans import stand_ins as S
from brindle.plans.queries import query, r6


@query(f"WITH {base._MA} SELECT trial, ticker, epoch_us(ts) AS ts, CASE WHEN count(net) OVER w = 30 THEN round(avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0), 6) + 0.0 END AS rolling_sharpe FROM trial WINDOW w AS (PARTITION BY ticker ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def rolling_sharpe(spark, d):
    return T.rolling_sharpe(base._ma(spark, d), 30)


_MOM = f"""{S.DAILY}{S.RETURNS}, p AS (SELECT *, sign(close / lag(close, 10) OVER w - 1)::DOUBLE AS p10, sign(close / lag(close, 20) OVER w - 1)::DOUBLE AS p20 FROM r WINDOW w AS (PARTITION BY ticker ORDER BY ts)), h AS (SELECT *, lag(p10) OVER w AS h10, lag(p20) OVER w AS h20 FROM p WINDOW w AS (PARTITION BY ticker ORDER BY ts)),
  n AS (SELECT ticker, ts, CASE WHEN nxt THEN h10 * sr - abs(h10 - coalesce(lag(h10) OVER w, 0)) * 0.00045::DOUBLE END AS n10, CASE WHEN nxt THEN h20 * sr - abs(h20 - coalesce(lag(h20) OVER w, 0)) * 0.00045::DOUBLE END AS n20 FROM h WINDOW w AS (PARTITION BY ticker ORDER BY ts))"""


@query(f"WITH {_MOM} SELECT epoch_us(ts) AS ts, round(max(CASE WHEN ticker = 'A' THEN n10 END), 6) + 0.0 AS a10, round(max(CASE WHEN ticker = 'R' THEN n20 END), 6) + 0.0 AS r20 FROM n GROUP BY ts HAVING a10 IS NOT NULL AND r20 IS NOT NULL")
def trial_matrix(spark, d):
    return T.matrix(T.momentum(S.daily(spark, d), (10, 20)), ["mom_10|A", "mom_20|R"]).withColumnsRenamed({"mom_10|A": "a10", "mom_20|R": "r20"})


@query(f"WITH {_MOM} SELECT 'mom_20' AS trial, ticker, epoch_us(ts) AS ts, round(n20 - n10, 6) + 0.0 AS excess FROM n")
def excess_returns(spark, d):
    return selection.excess(T.momentum(S.daily(spark, d), (10, 20)), "mom_10")


@query(f"""WITH {base._STRETCH}, k AS (SELECT *, row_number() OVER w AS i, min(low) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS lo, max(high) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS hi FROM st WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts)), p AS (SELECT *, CASE WHEN i >= 14 AND hi > lo THEN 100 * (close - lo) / (hi - lo) END AS k FROM k)
  SELECT ticker, epoch_us(ts) AS ts, round((k + lag(k) OVER w + lag(k, 2) OVER w) / 3, 6) + 0.0 AS slow_d FROM p WINDOW w AS (PARTITION BY ticker, stretch ORDER BY ts)""")
def indicator_stochastic(spark, d):
    return I.add(S.daily(spark, d), slow_d=I.stochastic()).select("ticker", "ts", "slow_d")


def _ewma(name: str, lam: float) -> str:
    return f"{name} AS (SELECT ticker, ts, i, lr * lr AS s FROM q WHERE i = 1 UNION ALL SELECT q.ticker, q.ts, q.i, {lam}::DOUBLE * {name}.s + {1 - lam:.2f}::DOUBLE * q.lr * q.lr FROM {name} JOIN q ON q.ticker = {name}.ticker AND q.i = {name}.i + 1)"


@query(f"WITH RECURSIVE {S.DAILY}{S.RETURNS}, q AS (SELECT ticker, ts, lr, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS i FROM r WHERE lr IS NOT NULL), {_ewma('f', 0.94)}, {_ewma('g', 0.97)} SELECT f.ticker, epoch_us(f.ts) AS ts, round(sqrt(greatest(f.s, g.s)), 6) + 0.0 AS sigma FROM f JOIN g ON f.ticker = g.ticker AND f.ts = g.ts WHERE f.i > 152")
def ewma_volatility_max(spark, d):
    # bars after a hole repeat the last value; the oracle lists returns only
    rets = B.returns(S.daily(spark, d), "log").where("return is not null").select("ticker", "ts")
    return B.ewma_max(S.daily(spark, d)).where("sigma is not null").join(rets, ["ticker", "ts"], "left_semi").select("ticker", "ts", "sigma")


@query(f"WITH {Q._CARRY}, c AS (SELECT p.ticker, p.day AS ts, funding FROM p JOIN f ON p.ticker = f.ticker AND p.day = f.day), x AS (SELECT *, CASE WHEN lag(ts) OVER w + INTERVAL 1 DAY = ts THEN lag(funding) OVER w END AS was FROM c WINDOW w AS (PARTITION BY ticker ORDER BY ts)) SELECT ticker, count(*) AS n, round(corr(funding, was), 6) + 0.0 AS rho FROM x WHERE was IS NOT NULL GROUP BY ticker")
def funding_persistence(spark, d):
    return P.persistence(Q._carry(spark, d))


_WIDE = f"{S.HOURLY}, v AS (SELECT ts, max(CASE WHEN ticker = 'click' THEN volume END)::DOUBLE AS a, max(CASE WHEN ticker = 'view' THEN volume END)::DOUBLE AS b FROM bars GROUP BY ts), l AS (SELECT ts, ln(a) AS a, ln(b) AS b FROM v)"


def _wide(spark, d):
    return S.hourly(spark, d).groupBy("ts").agg(F.max(F.when(F.col("ticker") == "click", F.col("volume"))).cast("double").alias("a"), F.max(F.when(F.col("ticker") == "view", F.col("volume"))).cast("double").alias("b"))


@query(f"WITH {_WIDE}, s AS (SELECT regr_slope(a, b) AS slope, regr_r2(a, b) AS r2, regr_count(a, b) AS n, sqrt((regr_syy(a, b) - regr_slope(a, b) * regr_sxy(a, b)) / ((regr_count(a, b) - 2) * regr_sxx(a, b))) AS se FROM l) SELECT {r6('slope', 'se')}, round(slope / se, 6) + 0.0 AS t, round(r2, 6) + 0.0 AS r2, CAST(n AS BIGINT) AS n FROM s")
def volume_elasticity(spark, d):
    return studies.log_elasticity(_wide(spark, d), "a", "b", seasonal=False)


@query(f"WITH {_WIDE} SELECT CAST(k AS INTEGER) AS lag, round(corr(x.a, y.b), 6) + 0.0 AS corr FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS k) JOIN l x ON true JOIN l y ON y.ts = x.ts + to_hours(k) GROUP BY k")
def volume_lagged_correlation(spark, d):
    return studies.lagged_correlation(_wide(spark, d), "a", "b", [-2, -1, 0, 1, 2], seasonal=False)


_FORECASTS = "f AS (SELECT event_type AS ticker, ts, (event_id % 97 + 1) / 99.0::DOUBLE AS p, (user_id % 89 + 1) / 91.0::DOUBLE AS b, CAST(value > 50 AS INTEGER) AS y FROM events)"


def _forecasts(spark, d):
    t = S.table(spark, d, "events")
    own = t.select("event_type", F.col("ts").cast("timestamp").alias("ts"), ((F.col("event_id") % 97 + 1) / 99).alias("p"), ((F.col("user_id") % 89 + 1) / 91).alias("b"), (F.col("value") > 50).cast("int").alias("y"), F.monotonically_increasing_id().alias("row"))
    both = F.explode(F.array(F.struct(F.lit("B").alias("set"), F.col("p")), F.struct(F.lit("A").alias("set"), F.col("b").alias("p")))).alias("_s")
    return own.select(F.col("event_type").alias("ticker"), "ts", F.col("ts").alias("close_ts"), F.lit(1).alias("h"), "y", "row", both).select("ticker", "ts", "close_ts", "h", "y", "row", "_s.*")


@query(f"WITH {_FORECASTS} SELECT ticker, epoch_us(ts) AS ts, round(-CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END, 6) + 0.0 AS loss_model, round(-CASE WHEN y = 1 THEN ln(b) ELSE ln(1 - b) END, 6) + 0.0 AS loss_benchmark, round(pow(p - y, 2), 6) + 0.0 AS brier_model, round(pow(b - y, 2), 6) + 0.0 AS brier_benchmark FROM f")
def paired_losses(spark, d):
    # events of one type may share an instant, so forecasts are paired by the event
    return walks.paired(_forecasts(spark, d), "B", "A", row="row").drop("close_ts", "h")


@query(f"WITH {_FORECASTS} SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) + 0.0 AS mean_p, round(avg(y), 6) + 0.0 AS rate FROM f GROUP BY 1")
def reliability_bins(spark, d):
    return fitted.reliability(_forecasts(spark, d).where("set = 'B'"))


@query(f"""WITH {_FORECASTS}, s AS (SELECT count(*) AS n, avg(CAST((p > 0.5) = (y = 1) AS INTEGER)) AS hit, avg(y) AS a, avg(CAST(p > 0.5 AS INTEGER)) AS b, 1 - avg(pow(p - y, 2)) / avg(pow(b - y, 2)) AS skill FROM f), c AS (SELECT *, a * b + (1 - a) * (1 - b) AS chance FROM s)
  SELECT n, {r6('hit')}, round(chance, 6) + 0.0 AS expected, round((hit - chance) / sqrt(chance * (1 - chance) / n - (pow(2 * a - 1, 2) * b * (1 - b) + pow(2 * b - 1, 2) * a * (1 - a)) / n - 4 * a * b * (1 - a) * (1 - b) / (n * n)), 6) + 0.0 AS statistic, round(skill, 6) + 0.0 AS skill FROM c""")
def direction_tests(spark, d):
    f = _forecasts(spark, d)
    calls = f.where("set = 'B'").select((F.col("p") > 0.5).cast("int").alias("call"), "y")
    pt = studies.pesaran_timmermann(calls, "call", "y")
    skill = studies.brier_skill(f.withColumnRenamed("set", "model"), "B", "A")
    return spark.createDataFrame([(pt["n"], pt["hit_rate"], pt["expected"], pt["statistic"], skill)], "n long, hit double, expected double, statistic double, skill double")


@query(f"""WITH {S.DAILY}{S.RETURNS}, y AS (SELECT ticker, ts, close_ts, lr, CASE WHEN year(ts) <> lag(year(ts)) OVER (PARTITION BY ticker ORDER BY ts) THEN 1 ELSE 0 END AS fresh FROM r WHERE lr IS NOT NULL), s AS (SELECT *, sum(fresh) OVER (PARTITION BY ticker ORDER BY ts) AS segment FROM y)
  SELECT ticker, CAST(segment AS BIGINT) AS segment, epoch_us(min(ts)) AS "from", epoch_us(max(close_ts)) AS "to", count(*) AS n, round(var_samp(lr), 6) + 0.0 AS variance FROM s GROUP BY ticker, segment""")
def yearly_segments(spark, d):
    rets = B.returns(S.daily(spark, d), "log").where("return is not null")
    breaks = rets.withColumn("_y", F.lag(F.year("ts")).over(C.by_ticker())).where(F.year("ts") != F.col("_y")).select("ticker", "ts")
    return walks.segments(rets, breaks)


@query(f"""WITH {_MOM}, x AS (SELECT a.ticker, a.ts, a.n10 AS net, a.n20 AS b FROM n a WHERE a.n10 IS NOT NULL AND a.n20 IS NOT NULL), m AS (SELECT ticker, avg(b) AS r1, avg(b * b) AS r2, avg(net) AS b1, avg(net * net) AS b2 FROM x GROUP BY ticker),
  q AS (SELECT *, g / (2 * (1 + g)) AS c FROM m, (SELECT unnest([1.0::DOUBLE, 10.0::DOUBLE]) AS g)), z AS (SELECT *, 2 * c * r1 - 1 AS q1, r1 - c * r2 - b1 + c * b2 AS k FROM q)
  SELECT 'mom_20' AS trial, ticker, round(max(CASE WHEN g = 1 THEN -2 * k / (q1 - sqrt(q1 * q1 + 4 * c * k)) * 3650000 END), 3) + 0.0 AS fee_bp_g1, round(max(CASE WHEN g = 10 THEN -2 * k / (q1 - sqrt(q1 * q1 + 4 * c * k)) * 3650000 END), 3) + 0.0 AS fee_bp_g10 FROM z GROUP BY ticker""", digits=3)
def trial_economics(spark, d):
    return walks.economics(T.momentum(S.daily(spark, d), (10, 20)), benchmark="mom_10", ppy=365).where("trial = 'mom_20'").select("trial", "ticker", "fee_bp_g1", "fee_bp_g10")


@query(f"""WITH {S.QUOTES}, b AS (SELECT venue, ticker, ts, (bid_px + ask_px) / 2 AS mid, (ask_px - bid_px) / (bid_px + ask_px) * 100 AS half, bid_sz, ask_sz FROM quotes), p AS (SELECT venue, ticker, ts, unnest([half, 0.02, 0.1, -half, -0.02, -0.1]::DOUBLE[]) AS band_pct, unnest([ask_sz, ask_sz * 2, CASE WHEN ask_sz > 2 THEN ask_sz * 10 END, bid_sz, bid_sz * 2, CASE WHEN bid_sz > 2 THEN bid_sz * 10 END]::DOUBLE[]) * mid AS notional FROM b)
  SELECT venue, ticker, epoch_us(ts) AS ts, round(band_pct, 6) + 0.0 AS band_pct, round(notional, 4) + 0.0 AS notional FROM p WHERE notional IS NOT NULL""")
def book_depth_points(spark, d):
    q = S.quotes(spark, d)
    deep = {f"{s}_depth_{w}bps": F.when((F.col(f"{s}_sz") > 2) | F.lit(w == 2), F.col(f"{s}_sz") * w) for s in ("bid", "ask") for w in (2, 10)}
    return walks.book_points(q.withColumns(deep)).withColumn("notional", F.round("notional", 4))


@query(f"""WITH {S.QUOTES}, q AS (SELECT *, lag(bid_px) OVER w AS b0, lag(ask_px) OVER w AS a0, lag(bid_sz) OVER w AS bs0, lag(ask_sz) OVER w AS as0, lag(ts) OVER w AS t0 FROM quotes WINDOW w AS (PARTITION BY ticker ORDER BY ts)), t AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(t0) <= 5000000 THEN (CASE WHEN bid_px >= b0 THEN bid_sz ELSE 0 END - CASE WHEN bid_px <= b0 THEN bs0 ELSE 0 END) - (CASE WHEN ask_px <= a0 THEN ask_sz ELSE 0 END - CASE WHEN ask_px >= a0 THEN as0 ELSE 0 END) END AS term FROM q),
  g AS (SELECT ticker, time_bucket(INTERVAL 10 SECOND, ts) AS ts, sum(term) AS ofi, avg((bid_sz + ask_sz) / 2) AS depth, arg_max((bid_px + ask_px) / 2, ts) AS mid FROM t GROUP BY ticker, time_bucket(INTERVAL 10 SECOND, ts)), r AS (SELECT *, CASE WHEN lag(ts) OVER w = ts - INTERVAL 10 SECOND THEN ln(mid / lag(mid) OVER w) * 10000 END AS ret FROM g WINDOW w AS (PARTITION BY ticker ORDER BY ts))
  SELECT ticker, epoch_us(ts) AS ts, round(CASE WHEN depth > 0 THEN ofi / depth END, 6) + 0.0 AS x, round(CASE WHEN lead(ts) OVER w = ts + INTERVAL 10 SECOND THEN lead(ret) OVER w END, 6) + 0.0 AS y FROM r WINDOW w AS (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts)""")
def imbalance_frame(spark, d):
    return O.ofi_frame(S.quotes(spark, d)).select("ticker", "ts", "x", "y")


@query(f"""WITH {S.HOURLY}, d AS (SELECT ticker, ts, abs(open * volume) AS notional, volume * 100::DOUBLE AS depth FROM bars) SELECT ticker, round(sum(60 * (notional / 60) * (notional / 60) / depth * 0.005::DOUBLE), 4) + 0.0 AS cost, CAST(sum(CASE WHEN notional / 60 > depth THEN 1 ELSE 0 END) AS BIGINT) AS over_depth, round(sum(notional), 4) + 0.0 AS notional FROM d GROUP BY ticker""", digits=4)
def hourly_schedule_cost(spark, d):
    b = S.hourly(spark, d)
    return L.schedule_cost(b.select("ticker", "ts", (F.col("open") * F.col("volume")).alias("notional")), b.select("ticker", "ts", (F.col("volume") * 100.0).alias("depth")))


# statistics on what an aggregate leaves: small tables of names and values, worked out once per ticker


def _named(spark: SparkSession, rows: dict[str, float | None]) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in rows.items()], "name string, value double")


def _daily_returns(spark, d) -> np.ndarray:
    """The returns of one ticker: a few thousand numbers, whatever the table's size, as there is one a day."""
    return B.returns(S.daily(spark, d), "log").where("ticker = 'A' and return is not null").orderBy("ts").select("return").toPandas()["return"].to_numpy(float)


def _lag_sum(k: int) -> str:
    return f"sum(x * x{k})"


@query(f"""WITH {S.DAILY}{S.RETURNS}, a AS (SELECT ts, lr FROM r WHERE ticker = 'A' AND lr IS NOT NULL), s AS (SELECT count(*) AS n, avg(lr) AS m, stddev_samp(lr) AS sd, stddev_pop(lr) AS sp FROM a), c AS (SELECT ts, lr - m AS x, n, m, sd, sp FROM a, s), l AS (SELECT *, {', '.join(f'lag(x, {k}) OVER (ORDER BY ts) AS x{k}' for k in range(1, 6))} FROM c),
  t AS (SELECT any_value(n) AS n, any_value(m) AS m, any_value(sd) AS sd, avg(pow(x / sp, 3)) AS skew, avg(pow(x / sp, 4)) AS kurt, sum(x * x) AS v, {', '.join(f'{_lag_sum(k)} AS c{k}' for k in range(1, 6))} FROM l),
  o AS (SELECT [{', '.join(f"{{'name': '{n}', 'value': ({e})::DOUBLE}}" for n, e in (('sharpe', 'm / sd'), ('sharpe_annual', 'm / sd * sqrt(365)'), ('skewness', 'skew'), ('kurtosis', 'kurt'), ('sharpe_error', 'sqrt((1 - skew * m / sd + (kurt - 1) / 4 * pow(m / sd, 2)) / (n - 1))'), ('ljung_box_5', 'n * (n + 2) * (' + ' + '.join(f'pow(c{k} / v, 2) / (n - {k})' for k in range(1, 6)) + ')'), ('newey_west_5', '(v + 2 * (' + ' + '.join(f'(1 - {k} / 6.0::DOUBLE) * c{k}' for k in range(1, 6)) + ')) / n'), ('kish_halving', 'pow(1 - pow(0.5::DOUBLE, n), 2) / pow(0.5::DOUBLE, 2) / ((1 - pow(0.25::DOUBLE, n)) / 0.75::DOUBLE)'), ('gumbel_24', 'sqrt(2 * ln(24.0::DOUBLE)) / sqrt(2 / pi()) - (ln(pi()) + ln(ln(24.0::DOUBLE))) / (2 * sqrt(2 / pi()) * sqrt(2 * ln(24.0::DOUBLE))) - ln(-ln(1 - 0.01::DOUBLE)) / (sqrt(2 / pi()) * sqrt(2 * ln(24.0::DOUBLE)))')))}] AS a FROM t)
  SELECT u.name, round(u.value, 6) + 0.0 AS value FROM (SELECT unnest(a) AS u FROM o)""")
def return_statistics(spark, d):
    r = _daily_returns(spark, d)
    sr = stats.sharpe(r)
    skew, kurt = stats.moments(r)
    return _named(spark, {"sharpe": sr, "sharpe_annual": stats.annualize(sr, 365), "skewness": skew, "kurtosis": kurt, "sharpe_error": stats.sharpe_error(sr, len(r), skew, kurt), "ljung_box_5": M.ljung_box(r, 5), "newey_west_5": stats.newey_west(r, 5), "kish_halving": stats.ewma_n_eff(0.5, len(r)), "gumbel_24": stats.gumbel_threshold(24, 0.01)})


@query(f"""WITH {S.DAILY}{S.RETURNS}, a AS (SELECT ts, lr, row_number() OVER (ORDER BY ts) AS i FROM r WHERE ticker = 'A' AND lr IS NOT NULL), h AS (SELECT i, CAST(lr < -1.5 AS INTEGER) AS hit FROM a), s AS (SELECT count(*) AS n, sum(hit) AS k, sum(hit) / count(*)::DOUBLE AS p FROM h), t AS (SELECT sum(CASE WHEN was = 0 AND hit = 0 THEN 1 ELSE 0 END) AS n00, sum(CASE WHEN was = 0 AND hit = 1 THEN 1 ELSE 0 END) AS n01, sum(CASE WHEN was = 1 AND hit = 0 THEN 1 ELSE 0 END) AS n10, sum(CASE WHEN was = 1 AND hit = 1 THEN 1 ELSE 0 END) AS n11 FROM (SELECT hit, lag(hit) OVER (ORDER BY i) AS was FROM h) WHERE was IS NOT NULL),
  u AS (SELECT *, 2 * ((n - k) * ln((1 - p) / 0.8::DOUBLE) + k * ln(p / 0.2::DOUBLE)) AS uc FROM s), v AS (SELECT 2 * ({' + '.join(f'CASE WHEN {c} > 0 THEN {c} * ln({c} / ({row})::DOUBLE) ELSE 0 END' for c, row in (('n00', 'n00 + n01'), ('n01', 'n00 + n01'), ('n10', 'n10 + n11'), ('n11', 'n10 + n11')))} - (n00 + n10) * ln((n00 + n10) / (n00 + n01 + n10 + n11)::DOUBLE) - (n01 + n11) * ln((n01 + n11) / (n00 + n01 + n10 + n11)::DOUBLE)) AS ind FROM t),
  f AS (SELECT avg(-CAST(lr <= -1.5 AS INTEGER) * (-1.5 - lr) / (0.2::DOUBLE * -2.5) + 0.6::DOUBLE + ln(2.5::DOUBLE) - 1) AS fz0 FROM a) SELECT u.k::DOUBLE AS hits, 0.2::DOUBLE * n + 0.0 AS expected, {r6('uc', 'ind')}, round(uc + ind, 6) + 0.0 AS cc, round(fz0, 6) + 0.0 AS fz0 FROM u, v, f""")
def risk_backtest(spark, d):
    r = _daily_returns(spark, d)
    out = E.var_backtest(r, np.full(len(r), -1.5), np.full(len(r), -2.5), 0.2)
    return spark.createDataFrame([tuple(float(out[k]) for k in ("hits", "expected", "kupiec", "independence", "conditional_coverage", "fz0"))], "hits double, expected double, uc double, ind double, cc double, fz0 double")


@query()
def selection_scores(spark, d):
    """The deflated best of the momentum trials, overfitting by cross-validation, and the reality check against the first trial."""
    trials = T.momentum(S.daily(spark, d), (5, 10, 20, 40, 80))
    columns = [f"mom_{n}|{t}" for n in (5, 10, 20, 40, 80) for t in ("A", "N", "R")]
    best = selection.deflate(trials)
    over = selection.pbo(trials, columns)
    m = T.matrix(trials, columns).orderBy("ts").toPandas()[columns].to_numpy(float)
    check = stats.reality_check(m, reps=500)
    return _named(spark, {"dsr": best["dsr"], "pbo": over["pbo"], "splits": over["splits"], "white": check["white"], "spa": check["spa"], "block": stats.mean_block(m)})


# fitted families: no SQL says them


@query()
def variance_family(spark, d):
    rets = B.returns(S.daily(spark, d), "log")
    out = None
    for model in ("ewma", "rm2006", "garch", "gjr", "egarch", "aparch", "figarch", "cgarch", "betat", "msgarch"):
        one = fitted.walk_forward(rets, model=model, first=1000, every=500)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("model", "ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("variance"), 1).alias("variance"))


@query()
def variance_diagnostics(spark, d):
    return walks.diagnose(B.returns(S.daily(spark, d), "log")).select("ticker", "model", "n", F.round("lb", 1).alias("lb"), F.round("lm", 1).alias("lm"))


@query()
def correlation_comparison(spark, d):
    rets, names = B.returns(S.daily(spark, d), "log"), ["A", "N", "R"]
    made = {k: walks.correlation_walk(rets, names, model="garch", kind=k, first=1500, every=400) for k in ("dcc", "constant", "ewma", "sample")}
    return walks.correlation_scores(made, rets).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 1).alias(c) for c in ("stein", "frobenius", "gmv")])


@query()
def level_shift_walk(spark, d):
    return walks.level_walk(B.returns(S.daily(spark, d), "log"), first=1500, every=500).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("variance"), 1).alias("variance"))


@query()
def har_family(spark, d):
    r = F.col("return")
    m = B.returns(S.daily(spark, d), "log").where("return is not null").select("ticker", "ts", "close_ts", (r * r).alias("rv"), F.when(r > 0, r * r).otherwise(0.0).alias("rs_plus"), F.when(r < 0, r * r).otherwise(0.0).alias("rs_minus"), F.pow(r, 4).alias("rq"), (r * r * 0.9).alias("bv"))
    out = None
    for model in ("har", "shar", "harq", "harj"):
        one = walks.har_walk(m, model=model, first=500, every=100)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("model", "ticker").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("variance"), 2).alias("variance"), F.sum(F.col("filtered").cast("long")).alias("filtered"))


@query()
def three_way_direction(spark, d):
    b = studies.targets(S.daily(spark, d), 1, "1d", cost=0.3).withColumns({"r1": F.ln(F.try_divide(F.col("close"), F.lag("close").over(C.by_ticker()))), "r5": F.ln(F.try_divide(F.col("close"), F.lag("close", 5).over(C.by_ticker())))})
    return walks.three_ways(b, ["r1", "r5"], horizon=1, first=500, every=250).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 3).alias(c) for c in ("p_down", "p_flat", "p_up")])


@query()
def intraday_volume(spark, d):
    v = S.hourly(spark, d).groupBy("ts").agg(F.sum("volume").cast("double").alias("value"))
    out = None
    for model in walks.INTRADAY:
        one = walks.intraday(v, model=model, first=360, every=120)
        out = one if out is None else out.unionByName(one)
    return walks.intraday_scores(out, benchmark="persistence")


@query()
def portfolio_weights(spark, d):
    rets = B.returns(S.daily(spark, d), "simple").withColumnRenamed("return", "ret")
    return walks.rebalance_weights(rets, ["A", "N", "R"], start=datetime(1996, 1, 1), every=28, window=60).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 3).alias("most"))


@query()
def shock_placebo(spark, d):
    f = L.flow(S.ticks(spark, d), "1h")
    return walks.placebo(f, L.shocks(f, 0.1)).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ts").alias("distinct"))
