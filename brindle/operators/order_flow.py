"""Second-by-second studies: the touch, microprice, lead of another venue, taker rules and their scores; jumps and lead-lag."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions import stats
from brindle.operators import liquidity as L
from brindle.operators.asof import asof
from brindle.refuse import Refused, one_of, require

TAKER = 0.00055
LAGS_MS = (-1000, -500, -200, -100, 0, 100, 200, 500, 1000)
#: Consistency of the shortest half and of the weighted deviation, and the 99 % point of chi-square with one degree.
SHORTH, WEIGHTED, CHI2_99 = 0.741, 1.081, 6.635


def seconds(book: DataFrame, leader: DataFrame | None = None, *, stale: str = "5s") -> DataFrame:
    """The touch per second with mid and size-weighted mid, crossed books dropped, and the leader's last price not older than ``stale``."""
    require(book, ["ticker", "ts", "bid_px", "ask_px", "bid_sz", "ask_sz"])
    b, a, bs, as_ = (F.col(c) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz"))
    grid = book.where(a > b).select("ticker", "ts", "bid_px", "ask_px", "bid_sz", "ask_sz", C.bucket(F.col("ts"), "1d").alias("day"), ((b + a) / 2).alias("mid"), F.try_divide(b * as_ + a * bs, bs + as_).alias("wmid"))
    if leader is None:
        return grid
    order = "event_id" if "event_id" in leader.columns else "price"
    last = leader.groupBy("ticker", F.col("ts").alias("_trade_ts")).agg(F.max_by("price", order).cast("double").alias("leader_px"))
    return asof(grid, last, "ts", "_trade_ts", ["ticker"], tolerance=stale).drop("_trade_ts")


def taker(grid: DataFrame, signals: DataFrame, horizon: int, *, fee: float = TAKER) -> DataFrame:
    """Signals traded at the touch, in and ``horizon`` seconds later out, within a day: two equality joins."""
    if horizon < 1:
        raise Refused(f"horizon={horizon} must be a second or more")
    keep = [c for c in signals.columns if c not in ("ticker", "ts", "side")]
    touch = grid.select("ticker", "ts", "day", "bid_px", "ask_px")
    out = grid.select("ticker", F.timestamp_micros(F.unix_micros("ts") - horizon * 1_000_000).alias("ts"), F.col("day").alias("_day"), F.col("bid_px").alias("_bid"), F.col("ask_px").alias("_ask"))
    rows = signals.where("side <> 0").select("ticker", "ts", F.col("side").cast("double").alias("side"), *keep).join(touch, ["ticker", "ts"]).join(out, ["ticker", "ts"]).where("day = _day")
    long = F.col("side") > 0
    gross = 1e4 * F.col("side") * (F.when(long, F.col("_bid")).otherwise(F.col("_ask")) / F.when(long, F.col("ask_px")).otherwise(F.col("bid_px")) - 1)
    return rows.select("ticker", "day", "ts", "side", *keep, gross.alias("gross_bps"), (gross - 2e4 * fee).alias("net_bps"))


def score(trades: DataFrame, *, min_trades: int = 30) -> DataFrame:
    """Per rule and ticker: trades, days, mean net, and Student's t over the days' means."""
    daily = trades.groupBy("rule", "ticker", "day").agg(F.avg("net_bps").alias("_m"), F.count(F.lit(1)).alias("_n"), F.sum("net_bps").alias("_s"))
    out = daily.groupBy("rule", "ticker").agg(F.sum("_n").alias("trades"), F.count(F.lit(1)).alias("days"), F.sum("_s").alias("_s"), F.avg("_m").alias("_d"), F.stddev_samp("_m").alias("_sd"))
    enough = F.col("trades") >= min_trades
    t = F.when(enough & (F.col("days") >= 2), F.try_divide(F.col("_d"), F.nullif(F.col("_sd") / F.sqrt("days"), F.lit(0.0))))
    return out.select("rule", "ticker", "trades", "days", F.when(enough, F.col("_s") / F.col("trades")).alias("mean_bps"), t.alias("t"))


def p_values(scored: DataFrame) -> DataFrame:
    """``scored`` with the one-sided p of t on days − 1 degrees of freedom."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, days: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else stats.t_sf(x, d - 1) for x, d in zip(t, days)], dtype="float64")

    return scored.withColumn("p", tail("t", "days"))


def ofi_frame(book: DataFrame, every: int = 10) -> DataFrame:
    """x: imbalance over depth of a bucket; y: the return of the bucket that directly follows, the same day."""
    b = L.ofi(book.where("ask_px > bid_px"), f"{every}s", max_gap_us=5_000_000).withColumn("day", C.bucket(F.col("ts"), "1d"))
    w = W.partitionBy("ticker", "day").orderBy("ts")
    follows = F.unix_micros(F.lead("ts").over(w)) == F.unix_micros("ts") + every * 1_000_000
    return b.select("ticker", "day", "ts", C.plus(F.col("ts"), (every - 1) * 1_000_000).alias("decide_ts"), F.when(F.col("depth") > 0, F.col("ofi") / F.col("depth")).alias("x"), F.when(follows, F.lead("return_bps").over(w)).alias("y"))


def ofi_rules(frame: DataFrame, grid: DataFrame, *, thresholds: tuple[float, ...] = (1.0, 2.0, 3.0), horizons: tuple[int, ...] = (10, 60), window: int = 360, fee: float = TAKER) -> DataFrame:
    """Trades where x is beyond k deviations of the day's previous buckets; the thresholds are one explode."""
    w = W.partitionBy("ticker", "day").orderBy("ts").rowsBetween(-window, -1)
    ready = F.count("x").over(w) == window
    z = F.when(ready, F.try_divide(F.col("x") - F.avg("x").over(w), F.nullif(F.stddev_samp("x").over(w), F.lit(0.0))))
    signals = frame.select("ticker", F.col("decide_ts").alias("ts"), z.alias("z")).withColumn("k", F.explode(F.array(*map(F.lit, thresholds))))
    signals = signals.withColumn("side", F.when(F.col("z") > F.col("k"), 1).when(F.col("z") < -F.col("k"), -1).otherwise(0))
    return _by_horizon(grid, signals.select("ticker", "ts", "side", "k"), "ofi z>", horizons, fee)


def _by_horizon(grid: DataFrame, signals: DataFrame, name: str, horizons: tuple[int, ...], fee: float) -> DataFrame:
    parts = [taker(grid, signals, h, fee=fee).withColumn("rule", F.concat(F.lit(name), F.col("k").cast("string"), F.lit(f" {h}s"))).drop("k") for h in horizons]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def microprice_frame(grid: DataFrame, horizon: int) -> DataFrame:
    """Squared errors in bps of the mid and the weighted mid as forecasts of the mid ``horizon`` seconds on."""
    later = grid.select("ticker", F.timestamp_micros(F.unix_micros("ts") - horizon * 1_000_000).alias("ts"), F.col("mid").alias("_later"), F.col("day").alias("_day"))
    e = lambda c: F.pow(1e4 * (F.col("_later") - F.col(c)) / F.col("mid"), 2)
    return grid.join(later, ["ticker", "ts"]).where("day = _day").select("ticker", "day", "ts", e("mid").alias("e_mid"), e("wmid").alias("e_wmid"), (e("mid") - e("wmid")).alias("d"))


def lead_frame(grid: DataFrame) -> DataFrame:
    """x: the leader's log return over a second; y: the mid's over the next one; both only between adjacent seconds."""
    w = W.partitionBy("ticker", "day").orderBy("ts")
    s = F.unix_micros("ts")
    x = F.when(F.lag(s).over(w) == s - 1_000_000, 1e4 * F.ln(F.try_divide(F.col("leader_px"), F.lag("leader_px").over(w))))
    y = F.when(F.lead(s).over(w) == s + 1_000_000, 1e4 * F.ln(F.try_divide(F.lead("mid").over(w), F.col("mid"))))
    return grid.select("ticker", "day", "ts", x.alias("x"), y.alias("y"))


def lead_rules(frame: DataFrame, grid: DataFrame, *, thresholds: tuple[float, ...] = (2.0, 5.0, 10.0), horizons: tuple[int, ...] = (1, 5, 30), fee: float = TAKER) -> DataFrame:
    signals = frame.select("ticker", "ts", "x", F.explode(F.array(*map(F.lit, thresholds))).alias("k"))
    signals = signals.withColumn("side", F.when(F.col("x") > F.col("k"), 1).when(F.col("x") < -F.col("k"), -1).otherwise(0))
    return _by_horizon(grid, signals.select("ticker", "ts", "side", "k"), "lead >", horizons, fee)


def slope(frame: DataFrame, x: str, y: str, *, lags: int = 6) -> dict:
    """OLS slope of y on x with a Newey-West t within each day; sums are aggregated in Spark, a dozen numbers come back."""
    require(frame, ["day", x, y])
    rows = frame.select("day", F.col("ts") if "ts" in frame.columns else F.monotonically_increasing_id().alias("ts"), F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("xm"), F.avg("y").alias("ym"), F.var_pop("x").alias("vx"), F.covar_pop("x", "y").alias("c"), F.var_pop("y").alias("vy")).first()
    if s["n"] < 30 or not s["vx"]:
        raise Refused("a slope needs 30 rows and some variation")
    b = s["c"] / s["vx"]
    z = (F.col("x") - s["xm"]) * ((F.col("y") - s["ym"]) - b * (F.col("x") - s["xm"]))
    w = W.partitionBy("day").orderBy("ts")
    terms = rows.withColumn("z", z)
    sums = terms.select(F.col("z"), *[F.lag("z", k).over(w).alias(f"z{k}") for k in range(1, lags + 1)]).agg(F.sum(F.col("z") * F.col("z")), *[F.coalesce(F.sum(F.col("z") * F.col(f"z{k}")), F.lit(0.0)) for k in range(1, lags + 1)]).first()
    total = sums[0] + sum(2 * (1 - k / (lags + 1)) * sums[k] for k in range(1, lags + 1))
    se = math.sqrt(max(total, 0.0)) / (s["n"] * s["vx"])
    return {"n": s["n"], "slope": b, "t": b / se if se else None, "r2": s["c"] ** 2 / (s["vx"] * s["vy"]) if s["vy"] else None}


def lee_mykland(rets: DataFrame, *, per_day: int, window: int | None = None, alpha: float = 0.01, rule: str = "gumbel", q: float = 0.05) -> DataFrame:
    """``rets`` with sigma_local, L, threshold and jump: the scale is of pairs strictly before the return it judges."""
    one_of("rule", rule, ("gumbel", "bh"))
    k = window or math.ceil(math.sqrt(252 * per_day))
    if k < 3:
        raise Refused(f"window={k}")
    w = C.by_ticker()
    rows = rets.withColumn("_bp", F.abs("return") * F.abs(F.lag("return").over(w)))
    past = w.rowsBetween(-(k - 2), -1)
    sigma = F.when(F.count("_bp").over(past) == k - 2, F.sqrt(F.sum("_bp").over(past) / (k - 2)))
    rows = rows.withColumn("sigma_local", sigma).withColumn("L", F.try_divide(F.col("return"), F.nullif(F.col("sigma_local"), F.lit(0.0)))).drop("_bp")
    if rule == "gumbel":
        top = stats.gumbel_threshold(per_day, alpha)
        return rows.withColumns({"threshold": F.lit(top), "jump": F.coalesce(F.abs("L") > top, F.lit(False))})
    return false_discoveries(rows.withColumn("p_value", C.erfc(F.abs("L") / math.sqrt(2))), "p_value", q).withColumnRenamed("discovery", "jump")


def false_discoveries(df: DataFrame, p: str, q: float) -> DataFrame:
    """``df`` with ``discovery``: the rule of Benjamini and Hochberg at ``q`` over every row that has a p.

    The rule looks for the largest p whose rank reaches n p / q.  Rows are counted in narrow bins of log p; the bins before each one give the ranks that
    its rows have at most, so only bins that may hold the threshold are ranked, each on its own.  Two numbers come to the driver.
    """
    if not 0 < q < 1:
        raise Refused(f"q={q} must be inside (0, 1)")
    n = df.agg(F.count(p)).first()[0]
    bin_ = F.floor(-F.ln(F.greatest(F.col(p), F.lit(1e-300))) * 1000)
    tested = df.where(F.col(p) <= q).select(F.col(p).alias("_p"), bin_.alias("_bin"))
    smaller = W.partitionBy(F.lit(0)).orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    counted = tested.groupBy("_bin").agg(F.count(F.lit(1)).alias("_c"), F.min("_p").alias("_least")).withColumn("_above", F.coalesce(F.sum("_c").over(smaller), F.lit(0)))
    may = counted.where(F.col("_least") * n <= (F.col("_above") + F.col("_c")) * q).select("_bin", "_above")
    rank = F.col("_above") + F.row_number().over(W.partitionBy("_bin").orderBy("_p"))
    top = tested.join(may, "_bin").withColumn("_rank", rank).where(F.col("_p") * n <= F.col("_rank") * q).agg(F.max("_p")).first()[0]
    return df.withColumn("discovery", F.lit(False) if top is None else F.coalesce(F.col(p) <= top, F.lit(False)))


def _shorth(x: np.ndarray) -> float:
    x = np.sort(x)
    h = len(x) // 2 + 1
    return float(SHORTH * (x[h - 1 :] - x[: len(x) - h + 1]).min()) if len(x) > 1 else math.nan


def periodicity(rets: DataFrame, *, slot_minutes: int, per_day: int, by: str = "time_of_week") -> DataFrame:
    """Robust periodicity per slot: standardise by the day's bipower scale, shortest halves, then a weighted deviation; mean factor² is 1."""
    one_of("by", by, ("time_of_week", "time_of_day"))
    keys = ["ticker", *(["weekday"] if by == "time_of_week" else []), "slot"]
    day = W.partitionBy("ticker", F.to_date("ts"))
    slot = (F.hour("ts") * 60 + F.minute("ts") - F.pmod(F.hour("ts") * 60 + F.minute("ts"), F.lit(slot_minutes))).alias("slot")
    rows = rets.select("ticker", "ts", "return", (F.weekday("ts") + 1).alias("weekday"), slot, (F.abs("return") * F.abs(F.lag("return").over(C.by_ticker()))).alias("_bp"))
    n = F.count("return").over(day)
    scale = F.when((n >= per_day / 2) & (n > 1), F.sqrt(F.lit(math.pi / 2) * F.nullif(F.sum("_bp").over(day), F.lit(0.0)) / (n - 1)))
    rows = rows.withColumn("z", F.try_divide(F.col("return"), scale)).where("z is not null").select(*keys, "z")

    def half(p: pd.DataFrame) -> pd.DataFrame:
        return p[keys].head(1).assign(n=len(p), sh=_shorth(p["z"].to_numpy()))

    sh = rows.groupBy(*keys).applyInPandas(half, ", ".join(f"{k} {'string' if k == 'ticker' else 'int'}" for k in keys) + ", n long, sh double")
    per = W.partitionBy("ticker")
    sh = sh.withColumn("_f", F.try_divide(F.col("sh"), F.sqrt(F.avg(F.col("sh") * F.col("sh")).over(per))))
    inside = (F.pow(F.try_divide(F.col("z"), F.nullif(F.col("_f"), F.lit(0.0))), 2) <= CHI2_99).cast("double")
    wsd = rows.join(sh, keys).groupBy(*keys, "n").agg(F.sqrt(F.lit(WEIGHTED) * F.try_divide(F.sum(inside * F.col("z") * F.col("z")), F.nullif(F.sum(inside), F.lit(0.0)))).alias("_w"))
    return wsd.select(*keys, "n", F.try_divide(F.col("_w"), F.sqrt(F.avg(F.col("_w") * F.col("_w")).over(per))).alias("factor"))


def hayashi_yoshida(t: np.ndarray, x: np.ndarray, s: np.ndarray, y: np.ndarray, shift: int) -> float:
    """Covariance of two log prices on their own clocks (microseconds), y's moved back by ``shift``: each change of y meets the changes of x it overlaps."""
    a, b = s[:-1] - shift, s[1:] - shift
    first, last = np.searchsorted(t, a, side="right"), np.searchsorted(t, b, side="left")
    lo, hi = np.clip(first - 1, 0, len(t) - 1), np.clip(last, 0, len(t) - 1)
    return float(((x[hi] - x[lo]) * np.diff(y))[(a < t[-1]) & (b > t[0])].sum())


def lead_lag(x: DataFrame, y: DataFrame, *, lags_ms: tuple[int, ...] = LAGS_MS, every: str = "1h") -> DataFrame:
    """Per bucket: the lag with most correlation, its correlation, that at no lag, and the ratio of lead to lag.  Buckets are independent groups."""

    def ticks(df: DataFrame) -> DataFrame:
        return df.groupBy(C.bucket(F.col("ts"), every).alias("bucket"), F.unix_micros("ts").alias("t")).agg(F.max(F.ln("price")).alias("p"))

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) < 2 or len(b) < 2:
            return pd.DataFrame()
        a, b = a.sort_values("t"), b.sort_values("t")
        t, px, s, py = a["t"].to_numpy(), a["p"].to_numpy(), b["t"].to_numpy(), b["p"].to_numpy()
        scale = math.sqrt((np.diff(px) ** 2).sum() * (np.diff(py) ** 2).sum())
        if not scale:
            return pd.DataFrame()
        rho = {k: hayashi_yoshida(t, px, s, py, k * 1000) / scale for k in lags_ms}
        best = max(rho, key=lambda k: (round(abs(rho[k]), 12), -abs(k), -k))
        behind = sum(v * v for k, v in rho.items() if k < 0)
        return pd.DataFrame([{"ts": key[0], "lead_ms": float(best), "rho_lead": rho[best], "rho_0": rho.get(0), "llr": sum(v * v for k, v in rho.items() if k > 0) / behind if behind else None, "x_ticks": len(a), "y_ticks": len(b)}])

    return ticks(x).groupBy("bucket").cogroup(ticks(y).groupBy("bucket")).applyInPandas(run, "ts timestamp, lead_ms double, rho_lead double, rho_0 double, llr double, x_ticks long, y_ticks long")


def weekly_factors(rets: DataFrame) -> DataFrame:
    """ticker, week, weekday, hour, factor: hour × weekday factors fitted on what closed before each Monday, from running sums."""
    rows = rets.where(F.col("return").isNotNull()).select("ticker", (F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour"), "return", C.plus(C.bucket(F.timestamp_micros(F.unix_micros("close_ts") - 1), "1w"), "1w").alias("week"))
    weeks = rets.select("ticker", C.bucket(F.col("ts"), "1w").alias("week")).distinct()

    def running(key: str, out: str) -> DataFrame:
        sums = rows.groupBy("ticker", "week", key).agg(F.sum(F.abs("return")).alias("_a"), F.count(F.lit(1)).alias("_n"))
        grid = weeks.join(sums.select("ticker", key).distinct(), "ticker").join(sums, ["ticker", "week", key], "left")
        w = W.partitionBy("ticker", key).orderBy("week")
        mean = F.try_divide(F.sum(F.coalesce("_a", F.lit(0.0))).over(w), F.nullif(F.sum(F.coalesce("_n", F.lit(0))).over(w), F.lit(0)))
        cells = grid.select("ticker", "week", key, mean.alias("_s"))
        week = W.partitionBy("ticker", "week")
        whole = F.count("_s").over(week) == F.count(F.lit(1)).over(week)
        return cells.select("ticker", "week", key, F.when(whole, F.try_divide(F.col("_s"), F.avg("_s").over(week))).alias(out))

    cells = rows.select("ticker", "weekday", "hour").distinct()
    table = weeks.join(cells, "ticker").join(running("hour", "_h"), ["ticker", "week", "hour"], "left").join(running("weekday", "_d"), ["ticker", "week", "weekday"], "left").withColumn("_f", F.col("_h") * F.col("_d"))
    week = W.partitionBy("ticker", "week")
    whole = F.count("_f").over(week) == F.count(F.lit(1)).over(week)
    return table.select("ticker", "week", "weekday", "hour", F.when(whole, F.try_divide(F.col("_f"), F.sqrt(F.avg(F.col("_f") * F.col("_f")).over(week)))).alias("factor"))
