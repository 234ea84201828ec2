"""Bars and what is measured on them: resampling, returns, realized volatility, moments, seasonality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions.family import scan
from brindle.refuse import Refused, micros, one_of, require

BARS = ("ticker", "ts", "close_ts", "close")
OHLC = (*BARS, "open", "high", "low")
ESTIMATORS = ("close_to_close", "parkinson", "garman_klass", "rogers_satchell", "yang_zhang")


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("venue", "ticker") if c in df.columns]


def bars(trades: DataFrame, interval: str, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """OHLCV per interval with trades; ``order`` is the total order of trades.  Partial aggregates run before the one shuffle."""
    require(trades, ["ticker", "ts", "price", "size"])
    at = F.struct(*order)
    out = trades.groupBy(*_keys(trades), C.bucket(F.col("ts"), interval).alias("_bucket")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count")
    )
    return out.select(*_keys(trades), F.col("_bucket").alias("ts"), C.plus(F.col("_bucket"), interval).alias("close_ts"), "open", "high", "low", "close", "volume", "trade_count")


def resample(df: DataFrame, every: str, width: str) -> DataFrame:
    """Whole bars of ``every`` from bars of ``width``; a bucket without one of its bars is dropped."""
    require(df, OHLC)
    wide, narrow = micros(every), micros(width)
    if narrow >= wide or wide % narrow:
        raise Refused(f"{every} must be a coarser whole multiple of {width}")
    extra = [F.sum(c).alias(c) for c in ("volume", "trade_count") if c in df.columns]
    extra += [f(c).alias(c) for c, f in (("high_all", F.max), ("low_all", F.min)) if c in df.columns]
    odd = F.max((F.unix_micros("close_ts") - F.unix_micros("ts") != narrow).cast("int"))
    out = df.groupBy(*_keys(df), C.bucket(F.col("ts"), every).alias("_bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), *extra, F.count(F.lit(1)).alias("n"), odd.alias("_odd")
    )
    # bars of another width are a mistake in the input: say so when the rows are read
    checked = F.when(F.col("_odd") == 1, F.raise_error(F.lit(f"a bar is not {width} wide"))).otherwise(F.col("n"))
    names = [c for c in ("volume", "trade_count", "high_all", "low_all") if c in df.columns]
    return out.withColumn("n", checked).where(F.col("n") == wide // narrow).select(*_keys(df), F.col("_bucket").alias("ts"), C.plus(F.col("_bucket"), every).alias("close_ts"), "open", "high", "low", "close", *names, "n")


def returns(df: DataFrame, kind: str = "simple") -> DataFrame:
    """ticker, ts, close_ts, return: null on a ticker's first bar and after a hole."""
    require(df, BARS)
    value = {"simple": C.simple_return, "log": C.log_return}[one_of("kind", kind, ("simple", "log"))]()
    return df.select("ticker", "ts", "close_ts", F.when(C.contiguous(), value).alias("return"))


def realized(df: DataFrame, estimator: str, window: int, min_periods: int | None = None) -> DataFrame:
    """ticker, ts, close_ts, n, sigma: volatility per period over the last ``window`` bars that follow their predecessor."""
    one_of("estimator", estimator, ESTIMATORS)
    require(df, BARS if estimator == "close_to_close" else OHLC)
    floor = window if min_periods is None else min_periods
    if window < 2 or not 1 <= floor <= window:
        raise Refused(f"window={window}, min_periods={min_periods}")
    counted = C.contiguous()
    if "in_gap" in df.columns:
        counted = counted & ~F.coalesce(F.col("in_gap"), F.lit(False))
    w = C.trailing(window)
    terms = {"close_to_close": {"r": C.log_return()}, "parkinson": {"x": C.parkinson_term()}, "garman_klass": {"x": C.garman_klass_term()}, "rogers_satchell": {"x": C.rogers_satchell_term()}}
    terms["yang_zhang"] = {"night": F.ln(F.try_divide(F.col("open"), F.lag("close").over(C.by_ticker()))), "day": F.ln(F.try_divide(F.col("close"), F.col("open"))), "x": C.rogers_satchell_term()}
    rows = df.withColumn("_counted", counted).withColumns({f"_{k}": v for k, v in terms[estimator].items()})
    masked = lambda k: F.when(F.col("_counted"), F.col(f"_{k}"))
    variance = lambda k: F.when(F.count(masked(k)).over(w) >= 2, F.var_samp(masked(k)).over(w))
    n = F.sum(F.col("_counted").cast("long")).over(w)
    if estimator == "close_to_close":
        v = variance("r")
    elif estimator == "yang_zhang":
        k = F.lit(0.34) / (F.lit(1.34) + F.try_divide((n + 1).cast("double"), (n - 1).cast("double")))
        v = variance("night") + k * variance("day") + (1 - k) * F.avg(masked("x")).over(w)
    else:
        v = F.avg(masked("x")).over(w)
    return rows.select("ticker", "ts", "close_ts", n.alias("n"), F.when(n >= floor, F.sqrt(v)).alias("sigma"))


def realized_from(fine: DataFrame, interval: str, width: str) -> DataFrame:
    """Realized variance, range, semivariances and quarticity per bucket; null unless the bucket has every return."""
    require(fine, OHLC)
    wide, narrow = micros(interval), micros(width)
    if narrow >= wide or wide % narrow:
        raise Refused(f"{interval} must be a coarser whole multiple of {width}")
    expected = wide // narrow
    rows = fine.select("ticker", C.bucket(F.col("ts"), interval).alias("_bucket"), F.when(C.contiguous(), C.log_return()).alias("_r"), C.parkinson_term().alias("_p"))
    r = F.col("_r")
    out = rows.groupBy("ticker", "_bucket").agg(
        F.count(r).alias("n"), F.sum(r * r).alias("rv"), F.sum(F.when(r.isNotNull(), F.col("_p"))).alias("rr"), F.coalesce(F.sum(F.when(r > 0, r * r)), F.lit(0.0)).alias("rs_plus"),
        F.coalesce(F.sum(F.when(r < 0, r * r)), F.lit(0.0)).alias("rs_minus"), F.sum(F.pow(r, 4)).alias("_q"),
    )
    whole = F.col("n") == expected
    values = [F.when(whole, F.col(c)).alias(c) for c in ("rv", "rr", "rs_plus", "rs_minus")]
    return out.select("ticker", F.col("_bucket").alias("ts"), C.plus(F.col("_bucket"), interval).alias("close_ts"), "n", F.lit(expected).cast("long").alias("expected"), *values, F.when(whole, F.col("n") / 3 * F.col("_q")).alias("rq"))


def realized_moments(rets: DataFrame, every: str = "1d", *, min_n: int = 50, column: str = "return") -> DataFrame:
    """ticker, ts, n, rv, skew, kurt per period: a return belongs to the period its bar closes in (midnight to the day before)."""
    require(rets, ["ticker", "close_ts", column])
    r = F.col(column)
    day = C.bucket(F.timestamp_micros(F.unix_micros("close_ts") - 1), every)
    out = rets.where(r.isNotNull()).groupBy("ticker", day.alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.sum(r * r).alias("rv"), F.sum(F.pow(r, 3)).alias("_s3"), F.sum(F.pow(r, 4)).alias("_s4"))
    ok = (F.col("n") >= min_n) & (F.col("rv") > 0)
    return out.select("ticker", "ts", "n", "rv", F.when(ok, F.sqrt("n") * F.col("_s3") / F.pow("rv", 1.5)).alias("skew"), F.when(ok, F.col("n") * F.col("_s4") / F.pow("rv", 2)).alias("kurt"))


def signature(df: DataFrame, minutes: tuple[int, ...], width: str = "1m") -> DataFrame:
    """ticker, minutes, days, mean_rv: the mean daily realized variance at each sampling step of so many bars' minutes.

    All steps come from one scan: a bar is repeated for each step whose grid it closes on.
    """
    require(df, BARS)
    bad = [k for k in minutes if k < 1 or 1440 % k]
    if bad:
        raise Refused(f"minutes={bad} must divide a day")
    steps = F.explode(F.filter(F.array(*[F.lit(k) for k in minutes]), lambda k: F.pmod(F.unix_micros("close_ts"), k.cast("long") * 60_000_000) == 0))
    grid = df.select("ticker", "close_ts", "close", steps.alias("minutes"))
    w = W.partitionBy("ticker", "minutes").orderBy("close_ts")
    step = F.col("minutes").cast("long") * 60_000_000
    r = F.when(F.unix_micros("close_ts") - F.unix_micros(F.lag("close_ts").over(w)) == step, F.ln(F.try_divide(F.col("close"), F.lag("close").over(w))))
    rows = grid.select("ticker", "minutes", F.to_date(F.timestamp_micros(F.unix_micros("close_ts") - step)).alias("_day"), r.alias("_r"))
    days = rows.groupBy("ticker", "minutes", "_day").agg(F.count("_r").alias("_n"), F.sum(F.col("_r") * F.col("_r")).alias("_rv")).where(F.col("_n") * F.col("minutes") == 1440)
    return days.groupBy("ticker", "minutes").agg(F.count(F.lit(1)).alias("days"), F.avg("_rv").alias("mean_rv"))


def ewma_vol(df: DataFrame, lam: float = 0.94, warmup: int | None = None) -> DataFrame:
    """ticker, ts, close_ts, n, sigma: exponentially weighted volatility of log returns, seeded with the first square; holes are bridged.

    A ticker's series is one group; its recursion is solved in blocks of array operations.
    """
    if not 0 < lam < 1:
        raise Refused(f"lam={lam} must be inside (0, 1)")
    skip = math.ceil(math.log(0.01) / math.log(lam)) if warmup is None else warmup
    rows = returns(df, "log")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        square = p["return"].to_numpy(float) ** 2
        known = square[~np.isnan(square)]
        n = np.cumsum(~np.isnan(square))
        s = scan((1 - lam) * known[1:], lam, known[0]) if len(known) else np.empty(0)
        sigma = np.sqrt(np.concatenate([[np.nan], s]))[n]
        return p[["ticker", "ts", "close_ts"]].assign(n=n, sigma=pd.array(np.where(n > skip, sigma, np.nan), dtype="Float64"))

    return rows.groupBy("ticker").applyInPandas(run, "ticker string, ts timestamp, close_ts timestamp, n long, sigma double")


def ewma_max(df: DataFrame, fast: float = 0.94, slow: float = 0.97) -> DataFrame:
    """The larger of a fast and a slow EWMA volatility, where both exist."""
    f, s = ewma_vol(df, fast), ewma_vol(df, slow).select("ticker", "ts", F.col("sigma").alias("_slow"))
    return f.join(s, ["ticker", "ts"]).select("ticker", "ts", "close_ts", F.when(F.col("sigma").isNotNull() & F.col("_slow").isNotNull(), F.greatest("sigma", "_slow")).alias("sigma"))


def seasonal_factors(rets: DataFrame, by: str = "hour_x_weekday", stat: str = "mean_abs") -> DataFrame:
    """ticker, weekday, hour, factor: how large returns of a calendar cell are, scaled so that the mean of factor² is 1."""
    one_of("by", by, ("hour_x_weekday", "hour_of_week", "hour_of_day"))
    one_of("stat", stat, ("mean_abs", "median_abs"))
    size = (F.avg if stat == "mean_abs" else F.median)(F.abs("return"))
    rows = rets.where(F.col("return").isNotNull()).select("ticker", (F.weekday("ts") + 1).alias("weekday"), F.hour("ts").alias("hour"), "return")
    all_cells = W.partitionBy("ticker")
    if by == "hour_of_day":
        cells = rows.groupBy("ticker", "hour").agg(size.alias("factor")).select("ticker", F.lit(None).cast("int").alias("weekday"), "hour", "factor")
    elif by == "hour_of_week":
        cells = rows.groupBy("ticker", "weekday", "hour").agg(size.alias("factor"))
    else:
        hours = rows.groupBy("ticker", "hour").agg(size.alias("_h"))
        days = rows.groupBy("ticker", "weekday").agg(size.alias("_d"))
        cells = hours.join(days, "ticker").select("ticker", "weekday", "hour", (F.col("_h") * F.col("_d")).alias("factor"))
    return cells.withColumn("factor", F.try_divide(F.col("factor"), F.sqrt(F.avg(F.col("factor") * F.col("factor")).over(all_cells))))


def deseasonalize(rets: DataFrame, factors: DataFrame) -> DataFrame:
    """``rets`` with ``factor`` and ``deseasonalized``, by weekday (where the factors have one) and hour."""
    f = factors.withColumnsRenamed({"weekday": "_weekday", "hour": "_hour", "ticker": "_ticker"})
    on = (F.col("ticker") == F.col("_ticker")) & (F.hour("ts") == F.col("_hour")) & (F.col("_weekday").isNull() | (F.weekday("ts") + 1 == F.col("_weekday")))
    return rets.join(f, on, "left").drop("_ticker", "_weekday", "_hour").withColumn("deseasonalized", F.try_divide(F.col("return"), F.col("factor")))


def period_returns(df: DataFrame, every: str = "1mo", column: str = "net") -> DataFrame:
    """Compounded return of each (trial,) ticker and period a bar opens in."""
    keys = [c for c in ("trial", "ticker") if c in df.columns]
    return df.where(F.col(column).isNotNull()).groupBy(*keys, C.bucket(F.col("ts"), every).alias("period")).agg((F.product(1 + F.col(column)) - 1).alias("period_return"), F.count(F.lit(1)).alias("n"))
