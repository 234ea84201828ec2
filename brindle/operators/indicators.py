"""Technical indicators, each evaluated per contiguous stretch of bars.

Rolling ones are window columns.  Those whose state depends on every earlier bar (seeded exponential averages, Supertrend, held positions) are kernels over one
stretch; all that are asked for run in one pass over it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from brindle.functions import columns as C
from brindle.functions.family import scan
from brindle.refuse import Refused, one_of, require

Rolling = Callable[[WindowSpec], Column]


@dataclass(frozen=True)
class Kernel:
    """A recursive indicator: a function of a stretch's bars, in order, to an array with NaN for null."""

    run: Callable[[pd.DataFrame], np.ndarray]


def with_stretches(bars: DataFrame, name: str = "_stretch") -> DataFrame:
    """``bars`` with the number of the contiguous stretch each is in, per ticker."""
    return bars.withColumn(name, F.sum((~C.contiguous()).cast("int")).over(C.by_ticker()))


def add(bars: DataFrame, **indicators: Rolling | Kernel) -> DataFrame:
    """``bars`` with a column per indicator, none of which sees past a hole."""
    require(bars, ["ticker", "ts", "close_ts"])
    clash = sorted(set(indicators) & set(bars.columns))
    if clash:
        raise Refused(f"the bars already have {', '.join(clash)}")
    out = with_stretches(bars)
    w = W.partitionBy("ticker", "_stretch").orderBy("ts")
    out = out.withColumns({k: v(w) for k, v in indicators.items() if not isinstance(v, Kernel)})
    kernels = {k: v.run for k, v in indicators.items() if isinstance(v, Kernel)}
    if kernels:

        def one(p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("ts").reset_index(drop=True)
            return p.assign(**{k: pd.array(np.where(np.isnan(x := f(p)), None, x), dtype="Float64") for k, f in kernels.items()})

        def run(p: pd.DataFrame) -> pd.DataFrame:
            return pd.concat([one(part) for _, part in p.drop(columns="_bundle").groupby("_stretch", sort=False)])

        # short stretches travel together, so that a group is worth its overhead
        kind = T.StructType([*out.schema.fields, *[T.StructField(k, T.DoubleType()) for k in kernels]])
        bundled = out.withColumn("_bundle", F.floor(F.col("_stretch") / 256))
        out = bundled.groupBy("ticker", "_bundle").applyInPandas(run, kind)
    return out.drop("_stretch").select(*bars.columns, *indicators)


def seeded(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """An exponential average seeded with the mean of the first ``n`` values; missing values before the seed are passed over."""
    out = np.full(len(x), np.nan)
    have = np.flatnonzero(~np.isnan(x))
    if len(have) < n:
        return out
    out[have[n - 1 :]] = scan(alpha * x[have[n:]], 1 - alpha, float(x[have[:n]].mean()))
    return out


def sma(n: int, column: str = "close") -> Rolling:
    return lambda w: C.full(n, F.col(column), F.avg(column), w)


def ema(n: int, column: str = "close") -> Kernel:
    return Kernel(lambda p: seeded(p[column].to_numpy(float), n, 2 / (n + 1)))


def _rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = np.diff(x, prepend=np.nan)
    up, down = seeded(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n, 1 / n), seeded(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n, 1 / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(down > 0, 100 - 100 / (1 + up / down), np.where(up > 0, 100.0, np.nan))


def rsi(n: int = 14, column: str = "close") -> Kernel:
    return Kernel(lambda p: _rsi(p[column].to_numpy(float), n))


def macd(fast: int = 12, slow: int = 26, column: str = "close") -> Kernel:
    if fast >= slow:
        raise Refused(f"fast={fast} must be shorter than slow={slow}")
    return Kernel(lambda p: ema(fast, column).run(p) - ema(slow, column).run(p))


def macd_signal(fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> Kernel:
    line = macd(fast, slow, column)
    return Kernel(lambda p: seeded(line.run(p), signal, 2 / (signal + 1)))


def zscore(n: int = 20, column: str = "close") -> Rolling:
    def of(w: WindowSpec) -> Column:
        sd = C.full(n, F.col(column), F.stddev_pop(column), w)
        return F.when(sd > 0, (F.col(column) - F.avg(column).over(C.trailing(n, w))) / sd)

    return of


def bollinger(n: int = 20, k: float = 2.0, band: str = "upper", column: str = "close") -> Rolling:
    sign = {"upper": 1, "mid": 0, "lower": -1}[one_of("band", band, ("upper", "mid", "lower"))]
    return lambda w: C.full(n, F.col(column), F.avg(column), w) + F.lit(sign * k) * C.full(n, F.col(column), F.stddev_pop(column), w)


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def _true_range(p: pd.DataFrame) -> np.ndarray:
    h, low, before = p["high"].to_numpy(float), p["low"].to_numpy(float), p["close"].shift(1).to_numpy(float)
    return np.fmax(h - low, np.fmax(np.abs(h - before), np.abs(low - before)))


def atr(n: int = 14) -> Kernel:
    return Kernel(lambda p: seeded(_true_range(p), n, 1 / n))


def stochastic(k: int = 14, d: int = 3) -> Rolling:
    """Slow %D.  A mean of d %K values, each over k bars: one window of d rows over a window of k rows."""

    def of(w: WindowSpec) -> Column:
        def percent(shift: int) -> Column:
            frame = w.rowsBetween(-(k - 1) - shift, -shift)
            low, high, n = F.min("low").over(frame), F.max("high").over(frame), F.count("close").over(frame)
            return F.when((n == k) & (high > low), 100 * (F.lag("close", shift).over(w) - low) / (high - low))

        values = [percent(i) for i in range(d)]
        total = values[0]
        for v in values[1:]:
            total = total + v
        return total / d

    return of


def _supertrend(p: pd.DataFrame, n: int, multiplier: float) -> np.ndarray:
    a, mid, c = seeded(_true_range(p), n, 1 / n), ((p["high"] + p["low"]) / 2).to_numpy(float), p["close"].to_numpy(float)
    out = np.full(len(c), np.nan)
    side = up = down = None
    for i in np.flatnonzero(~np.isnan(a)):
        top, bottom = mid[i] + multiplier * a[i], mid[i] - multiplier * a[i]
        if side is None:
            up, down, side = top, bottom, (1.0 if c[i] >= mid[i] else -1.0)
        else:  # a band only tightens while the close stays inside it
            up = min(top, up) if c[i - 1] <= up else top
            down = max(bottom, down) if c[i - 1] >= down else bottom
            side = 1.0 if side < 0 and c[i] > up else -1.0 if side > 0 and c[i] < down else side
        out[i] = side
    return out


def supertrend(n: int = 10, multiplier: float = 3.0) -> Kernel:
    if multiplier <= 0:
        raise Refused(f"multiplier={multiplier} must be positive")
    return Kernel(lambda p: _supertrend(p, n, multiplier))


def held(enter_long, exit_long, enter_short=None, exit_short=None) -> np.ndarray:
    """+1 from an entry until its exit, −1 likewise; an entry wins over an exit; NaN until a condition first has a value.  Conditions: 1, 0 or NaN."""
    n = len(enter_long)
    none = np.full(n, np.nan)
    c = np.array([enter_long, exit_long, none if enter_short is None else enter_short, none if exit_short is None else exit_short], float)
    known = np.maximum.accumulate(~np.isnan(c).all(axis=0)) if n else np.empty(0, bool)
    on, out, now = c == 1, np.full(n, np.nan), 0.0
    for i in np.flatnonzero(known):
        if on[0, i]:
            now = 1.0
        elif on[2, i]:
            now = -1.0
        elif (now > 0 and on[1, i]) or (now < 0 and on[3, i]):
            now = 0.0
        out[i] = now
    return out


def hold(enter_long: Callable, exit_long: Callable, enter_short: Callable | None = None, exit_short: Callable | None = None) -> Kernel:
    """A position between events; the conditions are functions of a stretch's bars to arrays of 1, 0 and NaN."""
    return Kernel(lambda p: held(enter_long(p), exit_long(p), None if enter_short is None else enter_short(p), None if exit_short is None else exit_short(p)))


def donchian(lookbacks: tuple[int, ...]) -> Kernel:
    """The share of lookbacks that are long: in at a new high of the lookback, out below a trailing stop at the channel's middle."""

    def run(p: pd.DataFrame) -> np.ndarray:
        c = p["close"]
        out = np.full(len(c), np.nan)
        states = []
        for n in lookbacks:
            hi, lo = c.rolling(n).max().to_numpy(), c.rolling(n).min().to_numpy()
            x, state, stop, s = c.to_numpy(float), 0.0, -np.inf, np.full(len(c), np.nan)
            for i in np.flatnonzero(~np.isnan(hi)):
                mid = (hi[i] + lo[i]) / 2
                if state == 0 and x[i] >= hi[i]:
                    state, stop = 1.0, mid
                elif state == 1:
                    stop = max(stop, mid)
                    if x[i] < stop:
                        state = 0.0
                s[i] = state
            states.append(s)
        every = np.array(states)
        have = ~np.isnan(every).any(axis=0)
        out[have] = every[:, have].mean(axis=0)
        return out

    return Kernel(run)
