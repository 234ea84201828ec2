"""Column builders: contiguity, returns, variance terms, full-window rolling aggregates, encodings.

A bar is ``ticker, ts, close_ts, open, high, low, close``.  Windows are rows of one ticker in time order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from brindle.refuse import Refused, micros, one_of

PERIODS_PER_YEAR = {"1m": 525_600, "1h": 8_760, "4h": 2_190, "1d": 365}


def by_ticker() -> WindowSpec:
    return W.partitionBy("ticker").orderBy("ts")


def periods_per_year(interval: str) -> int:
    return PERIODS_PER_YEAR[one_of("interval", interval, PERIODS_PER_YEAR)]


def bucket(ts: Column, every: str) -> Column:
    """The start of the UTC bucket that holds ``ts``; ``every`` is a span, ``"1w"`` (Mondays) or ``"1mo"``."""
    if every == "1mo":
        return F.date_trunc("month", ts)
    if every == "1w":
        return F.date_trunc("week", ts)
    w = micros(every)
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(w)))


def plus(ts: Column, span: str | int) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(micros(span)))


#: Coefficients of a Chebyshev fit of the complementary error function, relative error below 1.2e-7 everywhere.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """The complementary error function of numbers that aren't negative."""
    t = 1 / (1 + x / 2)
    inner = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        inner = F.lit(c) + t * inner
    return t * F.exp(inner - x * x)


def tick_order(ticks: DataFrame) -> Column:
    """The total order of ticks: time, then the stream's number and the row's, where there are such columns."""
    return F.struct("ts", *[c for c in ("stream_seq", "event_id", "trade_id") if c in ticks.columns])


def contiguous(w: WindowSpec | None = None) -> Column:
    """Whether the row before, per ticker, is the bar just before this one; false on the first."""
    w = w or by_ticker()
    return F.coalesce(F.lag("close_ts").over(w) == F.col("ts"), F.lit(False))


def simple_return(w: WindowSpec | None = None) -> Column:
    w = w or by_ticker()
    return F.try_divide(F.col("close"), F.lag("close").over(w)) - 1


def log_return(w: WindowSpec | None = None) -> Column:
    w = w or by_ticker()
    return F.ln(F.try_divide(F.col("close"), F.lag("close").over(w)))


def _log_ratio(a: str, b: str) -> Column:
    return F.ln(F.try_divide(F.col(a), F.col(b)))


def parkinson_term() -> Column:
    return F.pow(_log_ratio("high", "low"), 2) / F.lit(4 * math.log(2))


def garman_klass_term() -> Column:
    return F.lit(0.5) * F.pow(_log_ratio("high", "low"), 2) - F.lit(2 * math.log(2) - 1) * F.pow(_log_ratio("close", "open"), 2)


def rogers_satchell_term() -> Column:
    return _log_ratio("high", "close") * _log_ratio("high", "open") + _log_ratio("low", "close") * _log_ratio("low", "open")


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    w = w or by_ticker()
    return w.rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, aggregate: Column, w: WindowSpec | None = None) -> Column:
    """``aggregate`` over the last ``n`` rows, null unless all ``n`` have a value."""
    if n < 1:
        raise Refused(f"n={n} must be a positive number of rows")
    w = w or by_ticker()
    return F.when(F.count(value).over(trailing(n, w)) == n, aggregate.over(trailing(n, w)))


#: Fixed value: a ternary position is flat inside this band.
TERNARY_BAND = 0.5


def encode(z: Column, how: str) -> Column:
    """A z-score as a position: its sign (+1 at 0), its sign outside the band, or z·exp(−z²/4)/0.89; null stays null."""
    one_of("how", how, ("binary", "ternary", "score"))
    if how == "score":
        return z * F.exp(-z * z / 4) / F.lit(0.89)
    sign = F.when(z >= 0, 1.0).otherwise(-1.0)
    if how == "ternary":
        sign = F.when(F.abs(z) < TERNARY_BAND, 0.0).otherwise(sign)
    return F.when(z.isNotNull(), sign)


def local_clock(ts: Column, zone: str, prefix: str = "local_") -> dict[str, Column]:
    """hour, weekday (Monday is 1), date and daylight saving in a zone, by column name."""
    local = F.from_utc_timestamp(ts, zone)
    offset = F.unix_micros(local) - F.unix_micros(ts)
    year = F.year(local)
    noon = lambda month: F.make_timestamp(year, F.lit(month), F.lit(1), F.lit(12), F.lit(0), F.lit(0))
    usual = F.least(*[F.unix_micros(F.from_utc_timestamp(noon(m), zone)) - F.unix_micros(noon(m)) for m in (1, 7)])
    return {f"{prefix}hour": F.hour(local), f"{prefix}weekday": F.weekday(local) + 1, f"{prefix}date": F.to_date(local), f"{prefix}dst": offset != usual}
