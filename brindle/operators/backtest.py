"""Backtests that keep every trial: positions earn the next bar, turnover costs, funding is charged only when every due hour is known."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import indicators as I
from brindle.refuse import Refused, one_of, require

TAKER_FEE = 0.00045
SIDES = ("long_short", "long_flat")
TRIAL = ("trial", "ticker", "ts", "close_ts", "position", "bar_return", "gross", "cost", "funding", "net")


def _funded(bars: DataFrame, funding: DataFrame) -> DataFrame:
    """ticker, ts, rate_sum, covered: rates of the settlement hours H with ts < H <= close_ts, and whether each had one."""
    hour = F.date_trunc("hour", "ts")
    settled = funding.groupBy("ticker", hour.alias("_hour")).agg(F.min_by("rate", "ts").cast("double").alias("rate"))
    first, last = hour + F.expr("INTERVAL 1 HOUR"), F.date_trunc("hour", "close_ts")
    hours = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 HOUR")))
    due = bars.select("ticker", "ts", F.explode_outer(hours).alias("_hour")).join(settled, ["ticker", "_hour"], "left")
    return due.groupBy("ticker", "ts").agg(F.coalesce(F.sum("rate"), F.lit(0.0)).alias("rate_sum"), (F.count("_hour") == F.count("rate")).alias("covered"))


def returns(bars: DataFrame, position: Column | str, *, fee: float = TAKER_FEE, funding: DataFrame | None = None, by: tuple[str, ...] = ("ticker",)) -> DataFrame:
    """What ``position``, decided at each close, earns on the next bar.

    by: the columns of one series (with ``trial`` first for many trials at once).  A bar after a hole earns and costs nothing that is known.
    """
    if fee < 0:
        raise Refused(f"fee={fee} is negative")
    require(bars, [*by, "ts", "close_ts", "close"])
    w = W.partitionBy(*by).orderBy("ts")
    rows = bars.withColumn("_p", (F.col(position) if isinstance(position, str) else position).cast("double"))
    rows = rows.withColumns({"_held": F.lag("_p").over(w), "_ret": C.simple_return(w), "_next": C.contiguous(w)})
    rows = rows.withColumn("_turn", F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0.0))))
    if funding is None:
        rows = rows.withColumns({"rate_sum": F.lit(None).cast("double"), "covered": F.lit(False)})
    else:
        rows = rows.join(_funded(rows.select("ticker", "ts", "close_ts").distinct(), funding), ["ticker", "ts"], "left")
    on = lambda x: F.when(F.col("_next"), x)
    paid = F.when(F.col("_next") & F.col("covered"), F.col("_held") * F.col("rate_sum"))
    out = rows.withColumns({"bar_return": on(F.col("_ret")), "gross": on(F.col("_held") * F.col("_ret")), "cost": on(F.col("_turn") * fee), "funding": paid})
    net = F.col("gross") - F.col("cost") - F.coalesce("funding", F.lit(0.0))
    return out.select(*by, "ts", "close_ts", F.col("_held").alias("position"), "bar_return", "gross", "cost", "funding", net.alias("net"), F.lit(True).alias("modelled"), F.col("funding").isNotNull().alias("funding_charged"))


def trials(bars: DataFrame, positions: dict[str, str], *, fee: float = TAKER_FEE, funding: DataFrame | None = None) -> DataFrame:
    """Every named position column as a trial, from one pass: the columns are unpivoted and one window serves all trials."""
    pairs = ", ".join(f"'{name}', cast(`{c}` as double)" for name, c in positions.items())
    long = bars.select("ticker", "ts", "close_ts", "close", F.expr(f"stack({len(positions)}, {pairs}) as (trial, _position)"))
    return returns(long, "_position", fee=fee, funding=funding, by=("trial", "ticker")).select(*TRIAL)


def _sided(x: Column, side: str) -> Column:
    return F.greatest(x, F.lit(0.0)) if side == "long_flat" else x


def moving_average(bars: DataFrame, fasts: tuple[int, ...], slows: tuple[int, ...], *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    """Each fast < slow crossover of simple means per ticker; every mean is computed once."""
    for s in sides:
        one_of("side", s, SIDES)
    rows = bars.withColumns({f"_m{n}": C.full(n, F.col("close"), F.avg("close")) for n in {*fasts, *slows}})
    found = {f"ma_{f}_{s}_{side}": _sided(F.signum(F.col(f"_m{f}") - F.col(f"_m{s}")), side) for f in fasts for s in slows if f < s for side in sides}
    if not found:
        raise Refused("no fast mean is shorter than a slow one")
    return trials(rows.withColumns({f"_p_{k}": v for k, v in found.items()}), {k: f"_p_{k}" for k in found}, fee=fee)


def momentum(bars: DataFrame, lookbacks: tuple[int, ...], *, fee: float = TAKER_FEE) -> DataFrame:
    """The sign of the return over each lookback."""
    found = {f"mom_{n}": F.signum(F.try_divide(F.col("close"), F.lag("close", n).over(C.by_ticker())) - 1) for n in lookbacks}
    return trials(bars.withColumns({f"_p_{k}": v for k, v in found.items()}), {k: f"_p_{k}" for k in found}, fee=fee)


def _kernel_trials(bars: DataFrame, kernels: dict[str, I.Kernel | Callable], fee: float) -> DataFrame:
    return trials(I.add(bars, **kernels), {k: k for k in kernels}, fee=fee)


def _clip(k: I.Kernel, side: str) -> I.Kernel:
    return k if side == "long_short" else I.Kernel(lambda p: np.maximum(k.run(p), 0))


def ema_crossover(bars: DataFrame, fasts: tuple[int, ...] = (5, 10, 20), slows: tuple[int, ...] = (50, 100, 200), *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    cross = lambda f, s: I.Kernel(lambda p: np.sign(I.ema(f).run(p) - I.ema(s).run(p)))
    return _kernel_trials(bars, {f"ema_{f}_{s}_{side}": _clip(cross(f, s), side) for f in fasts for s in slows if f < s for side in sides}, fee)


def macd_cross(bars: DataFrame, params: tuple[tuple[int, int, int], ...] = ((12, 26, 9), (8, 17, 9)), *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    cross = lambda a, b, c: I.Kernel(lambda p: np.sign(I.macd(a, b).run(p) - I.macd_signal(a, b, c).run(p)))
    return _kernel_trials(bars, {f"macd_{a}_{b}_{c}_{side}": _clip(cross(a, b, c), side) for a, b, c in params for side in sides}, fee)


def supertrend(bars: DataFrame, periods: tuple[int, ...] = (10, 20), multipliers: tuple[float, ...] = (2.0, 3.0), *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    return _kernel_trials(bars, {f"st_{n}_{m:g}_{side}".replace(".", "p"): _clip(I.supertrend(n, m), side) for n in periods for m in multipliers for side in sides}, fee)


def _when(x: np.ndarray, test: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.nan, test)


def rsi_reversion(bars: DataFrame, periods: tuple[int, ...] = (7, 14), bands: tuple[tuple[int, int], ...] = ((30, 70), (20, 80)), *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    """Long below the lower band until 50, short above the upper until 50."""

    def rule(n: int, lo: int, hi: int) -> I.Kernel:
        x = I.rsi(n).run
        return I.Kernel(lambda p: (lambda v: I.held(_when(v, v < lo), _when(v, v >= 50), _when(v, v > hi), _when(v, v <= 50)))(x(p)))

    return _kernel_trials(bars, {f"rsi_{n}_{lo}_{hi}_{side}": _clip(rule(n, lo, hi), side) for n in periods for lo, hi in bands for side in sides}, fee)


def bollinger_reversion(bars: DataFrame, windows: tuple[int, ...] = (20, 50), widths: tuple[float, ...] = (1.5, 2.0, 2.5), *, sides: tuple[str, ...] = SIDES, fee: float = TAKER_FEE) -> DataFrame:
    """Long below the lower band until the mean, short above the upper one."""

    def rule(n: int, k: float) -> I.Kernel:
        def run(p: pd.DataFrame) -> np.ndarray:
            c = p["close"].astype(float)
            sd = c.rolling(n).std(ddof=0)
            z = ((c - c.rolling(n).mean()) / sd.where(sd > 0)).to_numpy()
            return I.held(_when(z, z < -k), _when(z, z >= 0), _when(z, z > k), _when(z, z <= 0))

        return I.Kernel(run)

    return _kernel_trials(bars, {f"boll_{n}_{k:g}_{side}".replace(".", "p"): _clip(rule(n, k), side) for n in windows for k in widths for side in sides}, fee)


def indicator_signals(bars: DataFrame, *, fee: float = TAKER_FEE) -> DataFrame:
    """The whole search: five families."""
    out = ema_crossover(bars, fee=fee)
    for family in (rsi_reversion, bollinger_reversion, macd_cross, supertrend):
        out = out.unionByName(family(bars, fee=fee))
    return out


def summary(frame: DataFrame, ppy: float | None = None) -> DataFrame:
    """Per trial and ticker: periods, Sharpe (null under 30), skewness, raw kurtosis, compounded net and gross.  Trials without returns keep their row."""
    require(frame, ["trial", "ticker", "net", "gross"])
    total = lambda c: F.coalesce(F.product(1 + F.coalesce(F.col(c), F.lit(0.0))), F.lit(1.0)) - 1
    sharpe = F.when(F.count("net") >= 30, F.try_divide(F.avg("net"), F.nullif(F.stddev_samp("net"), F.lit(0.0))))
    varied = F.stddev_pop("net") > 0
    out = frame.groupBy("trial", "ticker").agg(
        F.count("net").alias("periods"), sharpe.alias("sharpe"), F.when(varied, F.skewness("net")).alias("skew"), F.when(varied, F.kurtosis("net") + 3).alias("kurt"), total("net").alias("total_net"), total("gross").alias("total_gross")
    )
    return out if ppy is None else out.withColumn("sharpe_annual", F.col("sharpe") * F.lit(ppy**0.5))


def describe(frame: DataFrame, ppy: float, column: str = "net") -> DataFrame:
    """Per trial and ticker: n, cagr, sharpe, sortino, omega, max_drawdown, calmar, ulcer, drawdown_duration.

    Wealth is a running sum of log growth; where a return is −100 % or worse, wealth is 0 from there on.
    """
    w = W.partitionBy("trial", "ticker").orderBy("ts")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    r = F.col(column)
    rows = frame.where(r.isNotNull()).withColumn("_dead", F.max((r <= -1).cast("int")).over(up))
    rows = rows.withColumn("_log", F.sum(F.ln(F.when(r > -1, 1 + r).otherwise(F.lit(1.0)))).over(up))
    wealth = F.when(F.col("_dead") == 1, F.lit(0.0)).otherwise(F.exp("_log"))
    rows = rows.withColumn("_v", wealth).withColumn("_dd", 1 - F.col("_v") / F.greatest(F.max("_v").over(up), F.lit(1.0)))
    # a run below the peak is numbered by the peaks before it
    rows = rows.withColumn("_run", F.sum((F.col("_dd") <= 0).cast("int")).over(up)).withColumn("_length", F.sum((F.col("_dd") > 0).cast("int")).over(W.partitionBy("trial", "ticker", "_run")))
    down, gain, loss = F.least(r, F.lit(0.0)), F.sum(F.greatest(r, F.lit(0.0))), F.sum(F.greatest(-r, F.lit(0.0)))
    out = rows.groupBy("trial", "ticker").agg(
        F.count(r).alias("n"), F.max_by("_v", "ts").alias("_end"), F.try_divide(F.avg(r), F.nullif(F.stddev_samp(r), F.lit(0.0))).alias("sharpe"),
        F.try_divide(F.avg(r), F.nullif(F.sqrt(F.avg(down * down)), F.lit(0.0))).alias("sortino"), F.try_divide(gain, F.nullif(loss, F.lit(0.0))).alias("omega"),
        F.max("_dd").alias("max_drawdown"), F.sqrt(F.avg(F.col("_dd") * F.col("_dd"))).alias("ulcer"), F.max("_length").alias("drawdown_duration"),
    )
    out = out.withColumn("cagr", F.when(F.col("_end") <= 0, F.lit(-1.0)).otherwise(F.pow("_end", F.lit(ppy) / F.col("n")) - 1))
    return out.withColumn("calmar", F.try_divide(F.col("cagr"), F.nullif(F.col("max_drawdown"), F.lit(0.0)))).drop("_end")


def rolling_sharpe(frame: DataFrame, window: int, column: str = "net") -> DataFrame:
    w = W.partitionBy("trial", "ticker").orderBy("ts")
    x = F.col(column)
    return frame.select("trial", "ticker", "ts", F.try_divide(C.full(window, x, F.avg(x), w), F.nullif(C.full(window, x, F.stddev_samp(x), w), F.lit(0.0))).alias("rolling_sharpe"))


def trades_table(frame: DataFrame) -> DataFrame:
    """Runs of one side as trades: side, entry, exit, bars, gross, cost, net, whether it is still open or spans a hole.

    A run's number is a running count of side changes; the run is then one group.
    """
    require(frame, ["trial", "ticker", "ts", "close_ts", "position", "gross", "cost", "net"])
    w = W.partitionBy("trial", "ticker").orderBy("ts")
    side = F.signum(F.coalesce("position", F.lit(0.0)))
    rows = frame.withColumn("_side", side).withColumn("_new", (~F.col("_side").eqNullSafe(F.lag("_side").over(w))).cast("int")).withColumn("_run", F.sum("_new").over(w)).withColumn("_last", F.max("ts").over(W.partitionBy("trial", "ticker")))
    grow = lambda c: F.coalesce(F.product(1 + F.coalesce(F.col(c), F.lit(0.0))), F.lit(1.0)) - 1
    out = rows.where("_side <> 0").groupBy("trial", "ticker", "_run").agg(
        F.when(F.max("_side") > 0, "long").otherwise("short").alias("side"), F.min("ts").alias("entry_ts"), F.max("close_ts").alias("exit_ts"), F.count(F.lit(1)).alias("bars"),
        grow("gross").alias("gross"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), grow("net").alias("net"), (F.max("ts") == F.max("_last")).alias("open"), F.max(F.col("net").isNull()).alias("spans_gap"),
    )
    return out.drop("_run")


def trades_summary(frame: DataFrame) -> DataFrame:
    """Per trial and ticker: trades, win rate, mean win and loss, profit factor, longest losing streak, exposure.  Trials without trades keep their row."""
    t = trades_table(frame)
    w = W.partitionBy("trial", "ticker").orderBy("entry_ts")
    t = t.withColumn("_won", (F.col("net") > 0).cast("int")).withColumn("_streak", F.sum("_won").over(w))
    t = t.withColumn("_losing", F.sum(1 - F.col("_won")).over(W.partitionBy("trial", "ticker", "_streak")))
    won, lost = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") <= 0, F.col("net"))
    out = t.groupBy("trial", "ticker").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("_won").alias("win_rate"), F.avg(won).alias("mean_win"), F.avg(lost).alias("mean_loss"), F.try_divide(F.sum(won), F.nullif(-F.sum(lost), F.lit(0.0))).alias("profit_factor"), F.max("_losing").alias("losing_streak"), F.sum("bars").alias("_held")
    )
    every = frame.groupBy("trial", "ticker").agg(F.count(F.lit(1)).alias("bars"))
    return every.join(out, ["trial", "ticker"], "left").select("trial", "ticker", "bars", F.coalesce("trades", F.lit(0)).alias("trades"), "win_rate", "mean_win", "mean_loss", "profit_factor", "losing_streak", (F.coalesce("_held", F.lit(0)) / F.col("bars")).alias("exposure"))


def matrix(frame: DataFrame, columns: list[str], column: str = "net") -> DataFrame:
    """ts and a column per named ``trial|ticker``, rows where all have a value."""
    named = frame.withColumn("_name", F.concat_ws("|", "trial", "ticker"))
    return named.groupBy("ts").pivot("_name", columns).agg(F.first(column)).dropna(subset=columns)


def overlay(bars: DataFrame, frame: DataFrame, *, stop: float | None = None, take: float | None = None, trailing: bool = False, cooldown: int = 0, fee: float = TAKER_FEE, name: str = "overlay") -> DataFrame:
    """A trial with a stop or a target filled inside the bar: out at the level, flat until the signal changes and ``cooldown`` bars have gone.

    If a bar touches both levels, the stop counts.  A bar that opens beyond a level fills at its open.
    """
    if (stop is None and take is None) or any(x is not None and x <= 0 for x in (stop, take)):
        raise Refused("a stop or a target above 0 is needed")
    rows = frame.select("trial", "ticker", "ts", "close_ts", "position").join(bars.select("ticker", "ts", "open", "high", "low", "close"), ["ticker", "ts"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts").reset_index(drop=True)
        n = len(p)
        held, gross, cost = np.zeros(n), np.full(n, np.nan), np.full(n, np.nan)
        before, entry, best, locked, wait, side = 0.0, np.nan, np.nan, 0.0, 0, 0.0
        for i in range(n):
            want = p.position[i] if p.position[i] == p.position[i] else 0.0
            wait = max(wait - 1, 0)
            if locked and np.sign(want) != locked:
                locked = 0.0
            now = 0.0 if locked or wait else want
            if i == 0 or p.close_ts[i - 1] != p.ts[i]:
                before = held[i] = now
                side, entry, best = np.sign(now), p.close[i], p.close[i]
                continue
            ref = p.close[i - 1]
            if np.sign(now) != side or not now:
                side, entry, best = np.sign(now), ref, ref
            turn, exit_at = abs(now - before), None
            if now:
                base = best if trailing else entry
                s = None if stop is None else base * (1 - side * stop)
                t = None if take is None else entry * (1 + side * take)
                worst, kind = (p.low[i], p.high[i]) if side > 0 else (p.high[i], p.low[i])
                if s is not None and side * worst <= side * s:
                    exit_at = side * min(side * s, side * p.open[i])
                elif t is not None and side * kind >= side * t:
                    exit_at = side * max(side * t, side * p.open[i])
                best = max(best, p.high[i]) if side > 0 else min(best, p.low[i])
            gross[i] = now * ((exit_at if exit_at is not None else p.close[i]) / ref - 1)
            held[i] = now
            if exit_at is not None:
                turn += abs(now)
                locked, wait, now, side = side, cooldown, 0.0, 0.0
            cost[i] = turn * fee
            before = now
        return p[["ticker", "ts", "close_ts"]].assign(trial=p.trial + "+" + name, position=held, gross=gross, cost=cost, net=gross - cost)[["trial", "ticker", "ts", "close_ts", "position", "gross", "cost", "net"]]

    return rows.groupBy("trial", "ticker").applyInPandas(run, "trial string, ticker string, ts timestamp, close_ts timestamp, position double, gross double, cost double, net double")
