"""Is it the timing, or the search?  Random timing, permuted markets, and the deflated best of all trials.

Repetitions are rows: a sample's number is exploded beside its group, so a thousand shuffles of a trial, or two hundred permuted
markets, are dealt over the cluster like any other rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import stats
from brindle.operators import backtest as T
from brindle.refuse import Refused, require


def runs(positions: list[float]) -> list[tuple[float, int]]:
    """Maximal stretches of one position, with their lengths."""
    return [(value, sum(1 for _ in same)) for value, same in groupby(positions)]


def replay(positions: np.ndarray, returns: np.ndarray, fee: float) -> np.ndarray:
    """Net return of a path of positions: what is held times the return, less the fee on what changes."""
    return positions * returns - fee * np.abs(np.diff(positions, prepend=0.0))


def _sharpe(x: np.ndarray) -> float:
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    return float(x.mean() / sd) if sd > 0 else np.nan


def random_timing(trials: DataFrame, *, samples: int = 1000, seed: int = 0, fee: float = T.TAKER_FEE, per_task: int = 100) -> DataFrame:
    """trial, ticker, observed, percentile, random_median, samples, runs: the Sharpe ratio against shuffles of its own runs.

    Each (trial, ticker) goes to ``samples / per_task`` groups, which shuffle independently; sample k is seeded by its number, so
    the result doesn't depend on how samples are dealt.
    """
    require(trials, ["trial", "ticker", "ts", "position", "bar_return"])
    parts = -(-samples // per_task)
    rows = trials.where("position is not null and bar_return is not null").select("trial", "ticker", "ts", "position", "bar_return").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        trial, ticker, part = p["trial"].iloc[0], p["ticker"].iloc[0], int(p["part"].iloc[0])
        r = p["bar_return"].to_numpy(float)
        held = runs(p["position"].tolist())
        observed, out = _sharpe(replay(p["position"].to_numpy(float), r, fee)), []
        for k in range(part * per_task, min(samples, (part + 1) * per_task)):
            order = held[:]
            random.Random(f"{seed}:{trial}:{ticker}:{k}").shuffle(order)
            out.append(_sharpe(replay(np.repeat([v for v, _ in order], [n for _, n in order]), r, fee)))
        return pd.DataFrame({"trial": trial, "ticker": ticker, "k": range(part * per_task, part * per_task + len(out)), "observed": observed, "twin": out, "runs": len(held)})

    each = rows.groupBy("trial", "ticker", "part").applyInPandas(run, "trial string, ticker string, k long, observed double, twin double, runs long")
    twin, seen = F.nanvl("twin", F.lit(None).cast("double")), F.nanvl("observed", F.lit(None).cast("double"))
    out = each.withColumns({"twin": twin, "observed": seen}).groupBy("trial", "ticker").agg(
        F.max("observed").alias("observed"), F.sum((F.col("twin") >= F.col("observed")).cast("long")).alias("_over"), F.count("twin").alias("_n"), F.median("twin").alias("random_median"), F.count(F.lit(1)).alias("samples"), F.max("runs").alias("runs")
    )
    return out.select("trial", "ticker", "observed", F.when(F.col("observed").isNotNull(), (1 + F.coalesce("_over", F.lit(0))) / (1 + F.col("_n"))).alias("percentile"), "random_median", "samples", "runs")


def permuted_markets(bars: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """``bars`` once per sample: each ticker's bar shapes and opening gaps in a random order, the same one for all tickers of a sample; prices rebuilt from the first bar.

    Orders are drawn from the sample's number alone, so tickers can be rebuilt in different tasks.  All tickers must share their times.
    """
    require(bars, ["ticker", "ts", "close_ts", "open", "high", "low", "close"])
    rows = bars.select("ticker", "ts", "close_ts", "open", "high", "low", "close").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts").reset_index(drop=True)
        n = len(p)
        rng = random.Random(f"{seed}:{int(p['sample'].iloc[0])}")
        shape, gap = list(range(1, n)), list(range(1, n))
        rng.shuffle(shape)
        rng.shuffle(gap)
        o, h, low, c = (np.log(p[x].to_numpy(float)) for x in ("open", "high", "low", "close"))
        jump = np.append(0.0, (o[1:] - c[:-1]))[gap]
        body = (c - o)[shape]
        close = c[0] + np.cumsum(jump + body)
        start = close - body
        for name, x in (("open", start), ("high", start + (h - o)[shape]), ("low", start + (low - o)[shape]), ("close", close)):
            p.loc[1:, name] = np.exp(x)
        return p

    return rows.groupBy("sample", "ticker").applyInPandas(run, rows.schema)


def permutation_test(bars: DataFrame, search: Callable[[DataFrame], DataFrame], *, samples: int = 200, seed: int = 0) -> dict:
    """The best Sharpe ratio of a whole search against that of the same search on permuted markets.

    All markets are searched in one plan: a market's tickers are renamed apart, so ``search`` sees them as tickers of one frame.
    """
    if bars.groupBy("ts").count().agg(F.countDistinct("count")).first()[0] != 1:
        raise Refused("the tickers don't share their times")
    real = bars.select("ticker", "ts", "close_ts", "open", "high", "low", "close")
    twins = permuted_markets(bars, samples, seed).withColumn("ticker", F.concat_ws("#", "ticker", "sample")).drop("sample")
    scored = T.summary(search(real.unionByName(twins))).withColumn("market", F.when(F.col("ticker").contains("#"), F.substring_index("ticker", "#", -1).cast("int")).otherwise(-1))
    best = {r["market"]: r["best"] for r in scored.groupBy("market").agg(F.max("sharpe").alias("best")).collect()}
    if best.get(-1) is None:
        raise Refused("no trial has a Sharpe ratio")
    null = [v for k, v in best.items() if k >= 0 and v is not None]
    return {"best": best[-1], "p_best": stats.percentile(best[-1], null), "samples": samples}


def deflate(frame: DataFrame) -> dict:
    """The best trial of a frame, deflated by all: a row per trial comes back, as many as were run."""
    rows = [r.asDict() | {"trial": f"{r['trial']}|{r['ticker']}"} for r in T.summary(frame).collect()]
    return stats.deflate(rows)


def pbo(frame: DataFrame, columns: list[str], *, blocks: int = 16) -> dict:
    """Probability of overfitting of the trials ``trial|ticker``: rows are numbered and summed per block in Spark; blocks × trials numbers come back."""
    m = T.matrix(frame, columns)
    n = m.count()
    if n < 2 * blocks:
        raise Refused("too few rows")
    # rows are numbered within their day, after those of the days before, which are few to sum
    per_day = m.groupBy(F.to_date("ts").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    per_day = per_day.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_d").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_d").orderBy("ts")) - 1
    numbered = m.withColumn("_d", F.to_date("ts")).join(per_day, "_d").withColumn("_b", F.floor(place * blocks / n))
    sums = numbered.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.pow(F.col(f"`{c}`"), 2)).alias(f"q{i}") for i, c in enumerate(columns)]).orderBy("_b").collect()
    k = range(len(columns))
    return stats.pbo_from_sums(np.array([r["n"] for r in sums], float), np.array([[r[f"s{i}"] for i in k] for r in sums]), np.array([[r[f"q{i}"] for i in k] for r in sums]))


def excess(frame: DataFrame, benchmark: str, column: str = "net") -> DataFrame:
    """trial, ticker, ts, excess over the benchmark trial of the same ticker and time."""
    b = frame.where(F.col("trial") == benchmark).select("ticker", "ts", F.col(column).alias("_b"))
    return frame.where(F.col("trial") != benchmark).join(b, ["ticker", "ts"]).select("trial", "ticker", "ts", (F.col(column) - F.col("_b")).alias("excess"))


def shared_times(bars: DataFrame) -> DataFrame:
    """Bars at times that every ticker has."""
    every = bars.select(F.countDistinct("ticker").alias("_n"))
    full = bars.groupBy("ts").agg(F.countDistinct("ticker").alias("_k")).join(F.broadcast(every), F.col("_k") == F.col("_n"), "left_semi")
    return bars.join(full.select("ts"), "ts", "left_semi")
