"""Fitted models over tickers: each refit of each ticker is a group of its own, so a walk-forward is as parallel as it has refits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.functions import family
from brindle.functions import models as M
from brindle.functions import variance_models as V
from brindle.refuse import Refused, one_of, require

FIT = "ticker string, model string, dist string, nobs long, mu double, omega double, alpha double, beta double, gamma double, nu double, loglik double, aic double, bic double, persistence double"
FORECAST = "ticker string, model string, ts timestamp, close_ts timestamp, h int, variance double, cum_variance double, fitted_through timestamp, refit boolean"


def fit(rets: DataFrame, *, model: str = "garch", dist: str | None = None, min_obs: int = 250, column: str = "return") -> DataFrame:
    """One row per ticker: parameters and likelihood of a (1,1) model; missing returns are bridged."""
    one_of("model", model, M.MODELS)
    require(rets, ["ticker", "ts", column])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        y = p.sort_values("ts")[column].dropna().to_numpy(float)
        f = M.fit_garch(y, model, dist, min_obs)
        return pd.DataFrame([{"ticker": p["ticker"].iloc[0], "model": model, "dist": f["_fit"].dist, "nobs": len(y), **{k: f.get(k) for k in ("mu", "omega", "alpha", "beta", "gamma", "nu", "loglik", "aic", "bic", "persistence")}}])

    return rets.groupBy("ticker").applyInPandas(run, FIT)


def origins(rets: DataFrame, *, first: int, every: int, column: str = "return") -> DataFrame:
    """Returns with their number and, from number ``first`` on, the refit each is forecast with: the last one at or before it."""
    rows = rets.where(F.col(column).isNotNull()).withColumn("k", F.row_number().over(C.by_ticker()))
    return rows.withColumn("refit_k", F.when(F.col("k") >= first, first + F.floor((F.col("k") - first) / every) * every).cast("int"))


def walk_forward(
    rets: DataFrame, *, model: str = "garch", dist: str | None = None, first: int = 500, every: int = 20, horizons: tuple[int, ...] = (1,), window: int | None = None, column: str = "return", measure: str | None = None, batch: int = 16
) -> DataFrame:
    """Variance forecasts made at each close from ``first`` returns on, parameters refitted every ``every``, by any model of the family.

    A group is ``batch`` refits of one ticker that follow each other: it holds the returns that their fits may read (all up to the last one, or the last
    ``window`` of each) and those filtered up to the next refit.  So a return is sent once per batch after it, not once per refit.
    ``measure``: the column of realized variance for rgarch; carr's ``column`` holds log ranges.
    """
    one_of("model", model, M.MODELS)
    if first < 50 or every < 1 or batch < 1 or (window is not None and window < 50):
        raise Refused(f"first={first}, every={every}, batch={batch}, window={window}")
    if (model == "rgarch") != (measure is not None):
        raise Refused("rgarch takes a measure, and no other model does")
    rows = origins(rets if measure is None else rets.where(F.col(measure).isNotNull()), first=first, every=every, column=column)
    span = every * batch
    last = rows.groupBy("ticker").agg(F.max("k").alias("_n"))
    # batch b makes the forecasts at returns first + b * span and on; it reads everything before, or from its first window on
    start = F.greatest(F.lit(0), F.floor((F.col("k") - first) / span)).cast("int")
    end = F.floor((F.col("_n") - first) / span).cast("int")
    stop = end if window is None else F.least(end, F.floor((F.col("k") - first + window) / span).cast("int"))
    dealt = rows.join(last, "ticker").where(F.col("_n") >= first).withColumn("_batch", F.explode(F.when(start <= stop, F.sequence(start, stop))))
    top = max(horizons)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k").reset_index(drop=True)
        k0, n = int(p["k"].iloc[0]), int(p["k"].iloc[-1])
        y, x = p[column].to_numpy(float), None if measure is None else p[measure].to_numpy(float)
        parts = []
        begin = first + int(p["_batch"].iloc[0]) * span
        for at in range(begin, min(begin + span, n + 1), every):
            known = at - k0 + 1  # returns held that the fit may read
            low = 0 if window is None else max(0, known - window)
            cut = lambda v, stop: None if v is None else v[low:stop]  # noqa: B023, E731
            f = family.fit(model, y[low:known], dist=dist, x=cut(x, known), min_obs=50)
            here = np.arange(known, min(known + every, len(y) + 1))  # values known at each origin
            v = f.ahead(cut(y, here[-1]), here - low, top, cut(x, here[-1]), seed=at)
            total = np.cumsum(v, axis=1)
            own = p.iloc[here - 1]
            for h in horizons:
                parts.append(pd.DataFrame({"ticker": own["ticker"], "model": model, "ts": own["ts"], "close_ts": own["close_ts"], "h": h, "variance": v[:, h - 1], "cum_variance": total[:, h - 1], "fitted_through": p["close_ts"].iloc[known - 1], "refit": here == known}))
        return pd.concat(parts)[[x.split()[0] for x in FORECAST.split(", ")]]

    return dealt.groupBy("ticker", "_batch").applyInPandas(run, FORECAST)


def har(measures: DataFrame, *, first: int = 250, every: int = 20, horizons: tuple[int, ...] = (1,), lags: tuple[int, ...] = (1, 5, 22)) -> DataFrame:
    """HAR forecasts of realized variance: direct regressions per horizon on the means of the last 1, 5 and 22 values, read up to each refit.

    A forecast outside the range of what was fitted is set to its mean.
    """
    require(measures, ["ticker", "ts", "close_ts", "rv"])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=["rv"]).sort_values("ts").reset_index(drop=True)
        rv, out = p["rv"].to_numpy(float), []
        x = M.har_design(rv, lags)
        for h in horizons:
            total = np.concatenate([[0.0], np.cumsum(rv)])
            y = np.full(len(rv), np.nan)
            y[: len(rv) - h] = (total[h + 1 :] - total[1 : len(rv) - h + 1]) / h
            for r in range(first, len(rv), every):
                know = np.arange(max(lags) - 1, r - h)  # targets that have closed by the refit
                if len(know) < 4 * x.shape[1]:
                    continue
                b = np.linalg.lstsq(x[know], y[know], rcond=None)[0]
                for i in range(r, min(r + every, len(rv))):
                    v = float(x[i] @ b)
                    v = v if y[know].min() <= v <= y[know].max() else float(y[know].mean())
                    out.append((p["ticker"][i], "har", p["ts"][i], p["close_ts"][i], h, v, v * h, p["close_ts"][r], i == r))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FORECAST.split(", ")])

    return measures.groupBy("ticker").applyInPandas(run, FORECAST)


def align(forecasts: DataFrame, proxy: DataFrame) -> DataFrame:
    """Forecasts with the sum of the proxy over the ``h`` rows after their bar: differences of a running sum, two equality joins."""
    w = C.by_ticker()
    p = proxy.where("proxy is not null").select("ticker", "ts", F.row_number().over(w).alias("_k"), F.sum("proxy").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_s"))
    at = forecasts.join(p, ["ticker", "ts"])
    end = p.select("ticker", F.col("_k").alias("_e"), F.col("_s").alias("_t"))
    return at.withColumn("_e", F.col("_k") + F.col("h")).join(end, ["ticker", "_e"]).withColumn("realized", F.col("_t") - F.col("_s")).drop("_k", "_s", "_e", "_t")


def scorecard(aligned: DataFrame) -> DataFrame:
    """Per ticker, model and horizon: n, QLIKE and squared error of the cumulated variance."""
    q = F.try_divide(F.col("realized"), F.col("cum_variance")) + F.ln("cum_variance")
    return aligned.where("cum_variance > 0").groupBy("ticker", "model", "h").agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("qlike"), F.avg(F.pow(F.col("realized") - F.col("cum_variance"), 2)).alias("mse"))


def variance_breaks(rets: DataFrame, *, min_segment: int = 60, column: str = "return") -> DataFrame:
    """ticker, ts of the first return of each new variance."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=[column]).sort_values("ts").reset_index(drop=True)
        return p.loc[M.variance_breaks(p[column].to_numpy(float), min_segment), ["ticker", "ts"]]

    return rets.groupBy("ticker").applyInPandas(run, "ticker string, ts timestamp")


def joint(rets: DataFrame, tickers: list[str], column: str = "return") -> DataFrame:
    """ts and a column per ticker, rows where all have a return."""
    return rets.groupBy("ts").pivot("ticker", tickers).agg(F.first(column)).dropna(subset=tickers)


def ewma_pairs(rets: DataFrame, tickers: list[str], *, lam: float = 0.94, warmup: int = 33, column: str = "return") -> DataFrame:
    """ticker_i, ticker_j, ts, cov, rho per pair i <= j: pairs are independent series, so each is a group."""
    wide = joint(rets, tickers, column)
    pairs = [(a, b) for i, a in enumerate(tickers) for b in tickers[i:]]
    long = wide.select("ts", F.explode(F.array(*[F.struct(F.lit(a).alias("ticker_i"), F.lit(b).alias("ticker_j"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])).alias("p")).select("ts", "p.*")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts")
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)

        def smooth(v: np.ndarray) -> np.ndarray:
            out = np.empty(len(v))
            s = v[0]
            for i, u in enumerate(v):
                s = u if i == 0 else lam * s + (1 - lam) * u
                out[i] = s
            return out

        c, a, b = smooth(x * y), smooth(x * x), smooth(y * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            rho = c / np.sqrt(a * b)
        return p[["ticker_i", "ticker_j", "ts"]].assign(cov=c, rho=rho).iloc[warmup:]

    return long.groupBy("ticker_i", "ticker_j").applyInPandas(run, "ticker_i string, ticker_j string, ts timestamp, cov double, rho double")


def direction(frame: DataFrame, features: list[str], *, horizon: int, first: int, every: int, ridge: float = 1e-3) -> DataFrame:
    """ticker, ts, p, y: chances that the next ``horizon`` bars rise, by a ridge logit refitted every ``every`` bars.

    A refit reads only rows whose outcome had closed by it (rows in the last ``horizon`` bars are purged).
    """
    require(frame, ["ticker", "ts", "close", *features])

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=features).sort_values("ts").reset_index(drop=True)
        c = p["close"].to_numpy(float)
        y = np.full(len(c), np.nan)
        y[: len(c) - horizon] = (c[horizon:] > c[: len(c) - horizon]).astype(float)
        x, out = np.column_stack([np.ones(len(p)), p[features].to_numpy(float)]), []
        for r in range(first, len(p), every):
            know = np.arange(0, r - horizon)
            if len(know) < 10 * x.shape[1] or len(set(y[know])) < 2:
                continue
            mu, sd = x[know, 1:].mean(axis=0), x[know, 1:].std(axis=0)
            z = x.copy()
            z[:, 1:] = (z[:, 1:] - mu) / np.where(sd > 0, sd, 1)
            b = M.fit_logit(z[know], y[know], ridge)
            i = np.arange(r, min(r + every, len(p)))
            out.append(pd.DataFrame({"ticker": p["ticker"][i], "ts": p["ts"][i], "p": M.predict_logit(b, z[i]), "y": y[i]}))
        return pd.concat(out) if out else pd.DataFrame({"ticker": [], "ts": [], "p": [], "y": []})

    return frame.groupBy("ticker").applyInPandas(run, "ticker string, ts timestamp, p double, y double")


def reliability(forecasts: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate: calibration in bins of equal width."""
    rows = forecasts.where("y is not null and not isnan(y)")
    return rows.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def fit_variance(rets: DataFrame, *, model: str, dist: str | None = None, column: str = "return", measure: str | None = None, min_obs: int = 200) -> DataFrame:
    """ticker, name, value: parameters and log-likelihood of a model of the family.  ``measure``: the column of realized variance for rgarch."""
    one_of("model", model, M.MODELS)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=[column, *([measure] if measure else [])]).sort_values("ts")
        f = family.fit(model, p[column].to_numpy(float), dist=dist, x=p[measure].to_numpy(float) if measure else None, min_obs=min_obs)
        found = {**f.parameters(), "loglik": f.loglik}
        return pd.DataFrame({"ticker": p["ticker"].iloc[0], "name": list(found), "value": list(found.values())})

    return rets.groupBy("ticker").applyInPandas(run, "ticker string, name string, value double")


def realized_jumps(rets: DataFrame, every: str = "1d", *, min_n: int = 10) -> DataFrame:
    """ticker, ts, n, rv, bv, med_rv, tq, z, jump per bucket with ``min_n`` returns; a bucket's returns are one group."""
    rows = rets.where(F.col("return").isNotNull()).select("ticker", C.bucket(F.timestamp_micros(F.unix_micros("close_ts") - 1), every).alias("bucket"), "close_ts", "return")

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        if len(p) < max(min_n, 3):
            return pd.DataFrame()
        return pd.DataFrame([{"ticker": key[0], "ts": key[1], "n": len(p), **V.jump_measures(p.sort_values("close_ts")["return"].to_numpy(float))}])

    return rows.groupBy("ticker", "bucket").applyInPandas(run, "ticker string, ts timestamp, n long, rv double, bv double, med_rv double, tq double, z double, jump double")


def momentum_features(decision: DataFrame, factors: DataFrame, lookbacks: dict[str, int], *, half_life: int) -> DataFrame:
    """ticker, ts, close_ts, close, sigma and a z-score per lookback: deseasonalised variance is averaged with a half-life within each stretch, never across a hole.

    decision: bars with ``rv``.  factors: ticker, week, weekday, hour, factor.
    """
    from brindle.operators.indicators import with_stretches

    require(decision, ["ticker", "ts", "close_ts", "close", "rv"])
    rows = with_stretches(decision).withColumns({"week": C.bucket(F.col("ts"), "1w"), "weekday": F.weekday("ts") + 1, "hour": F.hour("ts")}).join(factors, ["ticker", "week", "weekday", "hour"], "left")
    rows = rows.select("ticker", "_stretch", "ts", "close_ts", "close", F.try_divide(F.col("rv"), F.nullif(F.col("factor") * F.col("factor"), F.lit(0.0))).alias("_v"))
    names = list(lookbacks)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ts").reset_index(drop=True)
        sigma = np.sqrt(p["_v"].ewm(halflife=half_life, adjust=False, min_periods=half_life).mean())
        log = np.log(p["close"])
        return p[["ticker", "ts", "close_ts", "close"]].assign(sigma=sigma, **{f"z_{k}": log.diff(n) / (sigma * np.sqrt(n)) for k, n in lookbacks.items()})

    return rows.groupBy("ticker", "_stretch").applyInPandas(run, "ticker string, ts timestamp, close_ts timestamp, close double, sigma double" + "".join(f", z_{k} double" for k in names))


def targeted(forecasts: DataFrame, bars: DataFrame, *, target: float, rule: str = "inverse_vol", cap: float = 2.0, fee: float = 0.00045) -> DataFrame:
    """A trial per model whose exposure holds variance at ``target`` by the one-step forecast made at each close."""
    from brindle.operators import backtest

    one_of("rule", rule, ("inverse_vol", "inverse_variance"))
    sigma = F.sqrt("variance")
    size = F.least(F.try_divide(F.lit(target), sigma) if rule == "inverse_vol" else F.pow(F.try_divide(F.lit(target), sigma), 2), F.lit(cap))
    rows = forecasts.where("h = 1").select("model", "ticker", "ts", size.alias("_size")).join(bars.select("ticker", "ts", "close_ts", "close"), ["ticker", "ts"]).withColumnRenamed("model", "trial")
    return backtest.returns(rows, "_size", fee=fee, by=("trial", "ticker"))
