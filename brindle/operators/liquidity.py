"""Liquidity and order flow: quoted, effective and realized spreads, spread estimators, flow, imbalance, impact, resilience, costs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators.asof import asof
from brindle.refuse import Refused, micros, one_of, require

BPS = 1e4


def quoted(df: DataFrame) -> DataFrame:
    """``df`` with ``mid`` and ``spread_bps``."""
    require(df, ["bid_px", "ask_px"])
    mid = (F.col("bid_px") + F.col("ask_px")) / 2
    return df.withColumns({"mid": mid, "spread_bps": F.try_divide(F.col("ask_px") - F.col("bid_px"), mid) * BPS})


def _side():
    return F.when(F.col("aggressor") == "bid", 1.0).when(F.col("aggressor") == "ask", -1.0)


def effective(trades: DataFrame, quotes: DataFrame, *, tolerance: str = "2s", horizons: tuple[str, ...] = ("1s", "5s", "60s")) -> DataFrame:
    """Each trade's effective spread against the last mid strictly before it, and realized spread and impact at each horizon, in bps."""
    require(trades, ["venue", "ticker", "ts", "price", "aggressor"])
    mids = quoted(quotes).select("venue", "ticker", F.col("ts").alias("quote_ts"), "mid")
    by = ["venue", "ticker"]
    out = asof(trades, mids, "ts", "quote_ts", by, tolerance=tolerance, strict=True)
    q = _side()
    out = out.withColumn("effective_bps", 2 * q * F.try_divide(F.col("price") - F.col("mid"), F.col("mid")) * BPS)
    for h in horizons:
        later = mids.select(*by, F.col("quote_ts").alias("_later"), F.col("mid").alias("_mid_later"))
        out = asof(out.withColumn(f"known_ts_{h}", C.plus(F.col("ts"), h)), later, f"known_ts_{h}", "_later", by)
        realized = 2 * q * F.try_divide(F.col("price") - F.col("_mid_later"), F.col("mid")) * BPS
        out = out.withColumns({f"realized_bps_{h}": realized, f"impact_bps_{h}": F.col("effective_bps") - realized}).drop("_later", "_mid_later")
    return out


def flow(trades: DataFrame, every: str = "1m") -> DataFrame:
    """Signed flow per bucket: notional bought and sold, imbalance, last price, and the return from the bucket just before."""
    require(trades, ["ticker", "ts", "price", "size", "aggressor"])
    keys = [c for c in ("venue", "ticker") if c in trades.columns]
    value = F.col("price") * F.col("size")
    out = trades.groupBy(*keys, C.bucket(F.col("ts"), every).alias("_b")).agg(
        F.coalesce(F.sum(F.when(F.col("aggressor") == "bid", value)), F.lit(0.0)).alias("buy"), F.coalesce(F.sum(F.when(F.col("aggressor") == "ask", value)), F.lit(0.0)).alias("sell"),
        F.max_by("price", C.tick_order(trades)).alias("last"), F.count(F.lit(1)).alias("trades"),
    ).withColumnRenamed("_b", "ts")
    w = W.partitionBy(*keys).orderBy("ts")
    adjacent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) == micros(every)
    net, total = F.col("buy") - F.col("sell"), F.col("buy") + F.col("sell")
    return out.withColumns({"flow": net, "traded": total, "imbalance": F.try_divide(net, total), "return_bps": F.when(adjacent, F.ln(F.try_divide(F.col("last"), F.lag("last").over(w))) * BPS)})


def ofi(quotes: DataFrame, every: str = "10s", *, max_gap_us: int = 5_000_000) -> DataFrame:
    """Order-flow imbalance per bucket: changes of the best queues; no term across a crossed book or a gap."""
    require(quotes, ["venue", "ticker", "ts", "bid_px", "ask_px", "bid_sz", "ask_sz"])
    w = W.partitionBy("venue", "ticker").orderBy("ts")
    p = {c: F.lag(c).over(w) for c in ("bid_px", "ask_px", "bid_sz", "ask_sz", "ts")}
    rises, falls = F.col("bid_px") >= p["bid_px"], F.col("bid_px") <= p["bid_px"]
    bid = F.when(rises, F.col("bid_sz")).otherwise(0.0) - F.when(falls, p["bid_sz"]).otherwise(0.0)
    ask = F.when(F.col("ask_px") <= p["ask_px"], F.col("ask_sz")).otherwise(0.0) - F.when(F.col("ask_px") >= p["ask_px"], p["ask_sz"]).otherwise(0.0)
    good = (F.col("bid_px") < F.col("ask_px")) & (p["bid_px"] < p["ask_px"]) & (F.unix_micros("ts") - F.unix_micros(p["ts"]) <= max_gap_us)
    rows = quotes.withColumn("_term", F.when(good, bid - ask)).withColumn("_mid", (F.col("bid_px") + F.col("ask_px")) / 2)
    out = rows.groupBy("venue", "ticker", C.bucket(F.col("ts"), every).alias("_b")).agg(
        F.sum("_term").alias("ofi"), F.count("_term").alias("n"), F.avg((F.col("bid_sz") + F.col("ask_sz")) / 2).alias("depth"), F.max_by("_mid", "ts").alias("mid")
    ).withColumnRenamed("_b", "ts")
    b = W.partitionBy("venue", "ticker").orderBy("ts")
    adjacent = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(b)) == micros(every)
    return out.withColumns({"ofi_norm": F.try_divide(F.col("ofi"), F.col("depth")), "return_bps": F.when(adjacent, F.ln(F.try_divide(F.col("mid"), F.lag("mid").over(b))) * BPS)})


def ols(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """slope, se, t, r2, n of a straight line per group, from sums: one pass, one shuffle of partial sums."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("_vx"), F.var_pop(y).alias("_vy"), F.covar_pop(x, y).alias("_c"))
    slope = F.try_divide(F.col("_c"), F.col("_vx"))
    rest = F.greatest(F.col("_vy") - slope * F.col("_c"), F.lit(0.0)) * F.col("n")
    se = F.sqrt(F.try_divide(rest, (F.col("n") - 2) * F.col("n") * F.col("_vx")))
    out = s.withColumns({"slope": slope, "se": F.when(F.col("n") > 2, se), "r2": F.try_divide(F.col("_c") * F.col("_c"), F.col("_vx") * F.col("_vy"))})
    return out.withColumn("t", F.try_divide(F.col("slope"), F.col("se"))).select(*by, "slope", "se", "t", "r2", "n")


def kyle_lambda(flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Slope of a bucket's return in bps on its signed flow in millions."""
    return ols(flows.withColumn("_m", F.col("flow") / 1e6), "return_bps", "_m", by or ["ticker"])


def amihud(flows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of |return| per million traded."""
    return flows.where(F.col("return_bps").isNotNull() & (F.col("traded") > 0)).groupBy(*(by or ["ticker"])).agg(F.avg(F.abs("return_bps") / (F.col("traded") / 1e6)).alias("amihud"), F.count(F.lit(1)).alias("n"))


def shocks(flows: DataFrame, share: float = 0.001) -> DataFrame:
    """Buckets whose |flow| reaches the upper ``share`` of their ticker's day (the next larger value where the rank falls between two).

    The rank is found by counting in a window per ticker and day, so no array of a day's values is built.
    """
    keys = [c for c in ("venue", "ticker") if c in flows.columns]
    day = W.partitionBy(*keys, F.to_date("ts"))
    size = F.abs("flow")
    above = F.count(F.lit(1)).over(day.orderBy(size.desc()).rangeBetween(W.unboundedPreceding, 0)) - F.count(F.lit(1)).over(day.orderBy(size.desc()).rangeBetween(0, 0))
    n = F.count(F.lit(1)).over(day)
    # the quantile is the value at 0-based rank ceil((1 - share)(n - 1)); a value reaches it if fewer than n - rank values are larger
    return flows.where(F.col("flow").isNotNull()).withColumn("_above", above).withColumn("_n", n).where(F.col("_above") < F.col("_n") - F.ceil(F.lit(1 - share) * (F.col("_n") - 1))).drop("_above", "_n")


def spreads(bars: DataFrame, estimator: str, every: str) -> DataFrame:
    """ticker, ts, n, spread_bps: Roll, Corwin-Schultz or Abdi-Ranaldo spread per bucket over contiguous pairs of bars.

    A negative variance of the spread is none: Roll's is then null, the others are 0, as is usual for each.
    """
    one_of("estimator", estimator, ("roll", "corwin_schultz", "abdi_ranaldo"))
    require(bars, ["ticker", "ts", "close_ts", "open", "high", "low", "close"])
    w = C.by_ticker()
    lag = lambda c: F.lag(c).over(w)
    ok = C.contiguous()
    rows = bars.where((F.col("low") > 0) & (F.col("close") > 0)).withColumn("_b", C.bucket(F.col("ts"), every))
    if estimator == "roll":
        d = F.when(ok, F.ln(F.col("close")) - F.ln(lag("close")))
        rows = rows.withColumn("_d", d).withColumn("_p", F.when(ok & (lag("_b") == F.col("_b")), lag("_d")))
        out = rows.where("_d is not null and _p is not null").groupBy("ticker", "_b").agg(F.count(F.lit(1)).alias("n"), F.covar_samp("_d", "_p").alias("_c"))
        value = F.when(F.col("_c") < 0, 2 * F.sqrt(-F.col("_c")))
    elif estimator == "corwin_schultz":
        k = 3 - 2 * math.sqrt(2)
        beta = F.pow(F.ln(F.col("high") / F.col("low")), 2) + F.pow(F.ln(lag("high") / lag("low")), 2)
        gamma = F.pow(F.ln(F.greatest(F.col("high"), lag("high")) / F.least(F.col("low"), lag("low"))), 2)
        alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
        s = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
        out = rows.withColumn("_s", F.when(ok, F.greatest(s, F.lit(0.0)))).where("_s is not null").groupBy("ticker", "_b").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("_c"))
        value = F.col("_c")
    else:
        eta = (F.ln("high") + F.ln("low")) / 2
        rows = rows.withColumns({"_c0": F.ln("close"), "_eta": eta})
        x = 4 * (lag("_c0") - lag("_eta")) * (lag("_c0") - F.col("_eta"))
        out = rows.withColumn("_s", F.when(ok, x)).where("_s is not null").groupBy("ticker", "_b").agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("_c"))
        value = F.sqrt(F.greatest(F.col("_c"), F.lit(0.0)))
    return out.select("ticker", F.col("_b").alias("ts"), "n", (value * BPS).alias("spread_bps"))


def resilience(book: DataFrame, events: DataFrame, *, horizon: int = 60) -> DataFrame:
    """Per event: depth before, smallest ratio of depth after it, seconds to recover, largest spread, over ``horizon`` seconds.

    book: ticker, ts (whole seconds), depth, spread_bps.  events: ticker, ts.  Each event's seconds are made and joined by equality.
    """
    require(book, ["ticker", "ts", "depth", "spread_bps"])
    steps = events.select("ticker", F.col("ts").alias("event_ts"), F.explode(F.sequence(F.lit(-1), F.lit(horizon))).alias("k"))
    grid = steps.withColumn("ts", F.timestamp_micros(F.unix_micros("event_ts") + F.col("k").cast("long") * 1_000_000))
    seen = grid.join(book.select("ticker", "ts", "depth", "spread_bps"), ["ticker", "ts"], "left")
    pre = F.max(F.when(F.col("k") == -1, F.col("depth"))).over(W.partitionBy("ticker", "event_ts"))
    seen = seen.withColumn("pre_depth", pre).withColumn("ratio", F.try_divide(F.col("depth"), F.col("pre_depth")))
    after = F.col("k") >= 0
    return seen.groupBy("ticker", "event_ts").agg(
        F.max("pre_depth").alias("pre_depth"), F.min(F.when(after, F.col("ratio"))).alias("min_ratio"), F.min(F.when(after & (F.col("ratio") >= 1), F.col("k"))).alias("recovered_s"), F.max(F.when(after, F.col("spread_bps"))).alias("spread_peak_bps")
    )


def resilience_curve(book: DataFrame, events: DataFrame, *, horizon: int = 60) -> DataFrame:
    """The median depth ratio at each second after an event."""
    steps = events.select("ticker", F.col("ts").alias("event_ts"), F.explode(F.sequence(F.lit(-1), F.lit(horizon))).alias("k"))
    grid = steps.withColumn("ts", F.timestamp_micros(F.unix_micros("event_ts") + F.col("k").cast("long") * 1_000_000))
    seen = grid.join(book.select("ticker", "ts", "depth"), ["ticker", "ts"], "left")
    pre = F.max(F.when(F.col("k") == -1, F.col("depth"))).over(W.partitionBy("ticker", "event_ts"))
    return seen.withColumn("ratio", F.try_divide(F.col("depth"), pre)).where("k >= 0").groupBy("k").agg(F.median("ratio").alias("median_ratio"), F.count("ratio").alias("n"))


def cost_of_size(depth: DataFrame, sizes: tuple[float, ...]) -> DataFrame:
    """The mean distance in bps an order of each size walks on a cumulative depth curve, linear between its points.

    depth: key columns, distance_bps, cumulative (growing with distance).  ``beyond``: the size passes the last point, and is costed to it.
    """
    require(depth, ["distance_bps", "cumulative"])
    keys = [c for c in depth.columns if c not in ("distance_bps", "cumulative")]
    w = W.partitionBy(*keys).orderBy("distance_bps")
    seg = depth.withColumns({"_d0": F.coalesce(F.lag("distance_bps").over(w), F.lit(0.0)), "_q0": F.coalesce(F.lag("cumulative").over(w), F.lit(0.0))})
    seg = seg.withColumn("size", F.explode(F.array(*[F.lit(float(s)) for s in sizes])))
    top = F.least(F.col("size"), F.col("cumulative"))
    part = F.greatest(top - F.col("_q0"), F.lit(0.0))
    at = F.col("_d0") + F.coalesce(F.try_divide(part, F.col("cumulative") - F.col("_q0")), F.lit(0.0)) * (F.col("distance_bps") - F.col("_d0"))
    out = seg.groupBy(*keys, "size").agg(F.sum(part * (F.col("_d0") + at) / 2).alias("_cost"), F.sum(part).alias("_done"), F.max("cumulative").alias("_all"))
    return out.select(*keys, "size", F.try_divide(F.col("_cost"), F.col("_done")).alias("cost_bps"), (F.col("size") > F.col("_all")).alias("beyond"))


def allocate(total: float, weights: list[float]) -> list[float]:
    if total < 0 or not weights or min(weights) < 0 or sum(weights) <= 0:
        raise Refused("nothing to allocate by")
    return [total * w / sum(weights) for w in weights]


def schedule_cost(plan: DataFrame, depth: DataFrame, *, slices: int = 60) -> DataFrame:
    """Cost in money of orders sliced evenly within their hours: slices·child²/depth·50 bps, and hours whose child passes the depth."""
    require(plan, ["ticker", "ts", "notional"])
    require(depth, ["ticker", "ts", "depth"])
    child = F.abs("notional") / slices
    rows = plan.join(depth.select("ticker", "ts", "depth"), ["ticker", "ts"], "left")
    return rows.groupBy("ticker").agg(F.sum(slices * child * F.try_divide(child, F.col("depth")) * F.lit(50 / BPS)).alias("cost"), F.sum((child > F.col("depth")).cast("long")).alias("over_depth"), F.sum(F.abs("notional")).alias("notional"))
