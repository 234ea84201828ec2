"""Cross-sectional factors and hedged carry: point-in-time membership, scores, weights, and what they earned."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.functions import columns as C
from brindle.operators import indicators as I
from brindle.refuse import Refused, one_of, require

TAKER = 0.0005
BOTH_LEGS = 0.0015
SCORES = ("mom_7", "mom_30", "mom_90", "lowvol", "resmom", "small")


def _settlement_day() -> Column:
    """A settlement at midnight closes the day before."""
    return C.bucket(F.timestamp_micros(F.unix_micros(F.date_trunc("hour", "ts")) - 1), "1d")


def panel(daily: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """ticker, ts, close_ts, close, ret, dollar_volume, bars, funding per daily bar; ret is null after a hole."""
    require(daily, ["ticker", "ts", "close_ts", "close", "volume"])
    one = daily.groupBy("ticker", "ts").agg(F.max_by(F.struct("close_ts", "close", "volume"), "close_ts").alias("_b")).select("ticker", "ts", "_b.*")
    w = C.by_ticker()
    rows = one.select("ticker", "ts", "close_ts", F.col("close").cast("double").alias("close"), F.when(C.contiguous(), C.simple_return()).alias("ret"), (F.col("close") * F.col("volume")).cast("double").alias("dollar_volume"), F.row_number().over(w).alias("bars"))
    if settled is None:
        return rows.withColumn("funding", F.lit(None).cast("double"))
    paid = settled.dropDuplicates(["ticker", "ts"]).groupBy("ticker", _settlement_day().alias("ts")).agg(F.sum("rate").alias("funding"))
    return rows.join(paid, ["ticker", "ts"], "left")


def members(panel_: DataFrame, *, exclude: tuple[str, ...] = (), top: int = 50, history: int = 90, window: int = 30) -> DataFrame:
    """ticker, ts, dv, eligible, traded: the ``top`` by mean dollar volume among those with enough history; ties go to the first name."""
    dv = C.full(window, F.col("dollar_volume"), F.avg("dollar_volume"))
    rows = panel_.select("ticker", "ts", "bars", dv.alias("dv"))
    rows = rows.withColumn("eligible", (F.col("bars") >= history) & F.col("dv").isNotNull() & ~F.col("ticker").isin(list(exclude)))
    rank = F.row_number().over(W.partitionBy("ts").orderBy(F.when(F.col("eligible"), F.col("dv")).desc_nulls_last(), "ticker"))
    return rows.withColumn("traded", F.col("eligible") & (rank <= top)).select("ticker", "ts", "dv", "eligible", "traded")


def scores(panel_: DataFrame, members_: DataFrame, *, market: str) -> DataFrame:
    """ticker, ts and SCORES, each null unless its whole window has returns."""
    m = panel_.where(F.col("ticker") == market).select("ts", F.col("ret").alias("_m"))
    rows = panel_.join(m, "ts", "left")
    grown = lambda c, n: F.exp(C.full(n, F.ln(1 + F.col(c)), F.sum(F.ln(1 + F.col(c))))) - 1
    mean = lambda x: C.full(90, x, F.avg(x))
    rm, r, x = F.col("_m"), F.col("ret"), F.col("ret") * F.col("_m")
    cov, var = mean(x) - mean(r) * mean(rm), C.full(90, rm, F.var_pop(rm))
    rows = rows.withColumns({**{f"mom_{n}": grown("ret", n) for n in (7, 30, 90)}, "lowvol": -C.full(30, r, F.stddev_samp(r)), "_b": F.try_divide(cov, F.nullif(var, F.lit(0.0))), "_m30": grown("_m", 30)})
    rows = rows.withColumn("resmom", F.col("mom_30") - F.col("_b") * F.col("_m30"))
    return rows.join(members_.select("ticker", "ts", (-F.col("dv")).alias("small")), ["ticker", "ts"], "left").select("ticker", "ts", *SCORES)


def rebalances(members_: DataFrame, start: datetime, end: datetime, *, top: int = 50, every: int = 7) -> list[datetime]:
    """The first day with a full traded set, then every ``every`` days: one aggregate, a date comes to the driver."""
    full = members_.where(F.col("traded") & (F.col("ts") >= F.lit(start)) & (F.col("ts") < F.lit(end))).groupBy("ts").count().where(F.col("count") >= top)
    first = full.agg(F.min("ts")).first()[0]
    if first is None:
        raise Refused(f"no day has a traded set of {top}")
    out = []
    stop = end.replace(tzinfo=None) if end.tzinfo else end
    while first < stop:
        out.append(first)
        first += timedelta(days=every)
    return out


def weights(members_: DataFrame, scores_: DataFrame | None, score: str | None, on: list[datetime], side: str, *, fifth: float = 0.2) -> DataFrame:
    """rebalance, ticker, w: the top (and, short, the bottom) fifth by score, or the whole traded set in equal parts."""
    one_of("side", side, ("long_short", "long_only"))
    traded = members_.where("traded").where(F.col("ts").isin(on))
    all_ = W.partitionBy("ts")
    if score is None:
        return traded.select(F.col("ts").alias("rebalance"), "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(all_)).alias("w"))
    rows = traded.join(scores_.select("ticker", "ts", F.col(score).alias("_s")), ["ticker", "ts"]).where("_s is not null and not isnan(_s)")
    n = F.count(F.lit(1)).over(all_)
    k = F.greatest(F.bround(n * fifth, 0).cast("long"), F.lit(1))
    rows = rows.withColumns({"_r": F.row_number().over(all_.orderBy(F.col("_s").desc(), "ticker")), "_n": n, "_k": k})
    top, bottom = F.col("_r") <= F.col("_k"), F.col("_r") > F.col("_n") - F.col("_k")
    w = F.when(top, 1.0 / F.col("_k")) if side == "long_only" else F.when(top, 0.5 / F.col("_k")).when(bottom, -0.5 / F.col("_k"))
    return rows.select(F.col("ts").alias("rebalance"), "ticker", w.alias("w")).where("w is not null")


def portfolio(spark: SparkSession, panel_: DataFrame, w: DataFrame, on: list[datetime], end: datetime, name: str, *, fee: float = TAKER) -> DataFrame:
    """One row a day: weights held from the day after a rebalance to the next one, with funding and turnover cost."""
    stop = end.replace(tzinfo=None) if end.tzinfo else end
    spans = spark.createDataFrame([(a, b) for a, b in zip(on, [*on[1:], stop])], "rebalance timestamp, until timestamp")
    one = F.expr("INTERVAL 1 DAY")
    days = spans.where(F.col("rebalance") + one <= F.col("until")).select("rebalance", F.explode(F.sequence(F.col("rebalance") + one, F.col("until"), one)).alias("ts")).where(F.col("ts") < F.lit(stop))
    held = days.join(w, "rebalance").join(panel_.select("ticker", "ts", "ret", "funding"), ["ticker", "ts"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    day = held.groupBy("ts").agg(F.sum(F.col("w") * zero("ret")).alias("gross"), F.sum(F.col("w") * zero("funding")).alias("funding"), F.sum(F.abs("w")).alias("position"), F.sum((F.col("funding").isNull() & (F.col("w") != 0)).cast("long")).alias("funding_missing"))
    before = spark.createDataFrame(list(zip(on[1:], on)), "rebalance timestamp, _prev timestamp").join(w.select(F.col("rebalance").alias("_prev"), "ticker", F.col("w").alias("_old")), "_prev").drop("_prev")
    turn = w.join(before, ["rebalance", "ticker"], "full_outer").groupBy("rebalance").agg(F.sum(F.abs(zero("w") - zero("_old"))).alias("turnover")).select((F.col("rebalance") + one).alias("ts"), "turnover")
    out = days.select("ts").join(day, "ts", "left").join(turn, "ts", "left").fillna(0.0, ["gross", "funding", "position", "turnover"]).fillna(0, ["funding_missing"])
    cost = F.col("turnover") * fee
    return out.select(F.lit(name).alias("trial"), F.lit("universe").alias("ticker"), "ts", (F.col("ts") + one).alias("close_ts"), "position", F.lit(None).cast("double").alias("bar_return"), "gross", cost.alias("cost"), "funding", (F.col("gross") - cost - F.col("funding")).alias("net"), "turnover", "funding_missing")


def rules(spark: SparkSession, panel_: DataFrame, start: datetime, end: datetime, *, market: str, exclude: tuple[str, ...] = (), top: int = 50, every: int = 7, fee: float = TAKER) -> DataFrame:
    """The equal-weight benchmark and every score on either side."""
    m = members(panel_, exclude=exclude, top=top)
    on, s = rebalances(m, start, end, top=top, every=every), scores(panel_, m, market=market)
    out = portfolio(spark, panel_, weights(m, None, None, on, "long_only"), on, end, "ew universe", fee=fee)
    for score in SCORES:
        for side in ("long_short", "long_only"):
            out = out.unionByName(portfolio(spark, panel_, weights(m, s, score, on, side), on, end, f"{score} {side}", fee=fee))
    return out


def carry_days(premium: DataFrame, settled: DataFrame, minutes: int = 1440) -> DataFrame:
    """ticker, ts, close_ts, premium, funding per whole day that both sides have."""
    p = premium.groupBy("ticker", C.bucket(F.col("ts"), "1d").alias("day")).agg(F.max_by("close", "ts").alias("premium"), F.countDistinct("ts").alias("_n")).where(F.col("_n") == minutes)
    f = settled.dropDuplicates(["ticker", "ts"]).groupBy("ticker", _settlement_day().alias("day")).agg(F.sum("rate").alias("funding"), F.sum("interval_hours").alias("_h")).where("_h = 24")
    return p.join(f, ["ticker", "day"]).select("ticker", F.col("day").alias("ts"), C.plus(F.col("day"), "1d").alias("close_ts"), "premium", "funding")


def carry_returns(days: DataFrame, positions: dict[str, I.Rolling | I.Kernel], *, fee: float = BOTH_LEGS) -> DataFrame:
    """What each hedged position, decided at a day's close, earns the next day: the basis move less cost and funding."""
    rows = I.add(days, **{f"_p_{i}": p for i, p in enumerate(positions.values())})
    pairs = ", ".join(f"'{name}', cast(_p_{i} as double)" for i, name in enumerate(positions))
    rows = rows.select("ticker", "ts", "close_ts", "premium", "funding", F.expr(f"stack({len(positions)}, {pairs}) as (trial, _p)"))
    w = W.partitionBy("trial", "ticker").orderBy("ts")
    before = F.lag("premium").over(w)
    rows = rows.withColumns({"_held": F.lag("_p").over(w), "_next": C.contiguous(w), "_basis": F.try_divide(F.col("premium") - before, 1 + before)})
    rows = rows.withColumn("_turn", F.abs(F.col("_held") - F.coalesce(F.lag("_held").over(w), F.lit(0.0))))
    on = lambda x: F.when(F.col("_next"), x)
    gross, cost, paid = on(F.col("_held") * F.col("_basis")), on(F.col("_turn") * fee), on(F.col("_held") * F.col("funding"))
    return rows.select("trial", "ticker", "ts", "close_ts", F.col("_held").alias("position"), on(F.col("_basis")).alias("bar_return"), gross.alias("gross"), cost.alias("cost"), paid.alias("funding"), (gross - cost - paid).alias("net"))


def carry_rules(days: DataFrame, *, lookbacks: tuple[int, ...] = (1, 7, 30), hurdles: tuple[float, ...] = (0.0, 0.0003), sides: tuple[str, ...] = ("both", "short_only"), fee: float = BOTH_LEGS) -> DataFrame:
    """Always short, and against the mean funding of each lookback where it is beyond each hurdle."""

    def rule(n: int, h: float, side: str) -> I.Rolling:
        def of(w):
            f = C.full(n, F.col("funding"), F.avg("funding"), w)
            beyond = F.abs(f) > h if side == "both" else f > h
            return F.when(f.isNotNull(), F.when(beyond, -F.signum(f)).otherwise(F.lit(0.0)))

        return of

    found = {f"carry {n} {h:g} {side}": rule(n, h, one_of("side", side, ("both", "short_only"))) for side in sides for n in lookbacks for h in hurdles}
    return carry_returns(days, {"always": lambda w: F.lit(-1.0), **found}, fee=fee)


def persistence(days: DataFrame) -> DataFrame:
    """n and lag-one autocorrelation of funding per ticker over contiguous days, from sums."""
    rows = days.select("ticker", "funding", F.when(C.contiguous(), F.lag("funding").over(C.by_ticker())).alias("_lag")).where("_lag is not null")
    s = rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("funding", "_lag").alias("_c"), F.stddev_pop("funding").alias("_a"), F.stddev_pop("_lag").alias("_b"))
    return s.select("ticker", "n", F.try_divide(F.col("_c"), F.nullif(F.col("_a") * F.col("_b"), F.lit(0.0))).alias("rho"))
