"""Reading a record: one row per event, bars known to be closed, receipt-timed rows collapsed, gaps found and marked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.refuse import Refused, micros, one_of, require


def _one(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """One row per key by an order, with partial aggregation before the shuffle; null keys are a key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last receipt of each key."""
    require(df, [*keys, *order])
    return _one(df, keys, order, F.max_by)


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first receipt of each key."""
    require(df, [*keys, *order])
    return _one(df, keys, order, F.min_by)


def closed(bars: DataFrame, series: list[str], ts: str = "ts") -> DataFrame:
    """Bars that a later bar of their series proves closed."""
    last = bars.groupBy(*series).agg(F.max(ts).alias("_last"))
    return bars.join(last, series).where(F.col(ts) < F.col("_last")).drop("_last")


def candles(raw: DataFrame, *, as_of: Column | None = None, traded_only: bool = True, closed_only: bool = True) -> DataFrame:
    """Bars of ``raw`` (venue, ticker, interval, ts, close_ts, …, trade_count, recv_ts, stream_seq), one row each.

    The latest receipt counts; a bar is closed if the record has a later one; ``as_of`` filters on the close.
    """
    series = ["venue", "ticker", "interval"]
    require(raw, [*series, "ts", "close_ts", "recv_ts", "stream_seq", "trade_count"])
    out = latest(raw, [*series, "ts"], ["recv_ts", "stream_seq"])
    if closed_only:
        out = closed(out, series)
    if traded_only:
        out = out.where("trade_count > 0")
    return out if as_of is None else out.where(F.col("close_ts") <= as_of)


def collapse(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The first of consecutive rows with the same values (nulls equal) per key."""
    require(df, [*keys, *order, *values])
    w = W.partitionBy(*keys).orderBy(*order)
    changed = F.lag(F.lit(True)).over(w).isNull()
    for c in values:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return df.withColumn("_changed", changed).where("_changed").drop("_changed")


def funding_hours(settled: DataFrame) -> DataFrame:
    """One row per hour of each settlement's interval; the settlement hour carries the rate, the others 0.

    settled: venue, ticker, ts, rate, interval_hours.
    """
    require(settled, ["venue", "ticker", "ts", "rate", "interval_hours"])
    hour = F.date_trunc("hour", "ts")
    back = (F.col("interval_hours").cast("long") - 1) * F.lit(3_600_000_000)
    hours = F.explode(F.sequence(F.timestamp_micros(F.unix_micros(hour) - back), hour, F.expr("INTERVAL 1 HOUR")))
    spread = settled.where("interval_hours >= 1").select("venue", "ticker", hour.alias("_settles"), "rate", hours.alias("ts"))
    return spread.groupBy("venue", "ticker", "ts").agg(F.coalesce(F.max(F.when(F.col("ts") == F.col("_settles"), F.col("rate"))), F.lit(0.0)).alias("rate"))


def merged_gaps(gaps: DataFrame, widen: str = "0s") -> DataFrame:
    """Disjoint windows ``lo, hi, causes`` per (venue, ticker): overlapping and touching gaps are one.  gaps: venue, ticker, from_ts, to_ts, cause."""
    require(gaps, ["venue", "ticker", "from_ts", "to_ts", "cause"])
    lo = F.timestamp_micros(F.unix_micros("from_ts") - F.lit(micros(widen)))
    rows = gaps.select("venue", "ticker", lo.alias("lo"), F.col("to_ts").alias("hi"), "cause")
    w = W.partitionBy("venue", "ticker").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (reach.isNull() | (F.col("lo") > reach)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy("venue", "ticker", "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_join(F.array_sort(F.collect_set("cause")), ",").alias("causes")).drop("_run")


def mask_gaps(frame: DataFrame, gaps: DataFrame, dataset: str, *, margin: str = "1s") -> DataFrame:
    """``frame`` with ``in_gap`` and ``gap_cause``, every row kept.

    A tick is in a gap if its time is in [from − margin, to).  A bar (``dataset="candles"``) is if it overlaps the gap and its receipt
    came before the gap's end.  Windows of a series are disjoint, so the last one that starts at or before a row
    is the only one that can hold it: an as-of join, one shuffle, whatever the number of gaps.
    """
    from brindle.operators.asof import asof

    one_of("dataset", dataset, ("candles", "trades", "quotes"))
    bar = dataset == "candles"
    require(frame, ["venue", "ticker", "ts", *(["close_ts", "recv_ts"] if bar else [])])
    if {"in_gap", "gap_cause"} & set(frame.columns):
        raise Refused("the frame is masked already")
    windows = merged_gaps(gaps, margin)
    probe = F.timestamp_micros(F.unix_micros("close_ts") - 1) if bar else F.col("ts")
    out = frame.withColumn("_probe", probe)
    parts = ((["venue", "ticker"], windows.where("ticker is not null"), "own"), (["venue"], windows.where("ticker is null").drop("ticker"), "all"))
    for by, part, name in parts:
        right = part.select(*by, F.col("lo").alias("_at"), F.col("hi").alias(f"_hi_{name}"), F.col("causes").alias(f"_cause_{name}"))
        out = asof(out, right, "_probe", "_at", by).drop("_at")
        hit = F.col(f"_hi_{name}") > F.col("ts")
        if bar:
            hit = hit & (F.col("recv_ts") < F.col(f"_hi_{name}"))
        out = out.withColumn(f"_cause_{name}", F.when(hit, F.col(f"_cause_{name}"))).drop(f"_hi_{name}")
    causes = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.filter(F.array(F.split("_cause_own", ","), F.split("_cause_all", ",")), lambda x: x.isNotNull())))), ",")
    return out.withColumn("gap_cause", F.when(F.col("_cause_own").isNotNull() | F.col("_cause_all").isNotNull(), causes)).withColumn("in_gap", F.col("gap_cause").isNotNull()).drop("_cause_own", "_cause_all", "_probe")


def coverage(manifest: DataFrame) -> DataFrame:
    """first, last, days, days_missing and a count per status for each (kind, venue, ticker).  manifest: kind, venue, ticker, date, status."""
    status = {s: F.sum(F.when(F.col("status") == s, 1).otherwise(0)).alias(s) for s in ("ok", "partial", "absent", "mismatch")}
    out = manifest.groupBy("kind", "venue", "ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.countDistinct("date").alias("days"), *status.values())
    return out.withColumn("days_missing", F.datediff("last", "first") + 1 - F.col("days"))


def compare(left: DataFrame, right: DataFrame, on: list[str], values: list[str], rtol: float = 1e-9) -> DataFrame:
    """A full outer comparison of two sources: ``state`` is left_only, right_only, same or differs."""
    a = left.select(*on, *[F.col(c).alias(f"{c}_left") for c in values], F.lit(True).alias("_l"))
    b = right.select(*on, *[F.col(c).alias(f"{c}_right") for c in values], F.lit(True).alias("_r"))
    same = F.lit(True)
    for c in values:
        x, y = F.col(f"{c}_left"), F.col(f"{c}_right")
        same = same & (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= F.lit(rtol) * F.greatest(F.abs(x), F.abs(y)), F.lit(False)))
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(same, "same").otherwise("differs")
    return a.join(b, on, "full_outer").withColumn("state", state).drop("_l", "_r")
