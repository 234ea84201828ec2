"""Exchange sessions from a table of theirs (date, open_ts, close_ts, in UTC): closures, reopenings, and marks on a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.refuse import require


def closures(sessions: DataFrame) -> DataFrame:
    """Weekdays without a session, between the table's first and last."""
    span = sessions.agg(F.min("date").alias("lo"), F.max("date").alias("hi")).where("lo is not null")
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("date")).where(F.weekday("date") < 5)
    return days.join(sessions.select("date"), "date", "left_anti")


def reopenings(sessions: DataFrame) -> DataFrame:
    """Opens after more than 24 closed hours: over a Saturday and at most 60 hours a weekend, longer a weekend with a holiday, else a holiday."""
    w = W.partitionBy(F.lit(0)).orderBy("open_ts")  # a calendar is a few thousand rows
    rows = sessions.withColumn("closed_from", F.lag("close_ts").over(w)).where("closed_from is not null")
    hours = (F.unix_micros("open_ts") - F.unix_micros("closed_from")) / 3.6e9
    saturday = F.exists(F.sequence(F.to_date("closed_from"), F.to_date("open_ts"), F.expr("INTERVAL 1 DAY")), lambda d: F.weekday(d) == 5)
    kind = F.when(saturday & (hours <= 60), "weekend").when(saturday, "weekend+holiday").otherwise("holiday")
    return rows.where(hours > 24).select("open_ts", "closed_from", hours.alias("closed_hours"), kind.alias("kind"))


def mark_sessions(frame: DataFrame, sessions: DataFrame, zone: str, name: str) -> DataFrame:
    """``frame`` with ``<name>_open`` and ``<name>_closed_day``, by the exchange's local date; Spark broadcasts the calendar if it is as small as calendars are."""
    require(frame, ["ts"])
    s = sessions.select(F.col("date").alias("_d"), F.col("open_ts").alias("_open"), F.col("close_ts").alias("_close"))
    shut = closures(sessions).select(F.col("date").alias("_d"), F.lit(True).alias("_shut"))
    rows = frame.withColumn("_d", F.to_date(F.from_utc_timestamp("ts", zone))).join(s, "_d", "left").join(shut, "_d", "left")
    inside = F.coalesce((F.col("ts") >= F.col("_open")) & (F.col("ts") < F.col("_close")), F.lit(False))
    return rows.withColumns({f"{name}_open": inside, f"{name}_closed_day": F.coalesce("_shut", F.lit(False))}).drop("_d", "_open", "_close", "_shut")
