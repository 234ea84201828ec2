"""As-of joins as a union and a window per key and day: each left row sees the last right row at or before it.

Both sides are unioned, sorted once per key and UTC day, and the newest right row is carried forward; no range comparison.  What a day begins with is the last
right row of the days before: a row per key and day, carried forward on its own and joined back on equal keys.  So a key's whole history never
lies in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.refuse import Refused, micros, require

DAY = 86_400_000_000


def asof(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], *, tolerance: str | int | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row whose ``right_on`` is at or (``strict``) before ``left_on``.

    Right rows at one instant must be one row per key or interchangeable.  A match older than ``tolerance`` (inclusive) is null.
    Null keys match null keys.
    """
    require(left, [*by, left_on])
    require(right, [*by, right_on])
    values = [c for c in right.columns if c not in by]
    clash = [c for c in values if c in left.columns]
    if clash:
        raise Refused(f"both sides have {', '.join(clash)}")
    # at one instant a right row comes before a left one, or after it if the match is strict
    l = left.select(F.struct(*left.columns).alias("_left"), *by, F.col(left_on).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))  # noqa: E741
    r = right.where(F.col(right_on).isNotNull()).select(F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), *by, F.col(right_on).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_right"))
    day = F.floor(F.unix_micros("_at") / DAY)
    l, r = l.withColumn("_day", day), r.withColumn("_day", day)  # noqa: E741
    w = W.partitionBy(*by, "_day").orderBy(F.col("_at").asc_nulls_first(), "_side").rowsBetween(W.unboundedPreceding, 0)
    carried = l.unionByName(r).withColumn("_right", F.last("_right", ignorenulls=True).over(w)).where("_left is not null")
    # the last right row before each day that has left rows
    days = l.select(*by, "_day").distinct().withColumn("_last", F.lit(None).cast(l.schema["_right"].dataType)).unionByName(r.groupBy(*by, "_day").agg(F.max_by("_right", "_at").alias("_last")))
    held = days.groupBy(*by, "_day").agg(F.first("_last", ignorenulls=True).alias("_last"))  # one of the two is there, or none
    before = held.withColumn("_before", F.last("_last", ignorenulls=True).over(W.partitionBy(*by).orderBy(F.col("_day").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)))
    before = before.where("_before is not null").select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*by, "_day"))], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*by, "_day"))]
    carried = carried.join(before, reduce(and_, same), "left").withColumn("_right", F.coalesce("_right", "_before")).drop("_before", *[f"_k{i}" for i in range(len(by) + 1)])
    if tolerance is not None:
        fresh = F.unix_micros("_at") - F.unix_micros(F.col(f"_right.{right_on}")) <= F.lit(micros(tolerance))
        carried = carried.withColumn("_right", F.when(fresh, F.col("_right")))
    return carried.select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in values])


def join_recv(left: DataFrame, right: DataFrame, *, tolerance: str | None = "5s") -> DataFrame:
    """Each venue-timed row with the latest receipt-timed one received by its time, per venue and ticker; columns become ``<name>_recv``."""
    require(left, ["venue", "ticker", "ts"])
    require(right, ["venue", "ticker", "recv_ts"])
    if "ts" in right.columns:
        raise Refused("right has a venue clock, ts")
    names = {c: f"{c}_recv" for c in right.columns if c not in ("venue", "ticker", "recv_ts")} | {"recv_ts": "matched_recv_ts"}
    return asof(left, right.withColumnsRenamed(names), "ts", "matched_recv_ts", ["venue", "ticker"], tolerance=tolerance)
