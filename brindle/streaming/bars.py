"""Structured Streaming twins of batch operators: their results over all the data are those of the batch ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.refuse import micros, require


def deduplicated(trades: DataFrame, *, within: str = "15 minutes") -> DataFrame:
    """The first receipt of each trade; a replay that comes later than ``within`` is a new trade."""
    require(trades, ["venue", "ticker", "trade_id", "ts"])
    return trades.withWatermark("ts", within).dropDuplicatesWithinWatermark(["venue", "ticker", "trade_id"])


def bars(trades: DataFrame, interval: str, *, late: str | None = "1 minute") -> DataFrame:
    """OHLCV per interval, put out once the watermark has passed its end; ``late=None`` if ``trades`` has a watermark."""
    require(trades, ["ticker", "ts", "price", "size"])
    span = f"{micros(interval)} microseconds"
    marked = trades if late is None else trades.withWatermark("ts", late)
    out = marked.groupBy("ticker", F.window("ts", span).alias("w")).agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"))
    return out.select("ticker", F.col("w.start").alias("ts"), F.col("w.end").alias("close_ts"), "open", "high", "low", "close", "volume", "trade_count")


def held(signals: DataFrame) -> DataFrame:
    """The position after each row of (ticker, ts, enter, leave): 1 from an entry to an exit, kept as state per ticker.  Rows of a batch are taken in time order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for enter, leave in zip(rows["enter"], rows["leave"]):
            now = 1.0 if enter else 0.0 if leave else now
            out.append(now)
        state.update((now,))
        yield rows[["ticker", "ts"]].assign(position=out)

    return signals.groupBy("ticker").applyInPandasWithState(run, "ticker string, ts timestamp, position double", "position double", "append", "NoTimeout")
