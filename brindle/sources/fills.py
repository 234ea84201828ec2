"""A venue's fills as lines of JSON: trades, one-minute bars and the archive's gaps, by DataFrame operations.

Three shapes of line are known: a trade; a pair of an address and a fill; a block with its pairs.  A trade is the taker's fill among the two
that share a coin and a number.  Lines are read as text (plain or gzip; LZ4 frames have to be unpacked first), so files are split as any text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.refuse import micros, require

FILL = "struct<coin:string,px:string,sz:string,side:string,time:bigint,crossed:boolean,tid:bigint,liquidation:string>"
TRADE = "struct<coin:string,px:string,sz:string,side:string,time:string,trade_dir_override:string,side_info:string>"
#: What a trade's override says of it, and the step between trades from which the archive was silent.
ORDINARY, LIQUIDATED, NOT_COUNTED = "Na", "LiquidatedMarket", "NetChildVaultPositions"
LIQUIDATED_AS_OBJECT = r'^\{"Liquidated(Cross|Isolated)":"[AB]"\}$'
SILENCE = "10s"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, value: the lines of every file under ``path``; ``seq`` is their order within a file."""
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("seq"), "value").where("trim(value) <> ''")


def parsed(rows: DataFrame) -> DataFrame:
    """file, seq, coin, ts, price, size, taker_buy, liquidation, crossed, tid, counted, problem: a row per fill or trade; a line or field that isn't known has a problem and no values."""
    require(rows, ["file", "seq", "value"])
    text = F.trim("value")
    is_pair, block = text.startswith("["), F.from_json(text, "struct<events:array<array<string>>,side_info:string>")
    pairs = F.when(is_pair, F.array(F.from_json(text, "array<string>"))).when(block["events"].isNotNull(), block["events"])
    is_trade = ~is_pair & block["side_info"].isNotNull()
    fills = rows.select("file", "seq", F.explode(F.when(F.size(pairs) > 0, pairs)).alias("_pair")).select("file", "seq", F.from_json(F.element_at("_pair", 2), FILL).alias("f"))
    sided = lambda c: F.when(c == "B", F.lit(True)).when(c == "A", F.lit(False))
    time = F.timestamp_millis("f.time")
    one = fills.select("file", "seq", F.col("f.coin").alias("coin"), time.alias("ts"), F.expr("try_cast(f.px as double)").alias("price"), F.expr("try_cast(f.sz as double)").alias("size"), sided(F.col("f.side")).alias("taker_buy"), F.col("f.liquidation").isNotNull().alias("liquidation"), F.col("f.crossed").alias("crossed"), F.col("f.tid").alias("tid"), F.lit(True).alias("counted"))
    t = rows.where(is_trade).select("file", "seq", F.from_json(F.trim("value"), TRADE).alias("f"))
    how = F.regexp_replace("f.trade_dir_override", r"\s", "")
    known = how.isin(ORDINARY, LIQUIDATED, NOT_COUNTED) | how.rlike(LIQUIDATED_AS_OBJECT)
    two = t.select("file", "seq", F.col("f.coin").alias("coin"), F.expr("try_to_timestamp(f.time)").alias("ts"), F.expr("try_cast(f.px as double)").alias("price"), F.expr("try_cast(f.sz as double)").alias("size"), F.when(known, sided(F.col("f.side"))).alias("taker_buy"), (how != ORDINARY).alias("liquidation"), F.lit(True).alias("crossed"), F.lit(None).cast("long").alias("tid"), (how != NOT_COUNTED).alias("counted"))
    read = one.unionByName(two)
    whole = F.col("ts").isNotNull() & F.col("price").isNotNull() & F.col("size").isNotNull() & F.col("taker_buy").isNotNull() & F.col("coin").isNotNull() & F.col("crossed").isNotNull()
    read = read.withColumn("problem", F.when(~F.coalesce(whole, F.lit(False)), F.lit("unparsed")))
    odd = rows.where(~F.coalesce(is_trade | (F.size(pairs) >= 0), F.lit(False))).select("file", "seq", F.lit("unparsed").alias("problem"))
    return read.unionByName(odd, allowMissingColumns=True)


def failed(fills: DataFrame) -> DataFrame:
    """file, cause of the files that can't be trusted: with a line that isn't known, or a trade without exactly one taker."""
    bad = fills.where("problem is not null").select("file", F.col("problem").alias("cause"))
    takers = fills.where("problem is null and tid is not null").groupBy("file", "coin", "tid").agg(F.sum(F.col("crossed").cast("int")).alias("_n")).where("_n <> 1")
    return bad.unionByName(takers.select("file", F.lit("unparsed").alias("cause"))).groupBy("file").agg(F.min("cause").alias("cause"))


def trades(fills: DataFrame, coins: dict[str, str]) -> DataFrame:
    """file, ticker, ts, price, size, taker_buy, liquidation, seq of the counted trades of ``coins`` (the venue's name -> ticker) in files that have not failed."""
    name = F.create_map(*[F.lit(x) for pair in coins.items() for x in pair])
    good = fills.join(failed(fills), "file", "left_anti").where(F.col("coin").isin(list(coins)) & F.col("counted"))
    taker = F.when(F.col("crossed"), F.struct("ts", "price", "size", "taker_buy", "seq"))
    paired = good.where("tid is not null").groupBy("file", "coin", "tid").agg(F.max(taker).alias("_t"), F.max("liquidation").alias("liquidation")).select("file", "coin", "_t.*", "liquidation")
    alone = good.where("tid is null").select("file", "coin", "ts", "price", "size", "taker_buy", "seq", "liquidation")
    return paired.unionByName(alone).select("file", name[F.col("coin")].alias("ticker"), "ts", "price", "size", "taker_buy", "liquidation", "seq")


def minute_bars(trades_: DataFrame) -> DataFrame:
    """Bars of traded minutes as the venue draws them: every trade counts, but prices of liquidations only in ``high_all`` and ``low_all``, unless there is no other."""
    order, price = F.struct("ts", "file", "seq"), F.col("price")
    ordinary = F.when(~F.col("liquidation"), price)
    out = trades_.groupBy("ticker", F.date_trunc("minute", "ts").alias("_m")).agg(
        F.min_by("price", order).alias("open"), F.max(ordinary).alias("_high"), F.min(ordinary).alias("_low"), F.max_by("price", order).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.sum(price * F.col("size")).alias("notional"), F.coalesce(F.sum(F.when(F.col("taker_buy"), F.col("size"))), F.lit(0.0)).alias("taker_buy_volume"), F.sum(F.col("liquidation").cast("long")).alias("liquidations"), F.max("price").alias("high_all"), F.min("price").alias("low_all"),
    )
    return out.select("ticker", F.col("_m").alias("ts"), (F.col("_m") + F.expr("INTERVAL 1 MINUTE")).alias("close_ts"), "open", F.coalesce("_high", "high_all").alias("high"), F.coalesce("_low", "low_all").alias("low"), "close", "volume", "trade_count", "notional", "taker_buy_volume", "liquidations", "high_all", "low_all")


def silences(fills: DataFrame, hours: DataFrame) -> DataFrame:
    """from_ts, to_ts, cause: steps of SILENCE or more between trades of any coin within the hours (ts) that were read; an hour's ends count as trades.

    Seconds are told apart first, so the ordered rows are few; hours are windows of their own, and steps that meet at an hour's edge or at a lone trade are joined.
    """
    hour = F.date_trunc("hour", "ts")
    points = fills.where("problem is null").select(hour.alias("h"), "ts").distinct().join(hours.select(F.col("ts").alias("h")), "h", "left_semi")
    edges = hours.select(F.col("ts").alias("h"), F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    w = W.partitionBy("h").orderBy("ts")
    steps = points.unionByName(edges).distinct().withColumn("to_ts", F.lead("ts").over(w)).where(F.unix_micros("to_ts") - F.unix_micros("ts") >= micros(SILENCE))
    # silences are rare, so one window over them is small
    one = W.partitionBy(F.lit(0)).orderBy("ts")
    runs = steps.withColumn("_new", F.coalesce((F.lag("to_ts").over(one) != F.col("ts")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(one))
    return runs.groupBy("_run").agg(F.min("ts").alias("from_ts"), F.max("to_ts").alias("to_ts")).select("from_ts", "to_ts", F.lit("archive-silent").alias("cause"))


def day_of_bars(bars: DataFrame, gaps: DataFrame) -> DataFrame:
    """Bars that no gap (from_ts, to_ts) overlaps: a minute with trades missing is no bar.  Gaps are spread over the hours that they touch, so the join is on equal hours."""
    touched = gaps.select("from_ts", "to_ts", F.explode(F.sequence(F.date_trunc("hour", "from_ts"), F.date_trunc("hour", "to_ts"), F.expr("INTERVAL 1 HOUR"))).alias("_h"))
    b = bars.withColumn("_h", F.date_trunc("hour", "ts"))
    return b.join(touched, (b["_h"] == touched["_h"]) & (b["ts"] < touched["to_ts"]) & (b["close_ts"] > touched["from_ts"]), "left_anti").drop("_h")
