"""Parsers of exchanges' archive files: zipped or gzipped CSV and order-book messages, read as binary files and parsed where they lie."""

from __future__ import annotations

import gzip
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.refuse import Refused

TRADES = "name string, ts timestamp, price double, size double, aggressor string, trade_id string"
BOOK = "name string, ts timestamp, bid_px double, ask_px double, bid_sz double, ask_sz double, bid_depth_10 double, ask_depth_10 double"
BARS = "name string, ts timestamp, open double, high double, low double, close double, volume double, trade_count long"


def unpack(blob: bytes, name: str) -> bytes:
    """The one file in a zip, or what a gzip holds."""
    if name.endswith(".gz"):
        return gzip.decompress(blob)
    if not name.endswith(".zip"):
        return blob
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        if len(z.namelist()) != 1:
            raise Refused(f"{name} holds {len(z.namelist())} files, not one")
        return z.read(z.namelist()[0])


def table(text: bytes, columns: list[str]) -> pd.DataFrame:
    """A CSV as text; a first line that doesn't begin with a number is a header."""
    head = not (text[:1].isdigit() or text[:1] == b"-")
    return pd.read_csv(io.BytesIO(text), header=0 if head else None, names=columns, usecols=range(len(columns)), dtype=str)


def _times(values: pd.Series, unit_us: int, name: str) -> pd.Series:
    t = pd.to_datetime(pd.to_numeric(values) * unit_us, unit="us")
    if len(t) and not (2010 <= t.min().year and t.max().year < 2100):
        raise Refused(f"{name}: its times aren't in the unit this parser reads")
    return t


def aggregate_trades(text: bytes, name: str) -> pd.DataFrame:
    """Trades with milliseconds and a buyer-is-maker flag: if the buyer made the market, the seller crossed."""
    raw = table(text, ["id", "price", "size", "first", "last", "time", "maker"])
    side = raw["maker"].str.lower().map({"true": "ask", "false": "bid"})
    return pd.DataFrame({"name": name, "ts": _times(raw["time"], 1000, name), "price": raw["price"].astype(float), "size": raw["size"].astype(float), "aggressor": side, "trade_id": raw["id"]}).sort_values("ts", kind="stable")


def timed_trades(text: bytes, name: str) -> pd.DataFrame:
    """Trades with seconds as decimal text, a side in words, and rows that may be newest first."""
    raw = table(text, ["time", "symbol", "side", "size", "price", "tick", "id"])
    whole, _, part = (raw["time"].str.partition(".")[i] for i in range(3))
    us = pd.to_numeric(whole) * 1_000_000 + pd.to_numeric(part.str.ljust(6, "0").str[:6].replace("", "0"))
    side = raw["side"].str.lower().map({"buy": "bid", "sell": "ask"})
    if side.isna().any():
        raise Refused(f"{name}: a side is neither buy nor sell")
    out = pd.DataFrame({"name": name, "ts": _times(us, 1, name), "price": raw["price"].astype(float), "size": raw["size"].astype(float), "aggressor": side, "trade_id": raw["id"]})
    return (out[::-1] if len(out) > 1 and out["ts"].iloc[0] > out["ts"].iloc[-1] else out).sort_values("ts", kind="stable")


def contract_trades(text: bytes, name: str, contract: float = 1.0) -> pd.DataFrame:
    """Trades with named columns, milliseconds, the taker's side in words of either case, and sizes in contracts; a number that repeats is refused, as it doesn't say who crossed."""
    raw = pd.read_csv(io.BytesIO(text), dtype=str, skipinitialspace=True).apply(lambda c: c.str.strip())
    if raw["trade_id"].duplicated().any():
        raise Refused(f"{name}: a trade is listed more than once")
    side = raw["side"].str.lower().map({"buy": "bid", "sell": "ask"})
    if side.isna().any():
        raise Refused(f"{name}: a side is neither buy nor sell")
    return pd.DataFrame({"name": name, "ts": _times(raw["created_time"], 1000, name), "price": raw["price"].astype(float), "size": raw["size"].astype(float) * contract, "aggressor": side, "trade_id": raw["trade_id"]}).sort_values("ts", kind="stable")


def klines(text: bytes, name: str) -> pd.DataFrame:
    raw = table(text, ["time", "open", "high", "low", "close", "volume", "end", "quote", "count"])
    return pd.DataFrame({"name": name, "ts": _times(raw["time"], 1000, name), **{c: raw[c].astype(float) for c in ("open", "high", "low", "close", "volume")}, "trade_count": raw["count"].astype("int64")}).sort_values("ts", kind="stable")


def book(text: bytes, name: str) -> pd.DataFrame:
    """Snapshots and deltas replayed to the top and the depth within 10 bps at the end of each second with a message."""
    sides: dict[str, dict[float, float]] = {"b": {}, "a": {}}
    out, now = [], None

    def row() -> None:
        b, a = sides["b"], sides["a"]
        if b and a:
            bid, ask = max(b), min(a)
            mid = (bid + ask) / 2
            out.append((name, datetime.fromtimestamp(now, timezone.utc).replace(tzinfo=None), bid, ask, b[bid], a[ask], sum(p * s for p, s in b.items() if p >= mid * 0.999), sum(p * s for p, s in a.items() if p <= mid * 1.001)))

    for line in text.splitlines():
        if not line.strip():
            continue
        m = json.loads(line)
        second = int(m["ts"]) // 1000
        if now is not None and second != now:
            row()
        now = second
        if m["type"] == "snapshot":
            sides = {"b": {}, "a": {}}
        for side in ("b", "a"):
            for price, size in m["data"].get(side, ()):
                if float(size):
                    sides[side][float(price)] = float(size)
                else:
                    sides[side].pop(float(price), None)
    if now is not None:
        row()
    return pd.DataFrame(out, columns=[c.split()[0] for c in BOOK.split(", ")])


PARSERS = {"aggregate_trades": (aggregate_trades, TRADES), "timed_trades": (timed_trades, TRADES), "contract_trades": (contract_trades, TRADES), "klines": (klines, BARS), "book": (book, BOOK)}


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Every archive file under ``path``, one task per few files: each is unpacked and parsed in a Python worker, never on the driver."""
    if kind not in PARSERS:
        raise Refused(f"kind={kind!r} is not one of {', '.join(PARSERS)}")
    parse, schema = PARSERS[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, blob in zip(f["path"], f["content"]):
                yield parse(unpack(blob, name), name.rsplit("/", 1)[-1])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


_MONTHS = {m: i for i, m in enumerate(("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), 1)}


def rate_decisions(html: str, year: int) -> list[datetime]:
    """UTC times of a central bank's decisions: the last day of each meeting, at 14:00 in New York, from headings like ``January 27-28``."""
    out = []
    for month, first, last in re.findall(r"\b(January|February|March|April|May|June|July|August|September|October|November|December)\s+(\d{1,2})(?:\s*[-–]\s*(\d{1,2}))?", html):
        d = date(year, _MONTHS[month.lower()], int(last or first))
        out.append(datetime(d.year, d.month, d.day, 14, tzinfo=ZoneInfo("America/New_York")).astimezone(timezone.utc))
    return sorted(set(out))


def releases(html: str, name: str) -> list[datetime]:
    """UTC times of a statistics office's releases, at 08:30 in New York, from links like ``archives/cpi_01132021.htm``."""
    days = {datetime.strptime(x, "%m%d%Y") for x in re.findall(rf"archives/{re.escape(name)}_(\d{{8}})\.htm", html)}
    return sorted(d.replace(hour=8, minute=30, tzinfo=ZoneInfo("America/New_York")).astimezone(timezone.utc) for d in days)


def sampled_days(first: date, last: date, rule: str) -> list[date]:
    """Days by a rule: ``every:<n>``, ``weekly:<Mon…>`` or ``monthly:<Mon…>`` (the first such day of a month)."""
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    kind, _, arg = rule.partition(":")
    if kind == "every" and arg.isdigit() and int(arg):
        return days[:: int(arg)]
    names = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
    if kind not in ("weekly", "monthly") or arg not in names:
        raise Refused(f"rule={rule!r}")
    found = [d for d in days if d.weekday() == names.index(arg)]
    return found if kind == "weekly" else [d for d in found if d.day <= 7]


def with_file_day(df: DataFrame) -> DataFrame:
    """``day``: the date that a file's name holds."""
    return df.withColumn("day", F.to_date(F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1)))
