"""What public archives of exchanges hold: instruments, first days, and the addresses of their files.  No network: names in, names out."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from urllib.parse import quote

from brindle.refuse import Refused, one_of


@dataclass(frozen=True)
class Instrument:
    """A venue's name for a ticker, the first day that its archive has it, and the base units in one unit of its sizes."""

    symbol: str
    listed: date
    contract: float = 1.0


# Venues, their listings and archives, as published.
PERPETUALS, LINEAR, SWAPS, FILLS = "binance-um", "bybit-linear", "okx-swap", "hyperliquid-s3"
LISTINGS = {
    PERPETUALS: "BTC=BTCUSDT@2019-12-31 ETH=ETHUSDT@2019-12-31 HYPE=HYPEUSDT@2025-05-30 GOLD=XAUUSDT@2025-12-11",
    LINEAR: "BTC=BTCUSDT@2020-03-25 ETH=ETHUSDT@2020-10-21 HYPE=HYPEUSDT@2024-12-04 GOLD=XAUUSDT@2026-03-09",
    SWAPS: "BTC=BTC-USDT-SWAP@2021-10-01 ETH=ETH-USDT-SWAP@2021-10-01",
    FILLS: "BTC=BTC@2025-03-22 ETH=ETH@2025-03-22 HYPE=HYPE@2025-03-22 XYZ100=xyz:XYZ100@2025-10-13 NVDA=xyz:NVDA@2025-11-12 GOLD=xyz:GOLD@2025-12-22 SILVER=xyz:SILVER@2025-12-26 CL=xyz:CL@2026-01-06 SKHX=xyz:SKHX@2026-02-19 BRENTOIL=xyz:BRENTOIL@2026-03-04 SP500=xyz:SP500@2026-03-18",
}
CONTRACTS = {(SWAPS, "BTC"): 0.01, (SWAPS, "ETH"): 0.1}
#: Perpetuals of any base asset, but for names that mean other markets in the record.
ANY_BASE, OTHER_MARKETS, FIRST_PERPETUAL = re.compile(r"[^\s/\\.]{1,30}"), frozenset({"CL", "XYZ100"}), date(2019, 9, 1)
ARCHIVES = {
    PERPETUALS: {"depth": date(2023, 1, 1), "trades": date(2019, 12, 31), "candles": date(2019, 12, 31), "funding": date(2020, 1, 1), "premium": date(2020, 1, 1), "daily": date(2019, 9, 1)},
    LINEAR: {"trades": date(2020, 3, 25), "book": date(2023, 1, 18)},
    SWAPS: {"trades": date(2021, 11, 1)},
    FILLS: {"candles": date(2025, 3, 22)},
}
#: The first instant that each format of fills is read for.
FORMATS = ((datetime(2025, 3, 22, 10, tzinfo=timezone.utc), "node_trades"), (datetime(2025, 5, 25, 14, 32, 53, 109000, timezone.utc), "node_fills"), (datetime(2025, 7, 27, 8, 50, 10, 273000, timezone.utc), "node_fills_by_block"))
PERPETUAL_FILES = "https://data.binance.vision/data/futures/um"
FILE_KINDS = {"depth": "bookDepth", "trades": "aggTrades", "candles": "klines", "funding": "fundingRate", "premium": "premiumIndexKlines", "daily": "klines"}
PERPETUAL_LISTING = "https://s3-ap-northeast-1.amazonaws.com/data.binance.vision"
MONTHLY_FOLDERS = {"funding": "data/futures/um/monthly/fundingRate/", "daily": "data/futures/um/monthly/klines/"}
LINEAR_TRADES, LINEAR_BOOKS, SHALLOW_BOOKS_FROM = "https://public.bybit.com/trading", "https://quote-saver.bycsi.com/orderbook/linear", date(2025, 8, 21)
SWAP_TRADES = "https://static.okx.com/cdn/okex/traderecords/trades/daily"


def _listed(venue: str) -> dict[str, Instrument]:
    out = {}
    for entry in LISTINGS[venue].split():
        ticker, rest = entry.split("=")
        symbol, day = rest.split("@")
        out[ticker] = Instrument(symbol, date.fromisoformat(day), CONTRACTS.get((venue, ticker), 1.0))
    return out


def instrument(venue: str, ticker: str) -> Instrument:
    """A venue's listing of a ticker; what it has is named if it has it not."""
    one_of("venue", venue, tuple(LISTINGS))
    held = _listed(venue)
    if ticker in held:
        return held[ticker]
    if venue == PERPETUALS and ticker not in OTHER_MARKETS and ANY_BASE.fullmatch(ticker):
        return Instrument(f"{ticker}USDT", FIRST_PERPETUAL)
    raise Refused(f"{venue} has no {ticker!r}; it has {', '.join(sorted(held))}")


def first_day(venue: str, kind: str, ticker: str) -> date:
    """The later of the listing and the beginning of the archive."""
    listed = instrument(venue, ticker).listed
    return max(listed, ARCHIVES[venue][one_of("kind", kind, tuple(ARCHIVES[venue]))])


def archive_days(venue: str, day: date) -> list[date]:
    """The files' dates that hold one UTC day: swaps' files end eight hours early."""
    return [day, day + timedelta(days=1)] if venue == SWAPS else [day]


def format_at(instant: datetime) -> str | None:
    """The format that holds the fills of an instant, None before the first."""
    begun = [name for at, name in FORMATS if at <= instant]
    return begun[-1] if begun else None


def hour_keys(day: date) -> list[str]:
    """Every file of fills that a UTC day needs: each hour's own in its format, both at a change of format, and the next hour's, where late arrivals are."""
    midnight = datetime(day.year, day.month, day.day, tzinfo=timezone.utc)
    out = set()
    for h in range(24):
        begin, end = midnight + timedelta(hours=h), midnight + timedelta(hours=h + 1)
        own = {format_at(begin), *(name for at, name in FORMATS if begin < at < end)} - {None}
        last = format_at(end - timedelta(microseconds=1))
        out |= {f"{name}/hourly/{begin:%Y%m%d}/{begin.hour}.lz4" for name in own}
        if last:
            out.add(f"{last}/hourly/{end:%Y%m%d}/{end.hour}.lz4")
    return sorted(out)


def allowed(key: str) -> bool:
    """Whether a key lies under one of the formats and leads nowhere else."""
    return any(key.startswith(f"{name}/hourly/") for _, name in FORMATS) and not set(key) & set("?#\\") and not {".", ".."} & set(key.split("/"))


def url(kind: str, venue: str, ticker: str, day: date) -> str:
    """The address of one day (or month) of a kind."""
    one_of("kind", kind, tuple(ARCHIVES[one_of("venue", venue, tuple(ARCHIVES))]))
    symbol = instrument(venue, ticker).symbol
    if venue == PERPETUALS:
        name = FILE_KINDS[kind]
        folder, width, when = {"candles": ("daily", "1m", f"{day}"), "premium": ("daily", "1m", f"{day}"), "daily": ("monthly", "1d", f"{day:%Y-%m}"), "funding": ("monthly", name, f"{day:%Y-%m}")}.get(kind, ("daily", name, f"{day}"))
        inside = f"{symbol}/{width}" if width != name else symbol
        return f"{PERPETUAL_FILES}/{folder}/{name}/{inside}/{symbol}-{width}-{when}.zip"
    if venue == SWAPS:
        return f"{SWAP_TRADES}/{day:%Y%m%d}/{symbol}-trades-{day}.zip"
    if venue == LINEAR:
        if kind == "trades":
            return f"{LINEAR_TRADES}/{symbol}/{symbol}{day}.csv.gz"
        return f"{LINEAR_BOOKS}/{symbol}/{day}_{symbol}_ob{200 if day >= SHALLOW_BOOKS_FROM else 500}.data.zip"
    raise Refused(f"{venue} is read by hours: see hour_keys")


def listing_url(prefix: str, marker: str = "") -> str:
    return f"{PERPETUAL_LISTING}?prefix={quote(prefix)}&delimiter=/&marker={quote(marker)}"


def monthly_prefix(kind: str, symbol: str | None = None) -> str:
    """The folder that lists a monthly kind's symbols, or one symbol's files."""
    base = MONTHLY_FOLDERS[one_of("kind", kind, tuple(MONTHLY_FOLDERS))]
    return base if symbol is None else f"{base}{symbol}/" + ("1d/" if kind == "daily" else "")


def checksum_url(venue: str, archive: str) -> str | None:
    """The address of a file's checksum, where the venue has one."""
    return f"{archive}.CHECKSUM" if venue == PERPETUALS else None
