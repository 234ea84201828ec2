"""Refusals: bad input is named when a plan is built, never answered with an empty frame."""

from __future__ import annotations

import re
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame


class Refused(ValueError):
    """Input that no right answer exists for."""


def require(df: DataFrame, columns: Iterable[str], hint: str = "") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Refused(f"the frame lacks {', '.join(missing)}" + (f": {hint}" if hint else ""))


def one_of(name: str, value: str, allowed: Iterable[str]) -> str:
    if value not in allowed:
        raise Refused(f"{name}={value!r} is not one of {', '.join(allowed)}")
    return value


def instant(name: str, value: datetime) -> int:
    """Microseconds since the epoch of a zone-aware instant."""
    if value.tzinfo is None:
        raise Refused(f"{name} has no time zone")
    # against an epoch of another zone, as times of one zone are subtracted by the clock on the wall
    return (value - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def window(start: datetime, end: datetime) -> tuple[int, int]:
    lo, hi = instant("start", start), instant("end", end)
    if hi <= lo:
        raise Refused("the window is empty or reversed")
    return lo, hi


_SPAN = re.compile(r"^(\d+)(us|ms|s|m|h|d|w)$")
_UNITS = {"us": 1, "ms": 10**3, "s": 10**6, "m": 60 * 10**6, "h": 3600 * 10**6, "d": 86400 * 10**6, "w": 7 * 86400 * 10**6}


def micros(span: str | timedelta | int) -> int:
    """A span such as ``"5s"`` or ``"1h"`` in microseconds."""
    if isinstance(span, int):
        return span
    if isinstance(span, timedelta):
        return span // timedelta(microseconds=1)
    found = _SPAN.match(span)
    if not found:
        raise Refused(f"{span!r} is no span of time")
    return int(found[1]) * _UNITS[found[2]]
