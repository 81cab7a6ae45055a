"""Durations, half-open ranges and calendar buckets."""

from __future__ import annotations

import datetime as dt
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# Microseconds per unit.
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}
STEPS = ("1s", "5s", "15s", "1m", "5m", "15m", "1h", "6h", "1d", "1w")


class RangeError(ValueError):
    """A range or condition that is refused; never taken as no filter."""


def duration(text: str) -> int:
    """Microseconds of ``'15m'``, ``'1h'``, ``'30d'``."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d|w)", text or "")
    if not m or not int(m[1]):
        raise RangeError(f"not a duration: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def span(now: int, since: str | None = None, frm: int | None = None, to: int | None = None) -> tuple[int, int]:
    """[from, to) in microseconds; ``since`` counts back from ``to`` or now and excludes ``frm``."""
    if since is not None and frm is not None:
        raise RangeError("since and from together")
    end = now if to is None else to
    begin = end - duration(since) if since is not None else frm
    if begin is None or begin >= end:
        raise RangeError("the range is empty, inverted or has no beginning")
    return begin, end


def instant(text: str, now: int, zone: str = "UTC") -> int:
    """Microseconds of ``now``, ``now-7d``, ``now/d`` or ``now-1w/w``: whole seconds, less a duration, rounded down to the
    zone's day, week (from Monday), month or year; or of an ISO time, in the zone where it names none."""
    tz = ZoneInfo(zone)
    m = re.fullmatch(r"now(?:-(\d+(?:ms|s|m|h|d|w)))?(?:/(d|w|mo|y))?", text or "")
    if not m:
        try:
            at = dt.datetime.fromisoformat(text)
        except (TypeError, ValueError):
            raise RangeError(f"not a time: {text!r}") from None
        return round((at if at.tzinfo else at.replace(tzinfo=tz)).timestamp() * 1e6)
    us = now // 1_000_000 * 1_000_000 - (duration(m[1]) if m[1] else 0)
    if not m[2]:
        return us
    day = dt.datetime.fromtimestamp(us // 1_000_000, tz).date()
    day = {"d": day, "w": day - dt.timedelta(days=day.weekday()), "mo": day.replace(day=1), "y": day.replace(month=1, day=1)}[m[2]]
    return round(dt.datetime.combine(day, dt.time(), tz).timestamp()) * 1_000_000


def resolve(frm: str, to: str, now: int, zone: str = "UTC", width: int = 1000, least: int = 0) -> tuple[int, int, int]:
    """[from, to) and a step, in microseconds, of a dashboard's range: one instant for all its panels."""
    begin, end = instant(frm, now, zone), instant(to, now, zone)
    if begin >= end:
        raise RangeError("the range is empty or inverted")
    return begin, end, max(least, step(begin, end, width))


def step(begin: int, end: int, width: int) -> int:
    """The least step of ``STEPS`` that gives at most ``width`` buckets."""
    for s in STEPS:
        if (end - begin) <= duration(s) * width:
            return duration(s)
    return -(-(end - begin) // width)


def within(us: Column, begin: int, end: int) -> Column:
    return (us >= begin) & (us < end)


def bucket(us: Column, every: int) -> Column:
    """The bucket's beginning; spans count from 1970-01-01 UTC."""
    return us - F.pmod(us, F.lit(every))


def calendar(ts: Column, unit: str, zone: str) -> Column:
    """The beginning, on the zone's calendar, of the day, week, month or year that holds an UTC instant."""
    return F.date_trunc(unit, F.from_utc_timestamp(ts, zone))
