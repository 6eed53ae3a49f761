"""Calendar intervals as column expressions: tokens, period starts and ends."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The interval vocabulary, token to (unit, count); tokens are case-sensitive.
INTERVALS = {
    "1m": ("minutes", 1),
    "5m": ("minutes", 5),
    "15m": ("minutes", 15),
    "30m": ("minutes", 30),
    "1h": ("minutes", 60),
    "2h": ("minutes", 120),
    "4h": ("minutes", 240),
    "1d": ("days", 1),
    "1w": ("weeks", 1),
    "1M": ("months", 1),
}
_ORDER = ("ticks", "seconds", "minutes", "days", "weeks", "months", "years")


class InvalidInterval(ValueError):
    pass


@dataclass(frozen=True)
class Interval:
    unit: str
    count: int = 1

    @property
    def token(self) -> str:
        for token, x in INTERVALS.items():
            if x == (self.unit, self.count):
                return token
        raise InvalidInterval(f"{self.count} {self.unit} has no token")

    @property
    def seconds(self) -> int | None:
        """The span of fixed units; None for weeks' and longer calendar units that are not of one length."""
        return {"seconds": 1, "minutes": 60, "days": 86400, "weeks": 604800}.get(self.unit, 0) * self.count or None

    def finer_than(self, other: Interval) -> bool:
        return (_ORDER.index(self.unit), self.count) < (_ORDER.index(other.unit), other.count)


def interval(token: str) -> Interval:
    if token not in INTERVALS:
        raise InvalidInterval(f"{token!r} is none of {', '.join(INTERVALS)}")
    return Interval(*INTERVALS[token])


def period_start(ts: Column, over: Interval) -> Column:
    """Start of the period: spans count from the epoch (also before it), weeks begin on Monday, months on the first."""
    if over.unit == "weeks":
        return F.date_trunc("week", ts)
    if over.unit == "months":
        return F.date_trunc("month", ts)
    if over.unit == "years":
        return F.date_trunc("year", ts)
    span = over.seconds
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts.cast("timestamp")) / span) * span)


def advance(start: Column, over: Interval, by: int = 1) -> Column:
    if over.unit == "months":
        return F.add_months(start, by * over.count).cast("timestamp")
    if over.unit == "years":
        return F.add_months(start, 12 * by * over.count).cast("timestamp")
    return start + F.expr(f"interval {by * over.seconds} seconds")


def period_end(ts: Column, over: Interval) -> Column:
    """The first moment after the period."""
    return advance(period_start(ts, over), over)
