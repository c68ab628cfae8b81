"""Minute bars of a trading day, and trading sessions."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Sequence


def _hhmm(first: int, last: int) -> list[int]:
    minutes = range(first // 100 * 60 + first % 100, last // 100 * 60 + last % 100 + 1)
    return [m // 60 * 100 + m % 60 for m in minutes]


class MinuteCalendar:
    """The bars of a day: an opening auction, continuous minutes, a closing auction."""

    def __init__(self, continuous: Sequence[int] | None = None, auctions: tuple[int, int] = (925, 1500)) -> None:
        self.continuous = list(continuous or _hhmm(930, 1129) + _hhmm(1300, 1456))
        self.auctions = auctions

    def minbars(self) -> list[int]:
        return [self.auctions[0], *self.continuous, self.auctions[1]]

    def bucket_map(self, interval: int) -> dict[int, int]:
        """Continuous minute → first minute of its bucket, by position, so a bucket may span lunch."""
        if interval < 1:
            raise ValueError("a frequency is at least 1 minute")
        return {m: self.continuous[k - k % interval] for k, m in enumerate(self.continuous)}

    def merge_targets(self, interval: int) -> dict[int, int]:
        """Where auction bars go when they are merged: the first and the last bucket."""
        buckets = self.bucket_map(interval)
        return dict(zip(self.auctions, (buckets[self.continuous[0]], buckets[self.continuous[-1]]), strict=True))


class TradingCalendar:
    """Ordered trading sessions, as YYYYMMDD text."""

    def __init__(self, sessions: Iterable[str]) -> None:
        self.sessions = sorted({str(s).replace("-", "") for s in sessions})

    def previous_sessions(self, date: str, n: int) -> list[str]:
        """The last n sessions up to and with `date`."""
        at = bisect_left(self.sessions, date)
        if at == len(self.sessions) or self.sessions[at] != date:
            raise ValueError(f"{date} is no trading session")
        if n < 1 or at + 1 < n:
            raise ValueError(f"{date} does not have {n} sessions of history")
        return self.sessions[at + 1 - n : at + 1]
