"""Ticks, wall-clock milliseconds and game minutes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class TickClock:
    """A counter of ticks with its rates; conversions are columns."""

    ticks_per_second: float = 20
    ticks_per_minute: float = 1
    now: int = 0

    def advance(self) -> int:
        self.now += 1
        return self.now

    def reset(self, tick: int) -> None:
        self.now = tick

    def to_ms(self, ticks: Column) -> Column:
        return F.floor(ticks * (1000 / self.ticks_per_second) + 0.5)

    def from_ms(self, ms: Column) -> Column:
        return F.floor(ms / (1000 / self.ticks_per_second))

    def to_minutes(self, ticks: Column) -> Column:
        return F.floor(ticks / self.ticks_per_minute)
