"""Time reference system: how integer ticks relate to wall-clock time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _ms(delta: timedelta) -> int:
    return delta // timedelta(milliseconds=1)


@dataclass(frozen=True)
class TRS:
    """``granularity`` per tick, counted from ``start_time`` (default: 1 ms from 1970-01-01 UTC)."""

    granularity: timedelta = timedelta(milliseconds=1)
    start_time: datetime = _EPOCH

    def __post_init__(self):
        if _ms(self.granularity) < 1:
            raise ValueError("granularity must be at least one millisecond")

    @property
    def granularity_ms(self) -> int:
        return _ms(self.granularity)

    @property
    def start_ms(self) -> int:
        start = self.start_time
        if start.tzinfo is None:
            start = start.replace(tzinfo=timezone.utc)
        return _ms(start - _EPOCH)

    def to_index(self, time_ms: Column) -> Column:
        """Milliseconds since the epoch -> tick. Lossy when the granularity is above 1 ms."""
        if self == TRS():
            return time_ms.cast("long")
        return F.floor((time_ms - F.lit(self.start_ms)) / F.lit(self.granularity_ms)).cast("long")

    def to_long_lower(self, index: Column) -> Column:
        """Tick -> first millisecond it covers."""
        return (index * F.lit(self.granularity_ms) + F.lit(self.start_ms)).cast("long")

    def to_long_upper(self, index: Column) -> Column:
        """Tick -> last millisecond it covers."""
        return ((index + 1) * F.lit(self.granularity_ms) + F.lit(self.start_ms - 1)).cast("long")


def epoch_ms(col: Column, data_type: str) -> Column:
    """Milliseconds since the epoch of a timestamp, timestamp_ntz, date or integer column."""
    if data_type == "timestamp_ntz":
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MILLISECOND", zero, col).cast("long")
    if data_type == "timestamp":
        return F.unix_millis(col)
    if data_type == "date":
        return F.unix_date(col).cast("long") * 86_400_000
    return col.cast("long")

