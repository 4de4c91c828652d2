"""Time buckets as Spark expressions, exact to the microsecond in all of the
calendar and independent of the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .periods import ChunkInterval

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def micros(ts: Column, ntz: bool = True) -> Column:
    """Microseconds since 1970: of the wall clock (timestamp_ntz) or of the
    instant (timestamp)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), ts) if ntz else F.unix_micros(ts)


def from_micros(us: Column, ntz: bool = True) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(_EPOCH)) if ntz else F.timestamp_micros(us)


def _month(us: Column, more: int = 0) -> Column:
    wall = from_micros(us)
    first = F.make_timestamp_ntz(F.year(wall), F.month(wall), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return micros(F.timestamp_add("MONTH", F.lit(more), first) if more else first)


def bucket_start_us(us: Column, interval: ChunkInterval) -> Column:
    if interval.width is None:
        return _month(us)
    return us - F.pmod(us - F.lit(interval.align), F.lit(interval.width))


def bucket_start(ts: Column, interval: ChunkInterval | str, ntz: bool = True) -> Column:
    i = ChunkInterval.parse(interval) if isinstance(interval, str) else interval
    return from_micros(bucket_start_us(micros(ts, ntz), i), ntz)


def bucket_end(ts: Column, interval: ChunkInterval | str, ntz: bool = True) -> Column:
    i = ChunkInterval.parse(interval) if isinstance(interval, str) else interval
    us = micros(ts, ntz)
    return from_micros(_month(us, 1) if i.width is None else bucket_start_us(us, i) + i.width, ntz)


def compact_name(us: Column) -> Column:
    """YYYYMMDDTHHMMSS of microseconds."""
    return F.date_format(from_micros(us), "yyyyMMdd'T'HHmmss")
