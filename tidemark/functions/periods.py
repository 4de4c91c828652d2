"""Options that are written as text: periods, chunk intervals, codecs."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import datetime, timedelta

from ..errors import InvalidArgError

HOUR_US = 3_600_000_000
UNITS = ("HOUR", "DAY", "WEEK", "MONTH", "YEAR")
MAX_YEARS = 10_000
#: Most of each unit that stays within MAX_YEARS.
LIMITS = {"HOUR": MAX_YEARS * 366 * 24, "DAY": MAX_YEARS * 366, "WEEK": MAX_YEARS * 53, "MONTH": MAX_YEARS * 12, "YEAR": MAX_YEARS}
EPOCH = datetime(1970, 1, 1)
MIN_US, MAX_US = -(2**63), 2**63 - 1
#: The first instant of year 1.
FIRST_US = (datetime(1, 1, 1) - EPOCH) // timedelta(microseconds=1)
#: The end of year 9999, where the calendar ends.
END_US = 253_402_300_800_000_000


def normalise(text: str) -> str:
    """Blanks collapsed, upper case: how options are shown."""
    return " ".join(text.split()).upper()


def parse_amount(text: str) -> tuple[int, str]:
    """A positive number and a unit, singular or plural."""
    words = normalise(text).split(" ")
    if len(words) != 2 or not re.fullmatch(r"[0-9]+", words[0]) or int(words[0]) < 1:
        raise InvalidArgError(f"expected '<positive number> <unit>', not '{text}'")
    unit = words[1].removesuffix("S")
    if unit not in UNITS:
        raise InvalidArgError(f"unknown unit in '{text}'")
    return int(words[0]), unit


def to_us(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def from_us(us: int) -> datetime:
    """The time, or the last one of the calendar."""
    return datetime.max if us >= END_US else EPOCH + timedelta(microseconds=us)


def add_months(us: int, months: int) -> int:
    """A calendar shift that clamps the day; beyond the calendar it saturates."""
    t = from_us(us)
    n = t.year * 12 + t.month - 1 + months
    year, month = n // 12, n % 12 + 1
    if not 1 <= year <= 9999:
        return MIN_US if year < 1 else MAX_US
    return to_us(t.replace(year=year, month=month, day=min(t.day, calendar.monthrange(year, month)[1])))


@dataclass(frozen=True)
class Period:
    count: int
    unit: str

    @classmethod
    def parse(cls, text: str) -> Period:
        count, unit = parse_amount(text)
        if count > LIMITS[unit]:
            raise InvalidArgError(f"period '{text}' is longer than {MAX_YEARS} years")
        return cls(count, unit)

    def before(self, now_us: int) -> int:
        """now less this period, in microseconds."""
        if self.unit in ("MONTH", "YEAR"):
            return add_months(now_us, -self.count * (12 if self.unit == "YEAR" else 1))
        return now_us - self.count * HOUR_US * {"HOUR": 1, "DAY": 24, "WEEK": 168}[self.unit]

    def __str__(self) -> str:
        return f"{self.count} {self.unit}{'S' if self.count != 1 else ''}"


@dataclass(frozen=True)
class Retention:
    """A period, or none: rows are kept forever."""

    period: Period | None = None

    @classmethod
    def parse(cls, text: str | None) -> Retention:
        return cls(None if text is None or normalise(text) == "FOREVER" else Period.parse(text))

    def cutoff(self, now_us: int) -> int | None:
        return None if self.period is None else self.period.before(now_us)

    def __str__(self) -> str:
        return "FOREVER" if self.period is None else str(self.period)


#: Width of each fixed interval in hours; months follow the calendar.
INTERVALS = {"1 HOUR": 1, "6 HOUR": 6, "12 HOUR": 12, "1 DAY": 24, "1 WEEK": 168, "1 MONTH": 0}


@dataclass(frozen=True)
class ChunkInterval:
    name: str = "1 DAY"

    @classmethod
    def parse(cls, text: str) -> ChunkInterval:
        count, unit = parse_amount(text)
        name = f"{count} {unit}"
        if name not in INTERVALS:
            raise InvalidArgError(f"CHUNK_INTERVAL must be one of {', '.join(INTERVALS)}, not '{text}'")
        return cls(name)

    @property
    def width(self) -> int | None:
        """Microseconds, or none for months."""
        return INTERVALS[self.name] * HOUR_US or None

    @property
    def align(self) -> int:
        """Weeks begin on Mondays; 1970-01-05 is one."""
        return 4 * 24 * HOUR_US if self.name == "1 WEEK" else 0

    def start(self, us: int) -> int:
        if self.width:
            return (us - self.align) // self.width * self.width + self.align
        t = from_us(us)
        return to_us(datetime(t.year, t.month, 1))

    def end(self, us: int) -> int:
        start = self.start(us)
        return start + self.width if self.width else min(add_months(start, 1), END_US)


@dataclass(frozen=True)
class Codecs:
    """What cold chunks are compressed with; hot ones use LZ4, unless NONE."""

    cold: str = "ZSTD"
    level: int = 3

    @classmethod
    def parse(cls, name: str = "ZSTD", level: int = 3) -> Codecs:
        name = normalise(name)
        if name not in ("ZSTD", "LZ4", "NONE"):
            raise InvalidArgError(f"COMPRESSION must be ZSTD, LZ4 or NONE, not '{name}'")
        if not 1 <= level <= 19:
            raise InvalidArgError("COMPRESSION_LEVEL must be from 1 to 19")
        return cls(name, level)

    def of(self, hot: bool) -> str:
        return "NONE" if self.cold == "NONE" else "LZ4" if hot else self.cold


#: Codecs of the files. Fast ones are written with SNAPPY: Parquet's reader of
#: LZ4_RAW fails on some dictionary pages.
PARQUET = {"ZSTD": "zstd", "LZ4": "snappy", "NONE": "uncompressed"}


def is_hot(bucket_end_us: int, now_us: int, threshold: Period) -> bool:
    return bucket_end_us > threshold.before(now_us)


def parse_bound(text: str | None) -> int | None:
    """'YYYY-MM-DD[ HH:MM:SS[.ffffff]]' in microseconds; empty is no bound."""
    if text is None or not text.strip():
        return None
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[ T](\d{2}:\d{2}:\d{2})(?:\.(\d{1,6}))?)?", text.strip())
    if not m:
        raise InvalidArgError(f"not a date or time: '{text}'")
    try:
        t = datetime.fromisoformat(f"{m[1]} {m[2] or '00:00:00'}")
    except ValueError:
        raise InvalidArgError(f"not a date or time: '{text}'") from None
    return to_us(t) + int((m[3] or "0").ljust(6, "0"))


def format_compact(us: int) -> str:
    t = from_us(us)
    return f"{t.year:04d}{t:%m%dT%H%M%S}"
