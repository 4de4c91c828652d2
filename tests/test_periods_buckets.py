from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgError
from tidemark.functions.buckets import bucket_end, bucket_start, from_micros, micros
from tidemark.functions.periods import END_US, INTERVALS, ChunkInterval, Codecs, Period, Retention, add_months, format_compact, is_hot, parse_bound, to_us

MICROS = st.integers(to_us(datetime(1000, 1, 1)), to_us(datetime(9999, 12, 30)))


@pytest.mark.parametrize("bad", ["", "1", "DAY", "0 DAY", "-1 DAY", "1 FORTNIGHT", "1 DAY 2", "1.5 DAY", "99999999 YEARS"])
def test_bad_periods(bad):
    with pytest.raises(InvalidArgError):
        Period.parse(bad)


def test_periods():
    now = to_us(datetime(2024, 3, 31))
    assert Period.parse(" 2   weeks ") == Period(2, "WEEK")
    assert Period.parse("1 month").before(now) == to_us(datetime(2024, 2, 29))
    assert Period.parse("13 MONTHS").before(now) == to_us(datetime(2023, 2, 28))
    assert Retention.parse("forever").cutoff(now) is None
    assert str(Retention.parse("30 day")) == "30 DAYS"
    assert add_months(to_us(datetime(2024, 1, 31)), 1) == to_us(datetime(2024, 2, 29))
    assert is_hot(now + 1, now, Period(1, "HOUR")) and not is_hot(now - 3_600_000_000, now, Period(1, "HOUR"))
    assert format_compact(now) == "20240331T000000"


@pytest.mark.parametrize("bad", ["2 HOUR", "3 DAYS", "1 YEAR", "DAY"])
def test_bad_intervals(bad):
    with pytest.raises(InvalidArgError):
        ChunkInterval.parse(bad)


def test_codecs():
    assert Codecs.parse("lz4").of(False) == "LZ4" and Codecs.parse("none").of(True) == "NONE" and Codecs.parse().of(True) == "LZ4"
    for bad in (("SNAPPY", 3), ("ZSTD", 0), ("ZSTD", 20)):
        with pytest.raises(InvalidArgError):
            Codecs.parse(*bad)


def test_bounds():
    assert parse_bound("2024-01-01") == to_us(datetime(2024, 1, 1)) and parse_bound("") is None
    assert parse_bound("2024-01-01 10:00:00.5") == to_us(datetime(2024, 1, 1, 10)) + 500_000
    for bad in ("2024-13-01", "yesterday", "2024-01-01T", "2024-01-01 25:00:00"):
        with pytest.raises(InvalidArgError):
            parse_bound(bad)


@given(MICROS, st.sampled_from(sorted(INTERVALS)))
@settings(max_examples=300)
def test_a_bucket_holds_its_time(us, name):
    i = ChunkInterval.parse(name)
    assert i.start(us) <= us < i.end(us) and i.start(i.start(us)) == i.start(us)
    assert i.end(us) >= END_US or i.start(i.end(us)) == i.end(us)


def test_buckets_equal_whole_numbers(spark):
    edges = [datetime(1000, 1, 1), datetime(1969, 12, 14), datetime(1969, 12, 31, 23, 30), datetime(1970, 1, 1), datetime(1970, 1, 5), datetime(1970, 1, 18), datetime(2026, 2, 28, 23), datetime(2026, 3, 1), datetime(9999, 12, 30, 23, 59)]
    times = [e + timedelta(microseconds=d) for e in edges for d in (-1, 0, 1) if e + timedelta(microseconds=d) >= datetime(1000, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            for name in INTERVALS:
                i = ChunkInterval.parse(name)
                got = df.select("ts", micros(F.col("ts")), micros(bucket_start(F.col("ts"), i)), micros(bucket_end(F.col("ts"), i)), from_micros(micros(F.col("ts")))).collect()
                assert [(r[1], r[2], r[3]) for r in got] == [(to_us(t), i.start(to_us(t)), i.end(to_us(t))) for t in times], name
                assert all(r[0] == r[4] for r in got)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
