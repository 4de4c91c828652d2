"""Series: the distinct combinations of tag values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series_key(tags: list[str]) -> Column:
    """One value for each combination; null and empty tags differ."""
    return F.struct(*tags) if tags else F.struct(F.lit(0).alias("none"))


def count_series(tags: list[str]) -> Column:
    return F.count_distinct(series_key(tags))


def same_series(a: DataFrame, b: DataFrame, tags: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[t].eqNullSafe(b[t]) for t in tags), F.lit(True))


def series_index(rows: DataFrame, tags: list[str], arrival: list[str | Column]) -> DataFrame:
    """Every series with a dense id from 0 by first arrival. What reaches the
    last sort is one row for each series."""
    seen = rows.groupBy(*tags).agg(F.min(F.struct(*arrival)).alias("__first"))
    return seen.select(*tags, (F.row_number().over(Window.orderBy("__first", *tags)) - 1).cast("long").alias("series_id"))


def by_id() -> WindowSpec:
    """New series in the order of their arrival; one row for each."""
    return Window.orderBy("series_id")


def series_ranges(rows: DataFrame, tags: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*tags).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("ts_min"), F.max(ts).alias("ts_max"))
