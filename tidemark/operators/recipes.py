"""Time-series helpers from built-in functions. The as-of join, gap filling,
rates, and moving averages are additions of this engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.buckets import bucket_start, micros


def last_per_series(rows: DataFrame, tags: list[str], ts: str, ties: list[str]) -> DataFrame:
    """The newest row of each series: an aggregate, so rows are merged before
    the shuffle and no series is sorted."""
    rest = [c for c in rows.columns if c not in tags]
    best = rows.groupBy(*tags).agg(F.max_by(F.struct(*rest), F.struct(ts, *ties)).alias("__r"))
    return best.select(*tags, "__r.*").select(*rows.columns)


def downsample(rows: DataFrame, ts: str, interval: str, tags: list[str], aggs: dict[str, Column], ntz: bool = True) -> DataFrame:
    return rows.groupBy(bucket_start(F.col(ts), interval, ntz).alias("bucket"), *tags).agg(*(c.alias(n) for n, c in aggs.items()))


def gap_fill(bucketed: DataFrame, tags: list[str], step: str) -> DataFrame:
    """Every bucket between a series' first and last; values are null where it
    has none."""
    ends = bucketed.groupBy(*tags).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    every = ends.select(*tags, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {step}"))).alias("bucket"))
    return every.join(bucketed, [*tags, "bucket"], "left")


def delta(rows: DataFrame, tags: list[str], ts: str, value: str, ties: list[str]) -> DataFrame:
    """Difference to the row before in its series, and per second."""
    w = Window.partitionBy(*tags).orderBy(ts, *ties)
    us = micros(F.col(ts))
    d = rows.withColumns({"delta": F.col(value) - F.lag(value).over(w), "__us": us - F.lag(us).over(w)})
    return d.withColumn("rate", F.col("delta") / F.nullif(F.col("__us") / 1e6, F.lit(0.0))).drop("__us")


#: A block of time is so many times as long as the average reaches back.
REACHES = 8


def moving_average(rows: DataFrame, tags: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Average over a row's last `seconds`, both ends included, by series. A
    series is dealt by blocks of time, so that one with most of the rows has many
    tasks; the rows that the next block reaches back to are sent there as well."""
    us, reach = micros(F.col(ts)), max(1, seconds * 1_000_000)
    into = F.pmod(us, F.lit(REACHES * reach))
    own, later = us - into, us - into + REACHES * reach
    dealt = rows.withColumn("__block", F.explode(F.when(into >= (REACHES - 1) * reach, F.array(own, later)).otherwise(F.array(own))))
    w = Window.partitionBy(*tags, "__block").orderBy(us).rangeBetween(-seconds * 1_000_000, 0)
    return dealt.withColumn("moving_avg", F.avg(value).over(w)).where(F.col("__block").eqNullSafe(own)).drop("__block")


def asof_join(left: DataFrame, right: DataFrame, tags: list[str], ts: str, values: list[str]) -> DataFrame:
    """left with the values of the newest row of right at or before its time, by
    series. One shuffle of both sides together, no pairs."""
    both = left.select("*", F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[v].dataType).alias(f"right_{v}") for v in values), F.lit(None).cast("boolean").alias("__there"))
    other = right.select(*tags, ts, F.lit(0).alias("__side"), *(F.col(v).alias(f"right_{v}") for v in values), F.lit(True).alias("__there"))
    w = Window.partitionBy(*tags).orderBy(ts, "__side")
    last = F.last(F.when(F.col("__there"), F.struct(*(f"right_{v}" for v in values))), ignorenulls=True).over(w)
    merged = both.unionByName(other, allowMissingColumns=True).withColumn("__last", last).where("__side = 1")
    return merged.select(*left.columns, *(F.col("__last")[f"right_{v}"].alias(f"right_{v}") for v in values))


def runs(rows: DataFrame, order: list[str], value: str, tags: list[str] | None = None) -> DataFrame:
    """Runs of equal values in order: run number from 0, value, length."""
    w = Window.partitionBy(*(tags or [])).orderBy(*order)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(new)
    marked = rows.withColumn("__new", first).withColumn("run", F.sum("__new").over(w) - 1)
    return marked.groupBy(*(tags or []), "run", value).agg(F.count(F.lit(1)).alias("length"))


def second_difference(rows: DataFrame, tags: list[str], ts: str, ties: list[str]) -> DataFrame:
    """Delta of deltas of the time axis in microseconds."""
    w = Window.partitionBy(*tags).orderBy(ts, *ties)
    us = micros(F.col(ts))
    one = rows.withColumn("delta_us", us - F.lag(us).over(w))
    return one.withColumn("delta2_us", F.col("delta_us") - F.lag("delta_us").over(w))
