"""Streams into tables, and windowed rollups of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.table import Table


def append_stream(table: Table, stream: DataFrame, checkpoint: str, name: str = "stream") -> DataStreamWriter:
    """A writer, yet to be started, that appends every micro-batch once: a batch
    that is tried again after its commit is known by its id in the manifest. Late
    rows are always taken."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: table.append(df, f"{name}:{n}") and None)


def rollup(stream: DataFrame, ts: str, width: str, tags: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Count, sum, least and greatest value of each window and series, final
    when the watermark has passed; rows later than that are dropped here."""
    at = stream.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    out = at.groupBy(F.window("__at", width), *tags).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("bucket"), *tags, "rows", "sum", "min", "max")
