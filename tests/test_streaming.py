from datetime import datetime

from pyspark.sql import types as T

from tidemark.sources.schema import tag
from tidemark.streaming.appender import append_stream, rollup

SCHEMA = T.StructType([T.StructField("ts", T.TimestampNTZType(), False), tag("host"), T.StructField("v", T.DoubleType())])


def test_stream_into_table(spark, engine, tmp_path):
    t = engine.create("s", SCHEMA)
    source = spark.createDataFrame([(datetime(2024, 1, 1, i), f"h{i % 2}", float(i)) for i in range(10)], SCHEMA)
    source.write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # started again, it takes nothing twice
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        append_stream(t, stream, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert t.count() == 10
    source.write.mode("append").parquet(f"{tmp_path}/in")
    append_stream(t, spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert t.count() == 20


def test_rollup(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, i // 60, i % 60), "h", 1.0) for i in range(180)] + [(datetime(2024, 1, 2), "h", 1.0)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = rollup(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), "ts", "1 hour", ["host"], "v")
    out.writeStream.outputMode("append").format("memory").queryName("rolled").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("rolled").orderBy("bucket").collect()
    assert [r["rows"] for r in got] == [60, 60, 60]
