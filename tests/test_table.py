from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import ConflictError, CorruptError, InvalidArgError, NotFoundError, ReadOnlyError, UnsupportedError
from tidemark.functions.periods import parse_bound, to_us
from tidemark.operators import inspect, maintenance
from tidemark.sources.schema import tag

NOW = to_us(datetime(2024, 1, 3))
SCHEMA = T.StructType([T.StructField("ts", T.TimestampNTZType(), False), tag("host"), tag("metric"), T.StructField("value", T.DoubleType())])


def samples(spark, lo, hi):
    rows = []
    for i in range(lo, hi):
        at = datetime(2024, 1, 1) + timedelta(minutes=i)
        for h in (1, 2, 3):
            rows += [(at, f"srv0{h}", "cpu", float(i * h)), (at, f"srv0{h}", "mem", 1000.0 * h + i)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module", params=["pending", "sealed", "mixed", "compacted"])
def metrics(request, spark, tmp_path_factory):
    """The same rows in every physical state."""
    from tidemark.engine import Engine

    t = Engine(spark, f"file://{tmp_path_factory.mktemp('db')}").create("m", SCHEMA, {"CHUNK_INTERVAL": "1 HOUR"})
    t.append(samples(spark, 0, 150))
    if request.param != "pending":
        t.flush(NOW)
    t.append(samples(spark, 150, 240))
    if request.param in ("sealed", "compacted"):
        t.flush(NOW)
    if request.param == "compacted":
        assert maintenance.compact(t, now=NOW) == 1
    return t


def test_every_state_gives_the_same(metrics):
    t = metrics
    assert t.count() == t.df().count() == 1440
    assert t.scan("2024-01-01 02:00:00", "2024-01-01 02:59:00").count() == 360
    assert t.lookup("2024-01-01 03:58:00", "AFTER_KEY").count() == 6
    cpu = t.scan("2024-01-01", "2024-01-01 01:00:00", {"metric": "cpu"}).groupBy("host").agg(F.avg("value")).collect()
    assert sorted(map(tuple, cpu)) == [("srv01", 30.0), ("srv02", 60.0), ("srv03", 90.0)]
    assert {r.ts for r in t.latest(6).collect()} == {datetime(2024, 1, 1, 3, 59)}
    assert [r.ts.minute for r in t.latest(3, {"host": "srv02", "metric": "mem"}).collect()] == [59, 58, 57]
    assert t.first().first().ts == datetime(2024, 1, 1) and t.last().first().ts == datetime(2024, 1, 1, 3, 59)
    assert t.bounds() == (to_us(datetime(2024, 1, 1)), to_us(datetime(2024, 1, 1, 3, 59)))
    up, down = (t.scan(sorted=True, desc=d).collect() for d in (False, True))
    assert up == down[::-1] and [r.ts for r in up] == sorted(r.ts for r in up)
    assert t.scan(tags={"host": "SRV01 "}, collation="latin1_swedish_ci").count() == 480
    assert t.scan(tags={"host": ["srv01", None, "x"]}).count() == 480 and t.scan(tags={"host": None}).count() == 0
    assert t.series().count() == 6 and [r.series_id for r in t.series().orderBy("series_id").collect()] == list(range(6))
    three = t.scan(sorted=True, positions=True).limit(3)
    assert sorted(map(str, t.fetch(three).collect())) == sorted(map(str, t.scan(sorted=True).limit(3).collect()))
    assert maintenance.check(t) == len(t.snapshot().files)
    assert inspect.estimate_rows(t.snapshot(), *t.bounds()) in range(1200, 1441)


@pytest.mark.parametrize(("mode", "first"), [("EXACT", 120), ("KEY_OR_NEXT", 120), ("AFTER_KEY", 121), ("KEY_OR_PREV", 120), ("BEFORE_KEY", 119), ("PREFIX_LAST", 120)])
def test_lookups(metrics, mode, first):
    row = metrics.lookup("2024-01-01 02:00:00", mode).first()
    assert row.ts == datetime(2024, 1, 1) + timedelta(minutes=first)


def test_pruning(metrics):
    lo, hi = parse_bound("2024-01-01 03:10:00"), parse_bound("2024-01-01 03:20:00")
    read = metrics.scan(lo, hi).inputFiles()
    assert len(read) == len(metrics.pruned(lo, hi)) and (len(read) < len(metrics.snapshot().files) or len(read) == 1 or not metrics.snapshot().sealed)
    df = metrics.scan(lo, hi, {"host": "srv01"})
    plan = metrics.spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "EqualTo(host,srv01)" in plan


def test_compaction_counts(spark, engine):
    t = engine.create("c", T.StructType([SCHEMA["ts"], tag("host"), T.StructField("v", T.IntegerType())]))
    for n in range(5):
        rows = [(datetime(2024, 1, 1 + d, 1) + timedelta(seconds=i), f"h{i % 4}", n * 100 + i) for d in range(3) for i in range(100)]
        t.append(spark.createDataFrame(rows, t.schema))
        t.flush(NOW)
    total = t.df().agg(F.count("v"), F.sum("v")).first()
    assert len(t.snapshot().sealed) == 15
    assert maintenance.compact(t, "2024-01-02", "2024-01-02 23:59:59", NOW) == 1 and len(t.snapshot().sealed) == 11
    assert maintenance.compact(t, now=NOW) == 2 and len(t.snapshot().sealed) == 3
    assert t.df().agg(F.count("v"), F.sum("v")).first() == total
    assert maintenance.compact(t, now=NOW) == 0
    # Equal times of a series keep the order of arrival.
    one = [r.v for r in t.scan("2024-01-01 01:00:00", "2024-01-01 01:00:00", sorted=True).collect()]
    assert one == [0, 100, 200, 300, 400]
    # What has grown cold is coded anew.
    later = to_us(datetime(2024, 3, 1))
    assert {f.codec for f in t.snapshot().sealed} == {"LZ4"} and maintenance.run_maintenance(t, later)["compacted"] == 3
    assert {f.codec for f in t.snapshot().sealed} == {"ZSTD"}


def test_retention_and_views(spark, engine):
    now = to_us(datetime(2024, 6, 1))
    t = engine.create("r", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]), {"RETENTION_PERIOD": "30 days"})
    t.append(spark.createDataFrame([(datetime(2024, 6, 1) - timedelta(days=d), i + 1) for i, d in enumerate((400, 100, 1, 0))], t.schema))
    t.flush(now)
    states = [r.status for r in engine.chunks(now).orderBy("bucket_start").collect()]
    assert states == ["EXPIRED", "EXPIRED", "HOT", "HOT"]
    assert engine.apply_retention("r", now) == 2 and sorted(r.v for r in t.df().collect()) == [3, 4]
    v = engine.tables(now).first()
    assert (v.table_name, v.row_count, v.pending_rows, v.chunks, v.retention_period) == ("r", 2, 0, 2, "30 DAYS")


def test_pending_rows_in_views(spark, engine):
    t = engine.create("m1", T.StructType([SCHEMA["ts"], tag("host"), SCHEMA["value"]]), {"CHUNK_INTERVAL": "1 HOUR", "RETENTION_PERIOD": "3650 DAYS"})
    at = datetime(2024, 1, 1)
    t.append(spark.createDataFrame([(at + timedelta(minutes=i), f"h{i % 4}", float(i)) for i in range(180)], t.schema))
    t.flush(NOW)
    t.append(spark.createDataFrame([(at + timedelta(hours=5), "h9", 1.0)], t.schema))
    v = engine.tables(NOW).first()
    assert (v.row_count, v.pending_rows, v.series, v.chunks) == (181, 1, 5, 3)
    assert [(r.row_count, r.series) for r in engine.chunks(NOW).collect()] == [(60, 4)] * 3


def test_rows_come_whole_or_not(spark, engine):
    t = engine.create("w", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    one = spark.createDataFrame([(datetime(2024, 1, 1), 1)], t.schema)
    with pytest.raises(RuntimeError), t.batch() as b:
        b.write(one)
        raise RuntimeError
    assert t.count() == 0
    with t.batch() as b:
        b.write(one)
        b.write(one)
        assert t.count() == 0
    assert t.count() == 2  # equal rows are all kept
    with pytest.raises(InvalidArgError):
        t.append(spark.createDataFrame([(None, 1)], "ts timestamp_ntz, v int"))
    with pytest.raises(InvalidArgError):
        t.append(spark.createDataFrame([(datetime(2024, 1, 1), 1, 2)], "ts timestamp_ntz, v int, w int"))
    assert t.count() == 2
    v = t.append(one, "batch-1").version
    assert t.append(one, "batch-1").version == v
    t.append(t.df())
    assert t.count() == 6 and t.as_of(v).count() == 3
    for change in (lambda: t.update("v = 1"), lambda: t.delete("v = 1")):
        with pytest.raises(ReadOnlyError):
            change()
    with pytest.raises(UnsupportedError):
        t.handler()
    t.delete("1 = 0")
    ids = t.snapshot().next_id
    b = t.batch().__enter__()
    b.write(one)
    t.truncate()
    with pytest.raises(InvalidArgError):
        b.commit()
    assert t.count() == 0 and t.snapshot().next_id == ids and t.latest(3).count() == 0 and t.bounds() is None


def test_concurrent_commits(spark, engine):
    t = engine.create("k", T.StructType([SCHEMA["ts"]]))
    old = t.snapshot()
    t.append(spark.createDataFrame([(datetime(2024, 1, 1),)], t.schema))
    with pytest.raises(ConflictError):
        t.versions.commit(old, epoch=7)


def test_recovery(spark, engine, tmp_path):
    t = engine.create("q", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    for d in (1, 2):
        t.append(spark.createDataFrame([(datetime(2024, 1, d), d)], t.schema))
        t.flush(NOW)
    bad = t.snapshot().sealed[0]
    path = f"{tmp_path}/db/q/{bad.path}"
    data = bytearray(open(path, "rb").read())
    data[10] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(CorruptError):
        maintenance.check(t)
    assert maintenance.recover(t)["quarantined"] == 1 and [r.v for r in t.df().collect()] == [2]
    import os

    os.unlink(f"{tmp_path}/db/q/{t.snapshot().sealed[0].path}")
    with pytest.raises(CorruptError):
        engine.open("q")


def test_names_and_copies(spark, engine):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), 1)], "ts timestamp_ntz, v int")
    schema = T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())])
    engine.create_as("a", schema, rows)
    engine.create_like("b", "a")
    engine.swap("a", "b")
    assert engine.open("a").count() == 0 and engine.open("b").count() == 1
    engine.rename("b", "c")
    wider = T.StructType([*schema, T.StructField("w", T.LongType())])
    from tidemark.sources.schema import TableDef

    t = engine.alter("c", TableDef(wider), ["ts", "v", "CAST(v + 1 AS BIGINT) AS w"])
    assert t.df().first().w == 2 and engine.names() == ["a", "c"]
    engine.create("tmp", schema, temporary=True)
    assert engine.names() == ["a", "c"] and engine.open("tmp").count() == 0
    engine.export_csv(t.df(), f"{engine.root}/../out")
    engine.load_csv("c", f"{engine.root}/../out")
    assert engine.open("c").count() == 2
    engine.drop("a")
    with pytest.raises(NotFoundError):
        engine.open("a")
    with pytest.raises(InvalidArgError):
        engine.create("../x", schema)
    assert not engine.config.set("compaction_trigger_chunks", 1) and engine.config.compaction_trigger_chunks == 2


def test_null_and_empty_tags_are_series(spark, engine):
    t = engine.create("n", T.StructType([SCHEMA["ts"], tag("host")]))
    t.append(spark.createDataFrame([(datetime(2024, 1, 1), h) for h in (None, "", "a", "A", None)], t.schema))
    assert t.series().count() == 4 and t.scan(tags={"host": "a"}).count() == 1
    assert t.scan(tags={"host": "a"}, collation="UTF8_LCASE").count() == 2


def test_many_series(spark, engine):
    t = engine.create("ms", T.StructType([SCHEMA["ts"], tag("host"), tag("dc"), T.StructField("v", T.IntegerType())]), {"CHUNK_INTERVAL": "1 HOUR"})
    base = spark.range(5000).crossJoin(spark.range(2).withColumnRenamed("id", "n"))
    rows = base.select(F.timestamp_add("MINUTE", F.col("n"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")).alias("ts"), F.concat(F.lit("h"), "id").alias("host"), F.concat(F.lit("dc"), F.col("id") % 3).alias("dc"), F.col("id").cast("int").alias("v"))
    t.append(rows)
    t.flush(NOW)
    t.append(rows)
    wanted = [f"h{i}" for i in range(0, 4500, 5)]
    assert t.count() == 20_000 and t.series().count() == 5000
    assert t.scan(tags={"host": wanted}).count() == 3600
    assert t.scan(tags={"host": [w.upper() for w in wanted]}, collation="UTF8_LCASE").count() == 3600
    assert t.scan(series=spark.createDataFrame([("h1", "dc1"), ("h2", "dc9")], "host string, dc string")).count() == 4


def test_open_batches_are_left_alone(spark, engine):
    t = engine.create("l", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    one = spark.createDataFrame([(datetime(2024, 1, 1), 1)], t.schema).coalesce(1)
    t.append(one)
    with t.batch() as b:
        b.write(one)
        assert maintenance.recover(t)["orphans"] == 0 and maintenance.vacuum(t) == 0
    assert t.count() == t.df().count() == 2 and not t.store.list("_leases")
    b = t.batch().__enter__()
    b.write(one)
    b.abort()
    assert maintenance.vacuum(t) == 1 and t.df().count() == 2
    b = t.batch().__enter__()
    b.write(one)
    assert maintenance.vacuum(t, lease_age=0) == 1  # a writer that is gone
    with pytest.raises(CorruptError):
        b.commit()
    assert t.df().count() == 2


def test_a_batch_id_is_published_once(spark, engine):
    t = engine.create("o", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    one = spark.createDataFrame([(datetime(2024, 1, 1), 1)], t.schema)
    staged = [t._staged(one) for _ in range(2)]  # two writers pass the first check
    for entries in staged:
        t._publish(entries, "s:7")
    assert t.count() == 1
    t.append(one, "s:8")
    t.append(one, "other")
    t.append(one, "s:6")
    t.append(one, "s:8")
    assert t.count() == 3 and t.snapshot().batches == ("s:8", "other")


def test_compaction_whose_inputs_are_gone(spark, engine, monkeypatch):
    t = engine.create("g", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    for _ in range(2):
        t.append(spark.createDataFrame([(datetime(2024, 1, 1), 1)], t.schema))
        t.flush(NOW)
    seal = t.seal
    monkeypatch.setattr(t, "seal", lambda files, now: (seal(files, now), t.truncate())[0])
    assert maintenance.compact(t, now=NOW) == 0 and t.count() == 0
    version = t.version
    assert maintenance.compact(t, now=NOW) == 0 and t.version == version


def test_versions_hold_changes(spark, engine):
    from tidemark.sources.manifest import Manifest, Versions

    t = engine.create("d", T.StructType([SCHEMA["ts"], T.StructField("v", T.IntegerType())]))
    one = spark.createDataFrame([(datetime(2024, 1, 1), 1)], t.schema)
    t.append(one, "a:1")
    t.flush(NOW)
    entry = t.snapshot().files[0]
    from dataclasses import replace

    for n in range(40):  # files come and go
        t.commit(lambda m, n=n: {"files": (*m.files[1:], replace(entry, id=m.next_id, path=f"data/x{n}"), replace(entry, id=m.next_id + 1, path=f"data/y{n}")), "next_id": m.next_id + 2, "epoch": n // 9})
    last = t.snapshot()
    fresh = Versions(t.store)
    assert fresh.read() == last and fresh.read(5).epoch == 0 and len(fresh.read(30).files) == 29
    sizes = [len(t.store.read(f"_manifest/v{n:09d}.json")) for n in (32, 41)]
    assert sizes[1] < sizes[0] / 4 and Manifest.loads(last.dumps()) == last
    maintenance.vacuum(t, keep_versions=3)
    assert Versions(t.store).read() == last and min(t.versions.numbers()) == 32


def test_series_are_kept(spark, engine, tmp_path):
    t = engine.create("s", T.StructType([SCHEMA["ts"], tag("host"), T.StructField("v", T.IntegerType())]))
    row = lambda h, m: (datetime(2024, 1, 1, 0, m), h, m)
    ids = lambda: {r.host: r.series_id for r in t.series().collect()}
    t.append(spark.createDataFrame([row("b", 1)], t.schema).coalesce(1))
    t.append(spark.createDataFrame([row("z", 2), row("b", 3)], t.schema).coalesce(1))
    first = ids()
    assert first == {"b": 0, "z": 1} and t.series_count() == 2
    t.flush(NOW)
    t.append(spark.createDataFrame([row("a", 4), row(None, 5)], t.schema).coalesce(1))
    now = ids()
    assert {h: now[h] for h in first} == first and sorted(now.values()) == [0, 1, 2, 3]
    t.flush(NOW)
    maintenance.compact(t, now=NOW)
    assert ids() == now and t.scan(tags={"host": "A"}, collation="UTF8_LCASE").count() == 1
    steps = t.store.list("_series")
    assert ids() == now and t.store.list("_series") == steps  # up to date: nothing is written
    t.truncate()
    assert ids() == {} and t.series_count() == 0


def test_settings_act(spark, engine):
    schema = T.StructType([SCHEMA["ts"], tag("host"), T.StructField("v", T.StringType())])
    t = engine.create("f", schema, {"MEMTABLE_SIZE": 1 << 20})
    row = lambda n: [(datetime(2024, 1, 1), "h", "x" * 1000)] * n
    t.append(spark.createDataFrame(row(500), schema))
    assert len(t.snapshot().pending) and not t.snapshot().sealed
    t.append(spark.createDataFrame(row(700), schema))
    assert not t.snapshot().pending and t.count() == 1200
    engine.config.set("compaction_trigger_chunks", 2)
    engine.config.set("bloom_filter_false_positive_rate", 0.2)
    assert engine.open("f").bloom_rate == 0.2
    t.append(spark.createDataFrame(row(1), schema))
    t.flush()
    engine.create("broken", schema).append(spark.createDataFrame(row(1), schema))
    s = maintenance.Scheduler(lambda: {"broken": None, "f": engine.open("f")}, 1, engine.config.compaction_trigger_chunks)
    assert s.round() == {"f": {"compacted": 1, "dropped": 0}} and set(s.errors) == {"broken"}


def test_files_are_bounded_by_bytes(spark, engine, monkeypatch):
    from tidemark.sources import table

    monkeypatch.setattr(table, "MAX_FILE_BYTES", 4000)
    t = engine.create("z", T.StructType([SCHEMA["ts"], T.StructField("v", T.StringType())]))
    t.append(spark.createDataFrame([(datetime(2024, 1, 1, 0, i % 60), "y" * 88) for i in range(200)], t.schema))
    t.flush(NOW)
    assert len(t.snapshot().sealed) >= 5 and all(f.data_bytes <= 4000 for f in t.snapshot().sealed) and t.df().count() == 200


def days(spark, n=3, per_day=600):
    """Rows of some days, dealt over partitions; series go through all of a day."""
    rows = spark.range(n * per_day).repartition(4)
    at = F.timestamp_add("SECOND", F.col("id") % per_day * 60, F.timestamp_add("DAY", F.floor(F.col("id") / per_day), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")))
    return rows.select(at.alias("ts"), F.concat(F.lit("h"), F.col("id") % 4).alias("host"), F.col("id").cast("double").alias("value"))


DAYS = T.StructType([SCHEMA["ts"], tag("host"), SCHEMA["value"]])


@pytest.fixture
def split(spark, engine, monkeypatch):
    """A table whose chunks have several files each."""
    from tidemark.sources import table

    monkeypatch.setattr(table, "MAX_FILE_BYTES", 2000)
    t = engine.create("split", DAYS, {"RETENTION_PERIOD": "2 DAYS"})
    t.append(days(spark))
    t.flush(NOW)
    assert len(t.snapshot().sealed) > 12
    return t


def test_chunks_of_several_files(split):
    found = inspect.chunks_view({"t": split}, NOW).orderBy("bucket_start").collect()
    assert [(r.bucket_start.day, r.row_count, r.series, (r.ts_max - r.ts_min).seconds) for r in found] == [(d, 600, 4, 599 * 60) for d in (1, 2, 3)]


def test_a_small_bucket_is_one_file(spark, engine):
    t = engine.create("small", DAYS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t.append(days(spark))
        t.flush(NOW)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(t.snapshot().sealed) == 3


def test_retention_and_compaction_take_chunks_whole(split):
    # The cutoff falls within the second day: its files that end before it stay.
    now = to_us(datetime(2024, 1, 4, 8))
    assert any(to_us(datetime(2024, 1, 2)) <= f.ts_max < now - 2 * 86_400_000_000 for f in split.snapshot().sealed)
    assert maintenance.apply_retention(split, now) == 1 and split.count() == 1200
    files = [f.path for f in split.snapshot().files]
    assert maintenance.compact(split, now=NOW) == 0 and [f.path for f in split.snapshot().files] == files


def test_series_of_a_chunk_that_lost_a_file(split):
    first = split.snapshot().chunks[0]
    lost = next(f for f in split.snapshot().sealed if f.chunk == first.path)
    path = f"{split.store.root}/{lost.path}".removeprefix("file://")
    open(path, "ab").write(b"x")
    assert maintenance.recover(split)["quarantined"] == 1
    left = split.snapshot().chunks[0]
    assert left.rows == 600 - lost.rows and left.series == split.scan(None, first.ts_max).select("host").distinct().count()


def test_series_ids_follow_arrival_through_a_flush(spark, engine):
    t = engine.create("f", DAYS, {"MEMTABLE_SIZE": 1 << 20})
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    rows = spark.range(60_000).select(at.alias("ts"), F.concat(F.lit("h"), F.lit(99) - F.col("id") % 7).alias("host"), F.lit(1.0).alias("value"))
    t.append(rows.coalesce(1))  # which fills the table, and flushes it
    assert not t.snapshot().pending
    assert [r.host for r in t.series().orderBy("series_id").collect()] == [f"h{99 - i}" for i in range(7)]
