"""A table: rows in Parquet files that a manifest lists.

Appends write pending files as rows arrive. A flush rewrites them sorted by
series and time into sealed chunks, each of one time bucket. Readers prune files
by the manifest, then let Spark push filters and columns to those left. Ordered
reads follow (time, source, ordinal): sealed files sort before pending ones, and
files and rows by arrival; folder names are made so that path order is that.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConflictError, CorruptError, InvalidArgError, NotFoundError, ReadOnlyError, UnsupportedError
from ..functions import buckets
from ..functions.periods import FIRST_US, PARQUET, parse_bound
from ..operators import series as S
from ..operators import tagfilter
from .manifest import FileEntry, Manifest, Store, Versions
from .schema import TableDef

DATA = "data"
#: Rows and plain bytes of a file at most; of pending files, whose rows are not
#: measured yet, so many rows.
MAX_RECORDS, MAX_FILE_BYTES, PENDING_RECORDS = 1 << 27, 128 << 20, 1 << 20
LEASES, SERIES = "_leases", "_series"
RETRIES = 16
SOURCE, ORDINAL = "__source", "__ordinal"


def now_us() -> int:
    return time.time_ns() // 1000


def data_name(path: str) -> str:
    """What of a path is below the data folder: files of different buckets may
    share their last names."""
    return f"/{path}".rsplit(f"/{DATA}/", 1)[-1]


def value_bytes(f: T.StructField) -> Column:
    """Plain size of a value: 8 for numbers and times, 4 for floats, 1 for
    booleans, 4 and the bytes for text; nulls take none."""
    c = F.col(f.name)
    if isinstance(f.dataType, (T.StringType, T.BinaryType, T.DecimalType)):
        size = F.octet_length(c.cast("string") if isinstance(f.dataType, T.DecimalType) else c) + 4
    else:
        size = F.lit(1 if isinstance(f.dataType, T.BooleanType) else 4 if isinstance(f.dataType, T.FloatType) else 8)
    return F.when(c.isNotNull(), size).otherwise(0)


class Table:
    def __init__(self, spark: SparkSession, root: str, bloom_rate: float = 0.01) -> None:
        self.spark, self.store, self.bloom_rate = spark, Store(spark, root), bloom_rate
        self.versions = Versions(self.store)
        self.definition = TableDef.from_json(self.versions.read().definition)

    @classmethod
    def create(cls, spark: SparkSession, root: str, definition: TableDef, bloom_rate: float = 0.01) -> Table:
        store = Store(spark, root)
        if store.list(""):
            raise InvalidArgError("the table's folder is not empty")
        if not store.create(f"{Versions.FOLDER}/v{0:09d}.json", Manifest(0, definition.to_json()).dumps()):
            raise ConflictError("the table exists")
        return cls(spark, root, bloom_rate)

    # --- what the definition gives

    @property
    def ts(self) -> str:
        return self.definition.ts_column

    @property
    def tags(self) -> list[str]:
        return self.definition.tags

    @property
    def schema(self) -> T.StructType:
        return self.definition.schema

    def micros(self) -> Column:
        return buckets.micros(F.col(self.ts), self.definition.ntz)

    def snapshot(self, version: int | None = None) -> Manifest:
        m = self.versions.read(version)
        if m.definition["fingerprint"] != self.definition.fingerprint:
            self.definition = TableDef.from_json(m.definition)
        return m

    @property
    def version(self) -> int:
        return self.snapshot().version

    # --- writing

    def conform(self, df: DataFrame) -> DataFrame:
        """df with the table's columns and types; missing columns have their
        default (metadata "default"), nullable ones without are null, others are
        an error."""
        have = {c.lower(): c for c in df.columns}
        extra = set(have) - {f.name.lower() for f in self.schema}
        if extra:
            raise InvalidArgError(f"no column {min(extra)}")
        out = []
        for f in self.schema:
            if f.name.lower() in have:
                out.append(F.col(f"`{have[f.name.lower()]}`").cast(f.dataType).alias(f.name, metadata=f.metadata))
            elif "default" in f.metadata:
                out.append(F.lit(f.metadata["default"]).cast(f.dataType).alias(f.name, metadata=f.metadata))
            elif f.nullable:
                out.append(F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata))
            else:
                raise InvalidArgError(f"column {f.name} has no default")
        return df.select(*out)

    def _folder(self, sealed: bool, at: int) -> str:
        """A new folder for files, held by a lease until they are committed:
        vacuum leaves folders with a lease alone."""
        name = f"{'a' if sealed else 'p'}{at:012d}-{uuid.uuid4().hex[:8]}"
        self.store.create(f"{LEASES}/{name}", str(now_us()))
        return f"{DATA}/{name}"

    def release(self, entries: list[FileEntry]) -> None:
        for name in {e.path.split("/")[1] for e in entries}:
            self.store.delete(f"{LEASES}/{name}")

    def _write(self, df: DataFrame, folder: str, codec: str, by_bucket: bool = False, records: int = PENDING_RECORDS) -> list[FileEntry]:
        out = df.write.option("compression", PARQUET[codec]).option("maxRecordsPerFile", records)
        if codec == "ZSTD":
            out = out.option("parquet.compression.codec.zstd.level", str(self.definition.codecs.level))
        for t in self.tags:
            if isinstance(self.schema[t].dataType, T.StringType):
                out = out.option(f"parquet.bloom.filter.enabled#{t}", "true").option(f"parquet.bloom.filter.fpp#{t}", str(self.bloom_rate))
        try:
            (out.partitionBy("__bucket") if by_bucket else out).parquet(f"{self.store.root}/{folder}")
            return self._entries(folder, codec, by_bucket)
        except Exception:
            self.store.delete(f"{LEASES}/{folder.rsplit('/', 1)[-1]}")
            raise

    def _entries(self, folder: str, codec: str, sealed: bool) -> list[FileEntry]:
        """One entry for each file of a folder, from its time and tag columns."""
        sizes = self.store.walk(folder)
        files = sorted(sizes)
        if not files:
            return []
        rows = self._read(files, meta=True)
        size = sum((value_bytes(f) for f in self.schema), F.lit(0))
        us = self.micros()
        required = [f.name for f in self.schema if not f.nullable]
        lost = F.sum(sum((F.col(c).isNull().cast("long") for c in required), F.lit(0)))
        bad = F.sum(sum(((~F.expr(c)).cast("long") for c in self.definition.checks), F.lit(0)))
        found = rows.groupBy(SOURCE).agg(F.count(F.lit(1)).alias("rows"), S.count_series(self.tags).alias("series"), F.min(us).alias("lo"), F.max(us).alias("hi"), F.sum(size).alias("size"), lost.alias("lost"), bad.alias("bad")).collect()
        by_name = {data_name(r[SOURCE]): r for r in found}
        sums = self.checksums(files)
        out = []
        for p in files:
            r = by_name.get(data_name(p))
            if r is None:  # an empty file holds no rows to list
                continue
            if r["lost"]:
                raise InvalidArgError("a NOT NULL column got a null")
            if r["bad"]:
                raise InvalidArgError("a row violates a CHECK constraint")
            i = self.definition.interval
            out.append(FileEntry(0, p, sealed, r["rows"], r["series"], r["lo"], r["hi"], sizes[p], codec, int(r["size"]), i.start(r["lo"]) if sealed else None, i.end(r["lo"]) if sealed else None, checksum=sums[data_name(p)]))
        return out

    def checksums(self, files: list[str]) -> dict[str, int]:
        """CRC-32 of each file that can be read, by its data name."""
        if not files:
            return {}
        read = self.spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load([f"{self.store.root}/{p}" for p in files])
        return {data_name(r[0]): r[1] for r in read.select("path", F.crc32("content")).collect()}

    def commit(self, change, retries: int = RETRIES) -> Manifest:
        """Commits change(manifest) -> changed fields; tried again when another
        writer was first. Without changes (None) nothing is committed."""
        for _ in range(retries):
            old = self.snapshot()
            changes = change(old)
            if changes is None:
                return old
            try:
                return self.versions.commit(old, **changes)
            except ConflictError:
                continue
        raise ConflictError("other writers kept committing first")

    def _staged(self, df: DataFrame) -> list[FileEntry]:
        at = self.snapshot().next_id
        return self._write(self.conform(df), self._folder(False, at), self.definition.codecs.of(True))

    def _publish(self, entries: list[FileEntry], batch_id: str | None, epoch: int | None = None) -> Manifest:
        """Lists staged files, which must still be there. A batch id that another
        writer has committed meanwhile is passed over, and its files dropped."""
        self._must_exist(entries)

        def change(m: Manifest) -> dict | None:
            if batch_id and m.has_batch(batch_id):
                return None
            if epoch is not None and m.epoch != epoch:
                raise InvalidArgError("the table was truncated while the batch was open")
            new = tuple(replace(e, id=m.next_id + n) for n, e in enumerate(entries))
            return {"files": m.files + new, "next_id": m.next_id + len(new), "batches": m.with_batch(batch_id)}

        out = self.commit(change)
        self.release(entries)
        return out

    def _must_exist(self, entries: list[FileEntry]) -> None:
        lost = [e for e in entries if not self.store.exists(e.path)]
        if lost:
            raise CorruptError(f"{len(lost)} staged files are missing")

    def flush_if_full(self, now: int | None = None) -> Manifest:
        """Flushes once pending rows reach MEMTABLE_SIZE, in plain bytes."""
        m = self.snapshot()
        return self.flush(now) if sum(f.data_bytes for f in m.pending) >= self.definition.memtable_size else m

    def append(self, df: DataFrame, batch_id: str | None = None, now: int | None = None) -> Manifest:
        """Adds all rows, or none if one is refused. A batch id that was
        committed before is passed over. Should this fill the table's memory,
        rows are sealed as of now."""
        m = self.snapshot()
        if batch_id and m.has_batch(batch_id):
            return m
        self._publish(self._staged(df), batch_id)
        return self.flush_if_full(now)

    @contextmanager
    def batch(self) -> Iterator[Batch]:
        """Several writes that become visible at once; an error drops them all."""
        b = Batch(self)
        try:
            yield b
        except Exception:
            b.abort()
            raise
        b.commit()

    def truncate(self) -> Manifest:
        """Empties the table: series start anew, file ids go on."""
        return self.commit(lambda m: {"files": (), "epoch": m.epoch + 1, "no_gain": ()})

    def delete(self, where: str | None = None) -> Manifest:
        """All rows without a condition; nothing under one that is never true."""
        if where is None:
            return self.truncate()
        if where.replace(" ", "").lower() in ("1=0", "false"):
            return self.snapshot()
        raise ReadOnlyError("rows can't be deleted one by one: tables are append-only")

    def update(self, *_, **__) -> None:
        raise ReadOnlyError("rows can't be updated: tables are append-only")

    def handler(self, *_, **__) -> None:
        raise UnsupportedError("the HANDLER interface is not supported; use at(), first(), last() or scan()")

    def flush(self, now: int | None = None) -> Manifest:
        """Seals pending rows: one or more chunks for each bucket. Series get
        their ids before, as sealed rows no longer tell their arrival."""
        now = now_us() if now is None else now
        old = self.snapshot()
        taken = old.pending
        if not taken:
            return old
        if self.tags:
            self._dimension()
        entries = self.seal(taken, now)
        self._must_exist(entries)

        def change(m: Manifest) -> dict:
            if not {f.path for f in taken} <= {f.path for f in m.files}:
                raise InvalidArgError("pending rows changed during the flush")
            gone = {f.path for f in taken}
            new = tuple(replace(e, id=m.next_id + n) for n, e in enumerate(entries))
            return {"files": tuple(f for f in m.files if f.path not in gone) + new, "next_id": m.next_id + len(new)}

        out = self.commit(change)
        self.release(entries)
        return out

    def seal(self, files: list[FileEntry], now: int) -> list[FileEntry]:
        """Chunks of the rows of files, sorted by series and time, ties by
        arrival. Hot and cold buckets differ in codec and are written apart. The
        exchange ranges over buckets, so a chunk is one file; one that is too
        large for a file is dealt by series and time as well, to many tasks."""
        i, out = self.definition.interval, []
        lo, hi = min(i.start(f.ts_min) for f in files), max(i.start(f.ts_max) for f in files)
        # The first hot bucket is the one that the threshold falls in.
        line = self.definition.hot_threshold.before(now)
        edge = i.start(line) if line >= FIRST_US else lo
        rows = self._read([f.path for f in files], meta=True).withColumn("__us", buckets.bucket_start_us(self.micros(), i))
        width = sum(f.data_bytes for f in files) / max(1, sum(f.rows for f in files))
        records = max(1, min(MAX_RECORDS, int(MAX_FILE_BYTES / max(width, 1))))
        large = []
        if sum(f.rows for f in files) > records:
            large = [r[0] for r in rows.groupBy("__us").count().where(F.col("count") > records).collect()]
        parts = [(F.col("__us") < edge, False)] * (lo < edge) + [(F.col("__us") >= edge, True)] * (hi >= edge)
        for where, is_it in parts:
            order = [*self.tags, self.ts]
            dealt = ["__us", *(F.when(F.col("__us").isin(large), F.col(c)) for c in order if large)]
            # The writer wants rows by bucket; it sorts them anew, and loses the
            # order of arrival, unless a column that is never null says so.
            bucket = F.coalesce(buckets.compact_name(F.col("__us")), F.lit(""))
            sorted_rows = rows.where(where).withColumn("__bucket", bucket).repartitionByRange(*dealt).sortWithinPartitions("__bucket", *order, SOURCE, ORDINAL)
            entries = self._write(sorted_rows.drop("__us", SOURCE, ORDINAL), self._folder(True, self.snapshot().next_id), self.definition.codecs.of(is_it), by_bucket=True, records=records)
            out += [replace(e, sealed_at=now) for e in self.shared_series(entries)]
        return sorted(out, key=lambda e: (e.start, e.path))

    def shared_series(self, entries: list[FileEntry]) -> list[FileEntry]:
        """Sealed files with the number of series that earlier ones of the chunk
        have; only files that share a chunk are read, for their tags."""
        files: dict[str, list[FileEntry]] = defaultdict(list)
        for e in entries:
            files[e.chunk].append(e)
        split = [e for es in files.values() if len(es) > 1 for e in es]
        new = {}
        if split:
            rows = self._read([e.path for e in split], meta=True).withColumn("__path", F.regexp_extract(SOURCE, rf".*/{DATA}/(.*)$", 1))
            chunk = F.regexp_extract("__path", r"^(.*)/", 1)
            first = rows.groupBy(chunk.alias("__chunk"), *self.tags).agg(F.min("__path").alias("__path"))
            new = {r["__path"]: r["count"] for r in first.groupBy("__path").count().collect()}
        several = {e.path for e in split}
        return [replace(e, shared=e.series - new.get(data_name(e.path), 0) if e.path in several else 0) for e in entries]

    # --- reading

    def _read(self, paths: list[str], meta: bool = False) -> DataFrame:
        kept = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in self.schema])
        if not paths:
            df = self.spark.createDataFrame([], kept)
            return df.withColumns({SOURCE: F.lit(""), ORDINAL: F.lit(0).cast("long")}) if meta else df
        df = self.spark.read.schema(kept).parquet(*[f"{self.store.root}/{p}" for p in paths])
        return df.select("*", F.col("_metadata.file_path").alias(SOURCE), F.col("_metadata.row_index").alias(ORDINAL)) if meta else df

    def _literal(self, us: int) -> Column:
        return buckets.from_micros(F.lit(us).cast("long"), self.definition.ntz)

    @staticmethod
    def _bound(x: int | str | None) -> int | None:
        return parse_bound(x) if isinstance(x, str) else x

    def pruned(self, lo: int | None = None, hi: int | None = None, version: int | None = None) -> list[FileEntry]:
        """Files that may hold rows within [lo, hi]."""
        return [f for f in self.snapshot(version).files if (hi is None or f.ts_min <= hi) and (lo is None or f.ts_max >= lo)]

    def scan(self, ts_min: int | str | None = None, ts_max: int | str | None = None, tags: dict | None = None, collation: str | None = None, series: DataFrame | None = None, sorted: bool = False, desc: bool = False, version: int | None = None, positions: bool = False) -> DataFrame:
        """Rows of a version within [ts_min, ts_max], both included, whose tags
        fit, and whose series are those given (a DataFrame of tag values)."""
        lo, hi = self._bound(ts_min), self._bound(ts_max)
        rows = self._read([f.path for f in self.pruned(lo, hi, version)], meta=sorted or positions)
        if lo is not None:
            rows = rows.where(F.col(self.ts) >= self._literal(lo))
        if hi is not None:
            rows = rows.where(F.col(self.ts) <= self._literal(hi))
        for t in tags or {}:
            if t not in self.schema.fieldNames():
                raise NotFoundError(f"no column {t}")
        if tags and collation:
            rows = tagfilter.resolve_series(rows, self.series(version), tags, collation)
        elif tags:
            rows = rows.where(tagfilter.tag_predicate(tags))
        if series is not None:
            rows = rows.join(series, S.same_series(rows, series, self.tags), "left_semi")
        if sorted:
            rows = rows.orderBy(*self.order(desc))
        return rows if positions else rows.drop(SOURCE, ORDINAL)

    def order(self, desc: bool = False) -> list[Column]:
        keys = [F.col(self.ts), F.regexp_extract(SOURCE, rf".*/{DATA}/(.*)$", 1), F.col(ORDINAL)]
        return [k.desc() if desc else k.asc() for k in keys]

    def df(self, version: int | None = None, invisible: bool = False) -> DataFrame:
        """All rows, without invisible columns (metadata "invisible") unless
        they are asked for."""
        hidden = [] if invisible else [f.name for f in self.schema if f.metadata.get("invisible")]
        return self.scan(version=version).drop(*hidden)

    def as_of(self, version: int) -> DataFrame:
        return self.scan(version=version)

    def fetch(self, positions: DataFrame, version: int | None = None) -> DataFrame:
        """Rows at positions (source, ordinal) of a version, as scan() with
        positions tells them."""
        p = positions.select(F.col(SOURCE), F.col(ORDINAL)).distinct()
        return self.scan(version=version, positions=True).join(p, [SOURCE, ORDINAL], "left_semi").select(*self.schema.fieldNames())

    def latest(self, n: int, tags: dict | None = None, desc: bool = True, version: int | None = None) -> DataFrame:
        """The n newest rows (or oldest), newest first. Files are taken from the
        newest on, until what they hold for certain is n rows; with predicates,
        until n rows fit."""
        files = self.snapshot(version).files
        if n <= 0 or not files:
            return self.scan(version=version, sorted=True, desc=desc).limit(0)
        far = (lambda f: f.ts_min) if desc else (lambda f: -f.ts_max)
        wanted = n
        while True:
            # Rows at the edge's side of it are all in files that reach it.
            edge, rows = None, 0
            for f in sorted(files, key=far, reverse=True):
                rows += f.rows
                if rows >= wanted:
                    edge = far(f)
                    break
            bound = None if edge is None else (edge if desc else -edge)
            out = self.scan(bound if desc else None, None if desc else bound, tags, sorted=True, desc=desc, version=version).limit(n)
            if edge is None or not tags or out.count() >= n:
                return out
            wanted *= 4

    #: What each mode of an index lookup means: the side of the key, whether the
    #: key itself counts, and the order.
    MODES = {"EXACT": ("=", False), "PREFIX": ("=", False), "KEY_OR_NEXT": (">=", False), "AFTER_KEY": (">", False), "KEY_OR_PREV": ("<=", True), "BEFORE_KEY": ("<", True), "PREFIX_LAST": ("=", True), "PREFIX_LAST_OR_PREV": ("<=", True)}

    def lookup(self, key: int | str, mode: str = "EXACT", version: int | None = None) -> DataFrame:
        """Rows from a key on, in the order of the mode; exclusive bounds move
        by a microsecond."""
        if mode not in self.MODES:
            raise InvalidArgError(f"unknown mode {mode}")
        side, desc = self.MODES[mode]
        us = self._bound(key)
        lo = {"=": us, ">=": us, ">": us + 1}.get(side)
        hi = {"=": us, "<=": us, "<": us - 1}.get(side)
        return self.scan(lo, hi, sorted=True, desc=desc, version=version)

    def around(self, key: int | str, before: int, after: int, version: int | None = None) -> DataFrame:
        """What a cursor set on a key finds when it goes both ways: `before`
        rows ahead of the key and `after` rows from it on, each way in order."""
        version = self.version if version is None else version
        back, on = self.lookup(key, "BEFORE_KEY", version).limit(before), self.lookup(key, "KEY_OR_NEXT", version).limit(after)
        return back.unionByName(on)

    def at(self, key: int | str) -> DataFrame:
        return self.lookup(key, "EXACT")

    def first(self) -> DataFrame:
        return self.latest(1, desc=False)

    def last(self) -> DataFrame:
        return self.latest(1)

    def bounds(self, version: int | None = None) -> tuple[int, int] | None:
        """Least and greatest time, from the manifest."""
        files = self.snapshot(version).files
        return (min(f.ts_min for f in files), max(f.ts_max for f in files)) if files else None

    def count(self, version: int | None = None) -> int:
        """Number of rows, from the manifest."""
        return sum(f.rows for f in self.snapshot(version).files)

    def _arrivals(self, files: list[FileEntry]) -> DataFrame:
        """Every series of these files with its id, by first arrival: files by
        path, rows by place."""
        rows = self._read([f.path for f in files], meta=True)
        return S.series_index(rows.withColumn("__path", F.regexp_extract(SOURCE, rf".*/{DATA}/(.*)$", 1)), self.tags, ["__path", ORDINAL])

    def _dimension(self) -> dict:
        """The kept series dimension of this epoch, brought up to date: only
        files that came after the last time are read, for their tags, and series
        not known yet get the next ids. Each step is a folder, made known by one
        exclusive file; a writer that comes second takes the first one's."""
        m = self.snapshot()
        steps = sorted(n for n in self.store.list(SERIES) if n.startswith(f"e{m.epoch:06d}-") and n.endswith(".json"))
        last = json.loads(self.store.read(f"{SERIES}/{steps[-1]}")) if steps else {"upto": 0, "count": 0, "paths": []}
        new = [f for f in m.files if f.id > last["upto"]]
        if not new:
            return last
        upto, found = max(f.id for f in new), self._arrivals(new)
        if last["paths"]:
            known = self._known(last)
            found = found.join(known, S.same_series(found, known, self.tags), "left_anti")
            found = found.withColumn("series_id", (F.row_number().over(S.by_id()) - 1 + last["count"]).cast("long"))
        path = f"{SERIES}/{uuid.uuid4().hex}"
        found.coalesce(1).write.parquet(f"{self.store.root}/{path}")
        count = self.spark.read.parquet(f"{self.store.root}/{path}").count()
        now = {"upto": upto, "count": last["count"] + count, "paths": [*last["paths"], path] if count else last["paths"]}
        if not self.store.create(f"{SERIES}/e{m.epoch:06d}-{upto:012d}.json", json.dumps(now)):
            return json.loads(self.store.read(f"{SERIES}/e{m.epoch:06d}-{upto:012d}.json"))
        return now

    def _known(self, dimension: dict) -> DataFrame:
        kept = T.StructType([*(T.StructField(t, self.schema[t].dataType, True) for t in self.tags), T.StructField("series_id", T.LongType())])
        if not dimension["paths"]:
            return self.spark.createDataFrame([], kept)
        return self.spark.read.schema(kept).parquet(*[f"{self.store.root}/{p}" for p in dimension["paths"]])

    def series(self, version: int | None = None) -> DataFrame:
        """Every series with its id, by first arrival. Of the last version from
        the kept dimension, whose ids stay through flush and compaction until the
        table is truncated; of others from their files."""
        if not self.tags:
            return S.series_index(self.scan(version=version, positions=True), [], [ORDINAL])
        if version is not None and version != self.version:
            return self._arrivals(list(self.snapshot(version).files))
        return self._known(self._dimension())

    def series_count(self) -> int:
        """Number of series, without a scan if the dimension is up to date."""
        if not self.tags:
            return int(bool(self.snapshot().files))
        return self._dimension()["count"]

    def verify_files(self, version: int | None = None) -> None:
        """An error if a listed file is missing; one listing."""
        there = self.store.walk(DATA)
        lost = [f for f in self.snapshot(version).files if f.path not in there]
        if lost:
            raise CorruptError(f"{len(lost)} listed files are missing")


class Batch:
    """Writes that are staged and published together."""

    def __init__(self, table: Table) -> None:
        self.table, self.entries, self.epoch, self.open = table, [], table.snapshot().epoch, True

    def write(self, df: DataFrame) -> None:
        if not self.open:
            raise InvalidArgError("the batch is closed")
        self.entries += self.table._staged(df)

    def commit(self) -> None:
        if self.open:
            self.open = False
            if self.entries:
                self.table._publish(self.entries, None, self.epoch)
                self.table.flush_if_full()

    def abort(self) -> None:
        self.table.release(self.entries)
        self.open, self.entries = False, []
