"""Tables by name below one folder: create, open, rename, drop, copy, views."""

from __future__ import annotations

import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .errors import InvalidArgError, NotFoundError
from .operators import inspect, maintenance
from .sources.manifest import Store
from .sources.schema import TableDef
from .sources.table import Table


@dataclass
class EngineConfig:
    """Settings and their ranges; numbers beyond a range are moved into it."""

    compaction_trigger_chunks: int = 10
    retention_check_interval: int = 3600
    bloom_filter_false_positive_rate: float = 0.01
    RANGES = {"compaction_trigger_chunks": (2, 10_000), "retention_check_interval": (0, 1 << 31), "bloom_filter_false_positive_rate": (1e-6, 0.5)}

    def set(self, name: str, value: float) -> bool:
        """Whether the value was taken as it is."""
        if name not in self.RANGES:
            raise InvalidArgError(f"unknown setting {name}")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (isinstance(getattr(self, name), int) and not isinstance(value, int)):
            raise InvalidArgError(f"{name} has another type")
        lo, hi = self.RANGES[name]
        setattr(self, name, min(max(value, lo), hi))
        return lo <= value <= hi


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or EngineConfig()
        self.temporary: dict[str, str] = {}
        self.scheduler: maintenance.Scheduler | None = None

    def _path(self, name: str) -> str:
        name = name.rsplit(".", 1)[-1] if name.count(".") == 1 and name.split(".")[0] in ("", "main") else name
        if name in self.temporary:
            return self.temporary[name]
        if not re.fullmatch(r"[A-Za-z0-9_$]+(?:\.[A-Za-z0-9_$]+)?", name):
            raise InvalidArgError(f"not a table name: '{name}'")
        return f"{self.root}/{name.replace('.', '/')}"

    def create(self, name: str, definition: TableDef | T.StructType, options: dict | None = None, temporary: bool = False) -> Table:
        if isinstance(definition, T.StructType):
            definition = TableDef(definition, options or {})
        if temporary:
            self.temporary[name] = f"{tempfile.gettempdir() if re.match(r'local(\[|$)', self.spark.sparkContext.master) else self.root}/.tmp-{uuid.uuid4().hex}/{name}"
        return Table.create(self.spark, self._path(name), definition, self.config.bloom_filter_false_positive_rate)

    def open(self, name: str) -> Table:
        """The table; an error if a listed file is missing."""
        t = Table(self.spark, self._path(name), self.config.bloom_filter_false_positive_rate)
        t.verify_files()
        return t

    def exists(self, name: str) -> bool:
        return bool(Store(self.spark, self._path(name)).list("_manifest"))

    def drop(self, name: str) -> None:
        if not self.exists(name):
            raise NotFoundError(f"no table {name}")
        Store(self.spark, self._path(name)).delete()
        self.temporary.pop(name, None)

    def rename(self, name: str, to: str) -> None:
        if not self.exists(name):
            raise NotFoundError(f"no table {name}")
        if self.exists(to):
            raise InvalidArgError(f"table {to} exists")
        store = Store(self.spark, self._path(name))
        target = store.jvm.org.apache.hadoop.fs.Path(self._path(to))
        store.fs.mkdirs(target.getParent())
        if not store.fs.rename(store.path(), target):
            raise NotFoundError(f"table {name} can't be renamed")

    def swap(self, a: str, b: str) -> None:
        """Two tables change names."""
        c = f"swap_{uuid.uuid4().hex}"
        self.rename(a, c)
        self.rename(b, a)
        self.rename(c, b)

    def create_like(self, name: str, other: str) -> Table:
        return self.create(name, TableDef.from_json(self.open(other).snapshot().definition))

    def create_as(self, name: str, definition: TableDef | T.StructType, rows: DataFrame, options: dict | None = None) -> Table:
        t = self.create(name, definition, options)
        try:
            t.append(rows)
        except Exception:
            self.drop(name)
            raise
        return t

    def alter(self, name: str, definition: TableDef, select: list[str] | None = None) -> Table:
        """A table of another definition takes the name; its rows are copied,
        through the given expressions if any."""
        rows = self.open(name).df(invisible=True)
        own = f"alter_{uuid.uuid4().hex}"
        self.create_as(own, definition, rows.selectExpr(*select) if select else rows)
        self.swap(name, own)
        self.drop(own)
        return self.open(name)

    #: Times are written and read to the microsecond.
    TIMES = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]"}

    def load_csv(self, name: str, path: str, sep: str = "\t", header: bool = False) -> None:
        t = self.open(name)
        t.append(self.spark.read.schema(t.schema).option("sep", sep).option("header", header).option("nullValue", "\\N").option("mode", "FAILFAST").options(**self.TIMES).csv(path))

    def export_csv(self, rows: DataFrame, path: str, sep: str = "\t") -> None:
        rows.write.option("sep", sep).option("nullValue", "\\N").options(**self.TIMES).csv(path)

    def names(self) -> list[str]:
        """Lasting tables."""
        store, out = Store(self.spark, self.root), []
        for n in store.list(""):
            if store.exists(f"{n}/_manifest"):
                out.append(n)
            elif not n.startswith("."):
                out += [f"{n}.{x}" for x in store.list(n) if store.exists(f"{n}/{x}/_manifest")]
        return sorted(out)

    def tables(self, now: int | None = None) -> DataFrame:
        return inspect.tables_view({n: self.open(n) for n in self.names()}, now)

    def chunks(self, now: int | None = None) -> DataFrame:
        return inspect.chunks_view({n: self.open(n) for n in self.names()}, now)

    def compact(self, name: str, lo: str | None = None, hi: str | None = None, now: int | None = None) -> int:
        return maintenance.compact(self.open(name), lo, hi, now)

    def apply_retention(self, name: str, now: int | None = None) -> int:
        return maintenance.apply_retention(self.open(name), now)

    def start_maintenance(self) -> None:
        """Background rounds; never started by itself. An interval of 0 is off."""
        if self.config.retention_check_interval and self.scheduler is None:
            self.scheduler = maintenance.Scheduler(lambda: {n: self.open(n) for n in self.names()}, self.config.retention_check_interval, self.config.compaction_trigger_chunks)
            self.scheduler.start()

    def stop_maintenance(self) -> None:
        if self.scheduler:
            self.scheduler.stop()
            self.scheduler = None
