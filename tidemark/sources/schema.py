"""Definition of a table: its columns, its time axis, its tags, its options."""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..errors import InvalidArgError, UnsupportedError
from ..functions.periods import ChunkInterval, Codecs, Period, Retention, normalise

MAX_COLUMNS = 4096
MIB = 1 << 20
DEFAULTS = {"CHUNK_INTERVAL": "1 DAY", "RETENTION_PERIOD": "FOREVER", "HOT_THRESHOLD": "7 DAYS", "COMPRESSION": "ZSTD", "COMPRESSION_LEVEL": 3, "MEMTABLE_SIZE": 64 * MIB, "TIMESTAMP_COLUMN": None, "ENCRYPTION": "NO", "ENCRYPTION_KEY_ID": 1}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


def is_tag(f: T.StructField) -> bool:
    """Tagged by metadata {"tag": true}, or by the comment TAG."""
    return bool(f.metadata.get("tag")) or str(f.metadata.get("comment", "")).strip().upper() == "TAG"


def tag(name: str, kind: T.DataType | None = None, nullable: bool = True) -> T.StructField:
    return T.StructField(name, kind or T.StringType(), nullable, {"tag": True})


@dataclass
class TableDef:
    """A validated definition. `indexes` lists the columns that are indexed;
    only the axis may be."""

    schema: T.StructType
    options: dict = field(default_factory=dict)
    indexes: list[str] | None = None
    unique: list[str] = field(default_factory=list)
    auto_increment: str | None = None
    partition_by: list[str] = field(default_factory=list)
    generated: list[str] = field(default_factory=list)
    foreign_keys: list[str] = field(default_factory=list)
    fulltext: list[str] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        unknown = {k.upper() for k in self.options} - set(DEFAULTS)
        if unknown:
            raise InvalidArgError(f"unknown option {min(unknown)}")
        o = DEFAULTS | {k.upper(): v for k, v in self.options.items()}
        names = self.schema.fieldNames()
        lower = [n.lower() for n in names]
        if not 1 <= len(names) <= MAX_COLUMNS:
            raise InvalidArgError(f"a table has 1 to {MAX_COLUMNS} columns")
        if len(set(lower)) < len(lower):
            raise InvalidArgError("two columns have one name")
        if any(n.startswith("__") for n in names):
            raise InvalidArgError("column names must not begin with __")
        for what, refused in (("PARTITION BY", self.partition_by), ("generated columns", self.generated), ("foreign keys", self.foreign_keys), ("FULLTEXT indexes", self.fulltext)):
            if refused:
                raise UnsupportedError(f"{what} are not supported: buckets of the time axis divide a table")
        if self.unique:
            raise UnsupportedError("UNIQUE and PRIMARY keys are not supported: equal rows are kept")
        if self.auto_increment:
            raise UnsupportedError("AUTO_INCREMENT is not supported")
        if normalise(str(o["ENCRYPTION"])) not in ("NO", "OFF", "N"):
            raise UnsupportedError("ENCRYPTION needs a key service; none is configured")
        self.ts_column = self._axis(o["TIMESTAMP_COLUMN"])
        axis = self.schema[self.ts_column]
        if not isinstance(axis.dataType, (T.TimestampNTZType, T.TimestampType)):
            raise InvalidArgError(f"time axis {self.ts_column} must be a timestamp")
        if axis.nullable:
            raise InvalidArgError(f"time axis {self.ts_column} must be NOT NULL")
        if is_tag(axis):
            raise InvalidArgError(f"time axis {self.ts_column} can't be a TAG")
        if self.indexes is not None:
            if self.ts_column not in self.indexes:
                raise InvalidArgError(f"an index on the time axis {self.ts_column} is missing")
            if set(self.indexes) - {self.ts_column}:
                raise InvalidArgError("only the time axis can be indexed")
        for f in self.schema:
            if isinstance(f.dataType, _NESTED) or isinstance(f.dataType, (T.NullType,)):
                raise UnsupportedError(f"column {f.name}: type {f.dataType.simpleString()} is not supported")
            if type(f.dataType).__name__ in ("GeometryType", "GeographyType"):
                raise UnsupportedError(f"column {f.name}: spatial types are not supported")
        self.interval = ChunkInterval.parse(str(o["CHUNK_INTERVAL"]))
        self.retention = Retention.parse(str(o["RETENTION_PERIOD"]))
        self.hot_threshold = Period.parse(str(o["HOT_THRESHOLD"]))
        self.codecs = Codecs.parse(str(o["COMPRESSION"]), int(o["COMPRESSION_LEVEL"]))
        self.memtable_size = int(o["MEMTABLE_SIZE"])
        if not MIB <= self.memtable_size <= 96 * MIB:
            raise InvalidArgError("MEMTABLE_SIZE must be from 1 to 96 MiB")
        self.resolved = o
        self.tags = [f.name for f in self.schema if is_tag(f)]
        self.ntz = isinstance(axis.dataType, T.TimestampNTZType)

    def _axis(self, wanted: str | None) -> str:
        if wanted:
            found = next((n for n in self.schema.fieldNames() if n.lower() == wanted.lower()), None)
            if found is None:
                raise InvalidArgError(f"TIMESTAMP_COLUMN {wanted} is not a column")
            return found
        for n in self.indexes if self.indexes is not None else self.schema.fieldNames():
            f = next((f for f in self.schema if f.name == n), None)
            if f is not None and isinstance(f.dataType, (T.TimestampNTZType, T.TimestampType)):
                return n
        raise InvalidArgError("no indexed timestamp column")

    @property
    def fingerprint(self) -> int:
        """CRC-32 of names and types: files of another layout are refused."""
        layout = [(f.name, f.dataType.simpleString(), f.nullable, is_tag(f)) for f in self.schema]
        return zlib.crc32(json.dumps(layout).encode())

    def to_json(self) -> dict:
        return {"schema": json.loads(self.schema.json()), "options": {k: v for k, v in self.resolved.items() if v is not None} | {"TIMESTAMP_COLUMN": self.ts_column}, "checks": self.checks, "fingerprint": self.fingerprint}

    @classmethod
    def from_json(cls, d: dict) -> TableDef:
        return cls(T.StructType.fromJson(d["schema"]), d["options"], checks=d.get("checks", []))
