import pytest
from pyspark.sql import types as T

from tidemark.errors import InvalidArgError, UnsupportedError
from tidemark.sources.schema import TableDef, is_tag, tag

TS = T.StructField("ts", T.TimestampNTZType(), False)
V = T.StructField("v", T.IntegerType())


def of(*fields, **how):
    return TableDef(T.StructType([*fields]), **how)


def test_definition():
    d = of(TS, tag("host"), V, options={"chunk_interval": "1 hours"}, indexes=["ts"])
    assert (d.ts_column, d.tags, d.interval.name, d.ntz) == ("ts", ["host"], "1 HOUR", True)
    assert TableDef.from_json(d.to_json()).fingerprint == d.fingerprint != of(TS, V).fingerprint
    assert is_tag(T.StructField("x", T.StringType(), True, {"comment": " tag "}))


@pytest.mark.parametrize(
    ("fields", "how", "kind"),
    [
        ((TS, V), {"options": {"TIMESTAMP_COLUMN": "nope"}}, InvalidArgError),
        ((V,), {}, InvalidArgError),
        ((TS, V), {"options": {"TIMESTAMP_COLUMN": "v"}}, InvalidArgError),
        ((T.StructField("ts", T.TimestampNTZType(), True),), {}, InvalidArgError),
        ((TS, V), {"indexes": ["ts", "v"]}, InvalidArgError),
        ((TS, V), {"indexes": []}, InvalidArgError),
        ((TS, V), {"unique": ["ts"]}, UnsupportedError),
        ((TS, V), {"auto_increment": "v"}, UnsupportedError),
        ((T.StructField("ts", T.TimestampNTZType(), False, {"tag": True}), V), {}, InvalidArgError),
        ((TS, T.StructField("a", T.ArrayType(T.IntegerType()))), {}, UnsupportedError),
        ((TS, V), {"options": {"CHUNK_INTERVAL": "2 HOUR"}}, InvalidArgError),
        ((TS, V), {"options": {"RETENTION_PERIOD": "soon"}}, InvalidArgError),
        ((TS, V), {"options": {"COMPRESSION": "GZIP"}}, InvalidArgError),
        ((TS, V), {"options": {"COMPRESSION_LEVEL": 20}}, InvalidArgError),
        ((TS, V), {"options": {"MEMTABLE_SIZE": 4096}}, InvalidArgError),
        ((TS, V), {"options": {"ENCRYPTION": "YES"}}, UnsupportedError),
        ((TS, V), {"options": {"COLOUR": 1}}, InvalidArgError),
        ((TS, V), {"partition_by": ["v"]}, UnsupportedError),
        ((TS, V), {"generated": ["v"]}, UnsupportedError),
        ((TS, *(T.StructField(f"c{i}", T.IntegerType()) for i in range(4096))), {}, InvalidArgError),
        ((TS, V, T.StructField("V", T.IntegerType())), {}, InvalidArgError),
    ],
)
def test_refused(fields, how, kind):
    with pytest.raises(kind):
        of(*fields, **how)
