"""Storage, manifests, Arrow schemas."""

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from sedimenta.errors import Conflict, NotSupported
from sedimenta.sources.arrow import spark_schema, spark_type
from sedimenta.sources.catalog import Client
from sedimenta.sources.storage import Storage, Versioned


def test_storage(spark, tmp_path):
    s = Storage(spark, f"file://{tmp_path}/store")
    assert not s.exists("a/b.txt") and s.list("a") == []
    s.create("a/b.txt", "täxt")
    assert s.exists("a/b.txt") and s.read("a/b.txt") == "täxt"
    with pytest.raises(Conflict):
        s.create("a/b.txt", "other")
    s.create("a/b.txt", "other", overwrite=True)
    assert [(n, size, folder) for n, size, _, folder in s.list("a")] == [("b.txt", 5, False)]
    assert s.delete("a/b.txt") and not s.delete("a/b.txt")
    s.create("a/c/d.txt", "")
    assert s.remove_dir_all("a") and not s.exists("a/c")


def test_versions(spark, tmp_path):
    v = Versioned(Storage(spark, f"file://{tmp_path}/store"), "m", keep=3)
    assert v.load() == (0, None)
    for i in range(6):
        assert v.publish(i, {"n": i}) == i + 1
    assert v.load() == (6, {"n": 5}) and v.versions() == [4, 5, 6]
    with pytest.raises(Conflict):
        v.publish(5, {})


def test_arrow(spark):
    fields = [("u1", pa.uint8(), "smallint"), ("u8", pa.uint64(), "decimal(20,0)"), ("s", pa.timestamp("s"), "timestamp_ntz"), ("z", pa.timestamp("us", "UTC"), "timestamp"), ("ns", pa.timestamp("ns"), "bigint"), ("d", pa.date64(), "timestamp_ntz"), ("t", pa.time32("ms"), "bigint"), ("f", pa.binary(16), "binary"), ("v", pa.string_view(), "string"), ("l", pa.list_(pa.float32(), 4), "array<float>"), ("e", pa.decimal128(38, 10), "decimal(38,10)")]
    schema = spark_schema(pa.schema([pa.field(n, t, metadata={"k": "v"}) for n, t, _ in fields]))
    assert [f.dataType.simpleString() for f in schema] == [want for *_, want in fields]
    c = Client(spark)
    c.create_namespace("arrow")
    t = c.create_table("arrow", "all", schema)
    t.insert(spark.createDataFrame([(None,) * len(fields)], schema))
    assert t.count() == 1 and t.schema["u1"].metadata == {"k": "v"}
    for bad in (pa.struct([("a", pa.int8())]), pa.map_(pa.string(), pa.int8()), pa.duration("s"), pa.float16(), pa.dictionary(pa.int8(), pa.string()), pa.null(), pa.decimal256(76, 10)):
        with pytest.raises(NotSupported):
            spark_type(bad)
    assert spark_type(pa.list_(pa.field("x", pa.int64(), nullable=False))) == T.ArrayType(T.LongType(), False)
