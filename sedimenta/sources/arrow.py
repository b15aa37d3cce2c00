"""Spark types for Arrow schemas, so that tables described in Arrow can be made here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

from ..errors import NotSupported


def spark_type(kind: pa.DataType) -> T.DataType:
    """The narrowest Spark type that holds every value. Unsigned integers widen (64 bits: decimal(20,0)), timestamps in
    nanoseconds and times of day (Spark's type for these is off by default) stay exact as bigint in their unit; structs, maps, unions, intervals, durations, half floats and
    dictionaries aren't part of the data model."""
    t = pa.types
    simple = [
        (t.is_boolean, T.BooleanType()), (t.is_int8, T.ByteType()), (t.is_int16, T.ShortType()), (t.is_int32, T.IntegerType()), (t.is_int64, T.LongType()),
        (t.is_uint8, T.ShortType()), (t.is_uint16, T.IntegerType()), (t.is_uint32, T.LongType()), (t.is_uint64, T.DecimalType(20, 0)),
        (t.is_float32, T.FloatType()), (t.is_float64, T.DoubleType()), (t.is_date32, T.DateType()), (t.is_date64, T.TimestampNTZType()),
        (t.is_string, T.StringType()), (t.is_large_string, T.StringType()), (t.is_string_view, T.StringType()),
        (t.is_binary, T.BinaryType()), (t.is_large_binary, T.BinaryType()), (t.is_binary_view, T.BinaryType()), (t.is_fixed_size_binary, T.BinaryType()),
    ]
    for test, out in simple:
        if test(kind):
            return out
    if t.is_timestamp(kind):
        return T.LongType() if kind.unit == "ns" else T.TimestampType() if kind.tz else T.TimestampNTZType()
    if t.is_time(kind):
        return T.LongType()
    if t.is_decimal(kind):
        if kind.precision > 38:
            raise NotSupported(f"{kind}: more than 38 digits")
        return T.DecimalType(kind.precision, kind.scale)
    if t.is_list(kind) or t.is_large_list(kind) or t.is_fixed_size_list(kind) or t.is_list_view(kind) or t.is_large_list_view(kind):
        return T.ArrayType(spark_type(kind.value_type), kind.value_field.nullable)
    raise NotSupported(str(kind))


def spark_schema(schema: pa.Schema) -> T.StructType:
    """Fields with their nullability and string metadata."""
    return T.StructType([T.StructField(f.name, spark_type(f.type), f.nullable, {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}) for f in schema])
