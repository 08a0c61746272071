"""The mutation log's columns: seq, key, deleted, value, segment_id, record_bytes, crc.

seq is dense and durable, so order, age and gaps can always be told from it. key is any orderable atomic type, value any
struct or atomic type.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the record format: header bytes, largest key and value.
HEADER_BYTES = 13
MOST_KEY_BYTES = 1 << 20
MOST_VALUE_BYTES = 256 << 20


@dataclass(frozen=True)
class Options:
    """Settings of a store; with_() gives a changed copy, and every value is checked."""

    segment_bytes: int = 64 << 20
    retain_newest: int = 0
    compact_when_garbage_above: float = 0.5
    tail_ring: int = 4096

    def __post_init__(self) -> None:
        for ok, said in (
            (self.segment_bytes >= 1024, "segment_bytes must be 1024 or more"),
            (self.retain_newest >= 0, "retain_newest must be 0 (off) or more"),
            (0 <= self.compact_when_garbage_above < 1, "compact_when_garbage_above must be in [0, 1); 0 is off"),
            (self.tail_ring >= 8, "tail_ring must be 8 or more"),
        ):
            if not ok:
                raise ValueError(said)

    def with_(self, **changed: float) -> Options:
        return replace(self, **changed)


def schema(key: T.DataType, value: T.DataType) -> T.StructType:
    """Schema of a log with these types."""
    if isinstance(key, (T.ArrayType, T.MapType, T.StructType)):
        raise TypeError(f"a key must be an orderable atomic type, not {key.simpleString()}")
    fields = [("seq", T.LongType()), ("key", key), ("deleted", T.BooleanType()), ("value", value), ("segment_id", T.IntegerType()), ("record_bytes", T.LongType()), ("crc", T.LongType())]
    return T.StructType([T.StructField(n, t) for n, t in fields])


def byte_size(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value: fixed widths for numbers and times, octets for text and binary, the sum of the fields for structs; null has none."""
    if isinstance(kind, T.StructType):
        parts = [byte_size(c[f.name], f.dataType) for f in kind.fields]
        size = sum(parts[1:], parts[0]) if parts else F.lit(0).cast("long")
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c).cast("long")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        size = F.octet_length(F.to_json(c)).cast("long")
    else:
        widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
        size = F.lit(widths.get(kind.simpleString(), 8)).cast("long")
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(size)


def checksum(key: Column, deleted: Column, value: Column) -> Column:
    """CRC-32 of a record's content: its fields as JSON, nulls included."""
    return F.crc32(F.to_json(F.struct(key.alias("k"), deleted.alias("d"), value.alias("v")), {"ignoreNullFields": "false"}))


def with_record_columns(log: DataFrame) -> DataFrame:
    """log (seq, key, deleted, value, segment_id) with record_bytes and crc."""
    kinds = {f.name: f.dataType for f in log.schema.fields}
    value = F.when(~F.col("deleted"), F.col("value"))
    size = F.lit(HEADER_BYTES) + byte_size(F.col("key"), kinds["key"]) + byte_size(value, kinds["value"])
    return log.withColumn("value", value).withColumn("record_bytes", size.cast("long")).withColumn("crc", checksum(F.col("key"), F.col("deleted"), F.col("value")))


def is_invalid(schema: T.StructType) -> Column:
    """Whether a row may not enter a log: null key, null value of a put, key or value over its limit."""
    kinds = {f.name: f.dataType for f in schema.fields}
    key, value = F.col("key"), F.col("value")
    return key.isNull() | (~F.col("deleted") & value.isNull()) | (byte_size(key, kinds["key"]) > MOST_KEY_BYTES) | (byte_size(value, kinds["value"]) > MOST_VALUE_BYTES)


def invalid(log: DataFrame) -> DataFrame:
    """Rows that may not enter a log."""
    return log.where(is_invalid(log.schema))
