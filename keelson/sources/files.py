"""Import sources in line order, and sorted runs."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.records import checksum

from .fs import Files


def in_file_order(rows: DataFrame) -> DataFrame:
    """rows with ordinal: a struct that orders rows as they stand in their files (path, then split, then line)."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return rows.select("*", place.alias("ordinal"))


def csv_source(spark: SparkSession, path: str, schema: T.StructType | str, key: str, value: str, header: bool = False) -> DataFrame:
    """key, value, ordinal of a comma-separated file: quoted fields, doubled quotes, no line breaks within fields. A line that doesn't fit the schema is an error."""
    rows = spark.read.csv(path, schema=schema, header=header, quote='"', escape='"', multiLine=False, mode="FAILFAST")
    return in_file_order(rows).select(F.col(key).alias("key"), F.col(value).alias("value"), "ordinal")


def jsonl_source(spark: SparkSession, path: str, schema: T.StructType | str, key: str, value: str) -> DataFrame:
    """key, value, ordinal of a file of one JSON object a line."""
    rows = spark.read.json(path, schema=schema, mode="FAILFAST")
    return in_file_order(rows).select(F.col(key).alias("key"), F.col(value).alias("value"), "ordinal")


def parquet_sink(rows: DataFrame, path: str) -> None:
    """Write key, value in the order of ordinal (or as given): the binary interchange format here is Parquet, whose pages are length-prefixed and typed."""
    (rows.orderBy("ordinal") if "ordinal" in rows.columns else rows).select("key", "value").write.parquet(path)


def parquet_source(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """key, value, ordinal of Parquet, the binary interchange format here."""
    return in_file_order(spark.read.parquet(path)).select(F.col(key).alias("key"), F.col(value).alias("value"), "ordinal")


# --- sorted runs: the live set in key order, with a sidecar that is checked before anything is delivered ---


def _run_state(rows: DataFrame) -> tuple[int, int, int]:
    crc = checksum(F.col("key"), F.lit(False), F.col("value"))
    r = rows.agg(F.count("*"), F.coalesce(F.sum(crc), F.lit(0)), F.coalesce(F.bit_xor(crc), F.lit(0))).first()
    return r[0], r[1], r[2]


def export_sorted(live: DataFrame, path: str) -> int:
    """Write key, value in key order; the number of rows. Files follow each other in key order."""
    spark = live.sparkSession
    rows = live.select("key", "value")
    rows.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/run")
    count, total, xor = _run_state(spark.read.schema(rows.schema).parquet(f"{path}/run"))
    body = json.dumps({"magic": "SRUN", "count": count, "sum": int(total), "xor": int(xor), "schema": rows.schema.json()})
    Files(spark, path).write_new(json.dumps({"crc": zlib.crc32(body.encode()), "body": body}), "run.json")
    return count


def scan_sorted(spark: SparkSession, path: str) -> DataFrame:
    """key, value in key order; an OSError, before any row, if the run is damaged or isn't one."""
    files = Files(spark, path)
    try:
        outer = json.loads(files.read("run.json"))
        if zlib.crc32(outer["body"].encode()) != outer["crc"]:
            raise ValueError("sidecar checksum")
        said = json.loads(outer["body"])
        if said["magic"] != "SRUN":
            raise ValueError("magic")
        rows = spark.read.schema(T.StructType.fromJson(json.loads(said["schema"]))).parquet(f"{path}/run")
        if _run_state(rows) != (said["count"], said["sum"], said["xor"]):
            raise ValueError("rows differ from the sidecar")
    except Exception as e:
        raise OSError(f"{path} is not an intact sorted run: {e}") from e
    return rows.orderBy("key")
