"""The driver tables as logs, live sets and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.records import checksum

RECORDS_A_SEGMENT = 1000


def event_log(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """events as a mutation log: seq, key, deleted, event_type, props, segment_id, record_bytes. dense: a key for each user and day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.col("user_id") * 100 + F.dayofmonth("ts") if dense else F.col("user_id")
    dead = F.col("event_type") == "error"
    size = F.lit(21) + F.when(dead, 0).otherwise(F.octet_length("event_type") + F.octet_length("props"))
    return e.select(F.col("event_id").alias("seq"), key.cast("long").alias("key"), dead.alias("deleted"), "event_type", "props", F.expr(f"int(event_id div {RECORDS_A_SEGMENT})").alias("segment_id"), size.cast("long").alias("record_bytes"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with the columns of functions.records and a checksum."""
    log = event_log(spark, sf_dir)
    log = log.withColumn("value", F.when(~F.col("deleted"), F.struct("event_type", "props")))
    log = log.withColumn("crc", checksum(F.col("key"), F.col("deleted"), F.col("value")))
    return log.select("seq", "key", "deleted", "value", "segment_id", "record_bytes", "crc")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderkey", "key")


def ship_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, start, end: first and last ship date of each order."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.groupBy(F.col("l_orderkey").alias("key")).agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end"))
