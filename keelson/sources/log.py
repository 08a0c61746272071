"""The on-disk log: one Parquet folder a segment, named by a manifest.

A batch is appended as one segment or more, of about segment_bytes each (the mean record size of each task of the batch
says where it is cut). Files of a segment are ordered by seq, so reads by seq or key skip row groups. Records carry their
segment_id, so any number of segments is one relation.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fs import Files
from .manifest import Manifest, Segment

FOLDER = "segments"


def summary(records: DataFrame) -> DataFrame:
    """segment_id, records, bytes, crc_sum, crc_xor, low, high of each segment: what a manifest keeps and verify compares."""
    return records.groupBy("segment_id").agg(
        F.count("*").alias("records"),
        F.coalesce(F.sum("record_bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.coalesce(F.sum("crc"), F.lit(0)).cast("long").alias("crc_sum"),
        F.coalesce(F.bit_xor("crc"), F.lit(0)).cast("long").alias("crc_xor"),
        F.min("seq").alias("low"),
        F.max("seq").alias("high"),
    )


def write_segments(files: Files, records: DataFrame, known: dict[str, int] | None = None) -> list[Segment]:
    """Write records (with segment_id) to a new folder and describe its segments; known: the description, if they are one segment and it was measured before."""
    folder = f"{FOLDER}/batch-{uuid.uuid4().hex}"
    records.withColumn("part", F.col("segment_id")).write.partitionBy("part").parquet(f"{files.base}/{folder}")
    if known:
        rows = [known]
    else:
        written = files.spark.read.schema(records.schema).parquet(f"{files.base}/{folder}")
        rows = [r.asDict() for r in summary(written).orderBy("segment_id").collect()]  # one row a segment
    return [Segment(folder=f"{folder}/part={r['segment_id']}", **r) for r in rows]


def scan(files: Files, manifest: Manifest, schema: T.StructType, above: int = -1, after: int = -1) -> DataFrame:
    """All records of segments with a number over `above` that hold a seq over `after`; folders of other segments aren't opened."""
    folders = [f"{files.base}/{s.folder}" for s in manifest.segments if s.segment_id > above and s.high > after]
    if not folders:
        return files.spark.createDataFrame([], schema)
    rows = files.spark.read.schema(schema).parquet(*folders)
    return rows if after < 0 else rows.where(F.col("seq") > after)


def count_records(files: Files, manifest: Manifest | None) -> int:
    """Physical records, tombstones included, from the manifest alone; 0 without a store."""
    return sum(s.records for s in manifest.segments) if manifest else 0


def verify(files: Files, manifest: Manifest, schema: T.StructType) -> list[int]:
    """Numbers of segments whose records, bytes or checksums differ from the manifest's, or that can't be found."""
    missing = [s.segment_id for s in manifest.segments if s.records and not files.exists(s.folder)]
    there = Manifest(manifest.generation, manifest.next_seq, tuple(s for s in manifest.segments if s.segment_id not in missing))
    found = {r["segment_id"]: tuple(r)[1:] for r in summary(_checked(scan(files, there, schema))).collect()}
    return missing + [s.segment_id for s in there.segments if s.records and found.get(s.segment_id) != (s.records, s.bytes, s.crc_sum, s.crc_xor, s.low, s.high)]


def _checked(records: DataFrame) -> DataFrame:
    """records with the checksum of their content in place of the stored one."""
    from keelson.functions.records import checksum

    return records.withColumn("crc", checksum(F.col("key"), F.col("deleted"), F.col("value")))
