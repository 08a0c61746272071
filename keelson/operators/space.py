"""Space: which bytes of a log are dead, by segment, and what compaction leaves.

A record is dead unless it is the live record of its key; that covers overwritten and deleted puts, tombstones, evicted
rows and what compaction drops. A store with retention evicts live rows with a seq under its floor (resolve.floor).

Dead bytes are all bytes less the live ones: two sums that each task adds up on its own; only resolution sends rows by
key, at most one a key and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .resolve import live_set


def survivors(log: DataFrame, floor: int = 0) -> DataFrame:
    """The live rows that retention leaves. An older record of a key never survives its newest, so the floor may be tested first."""
    return live_set(log.where(F.col("seq") >= floor) if floor else log)


def _sums(log: DataFrame, floor: int) -> DataFrame:
    """segment_id, records, bytes, live: of each record once, and of each live record's bytes."""
    every = log.select("segment_id", F.lit(1).cast("long").alias("records"), F.col("record_bytes").cast("long").alias("bytes"), F.lit(0).cast("long").alias("live"))
    live = survivors(log.select("segment_id", "key", "seq", "deleted", "record_bytes"), floor)
    none = F.lit(0).cast("long")
    return every.union(live.select("segment_id", none.alias("records"), none.alias("bytes"), F.col("record_bytes").cast("long").alias("live")))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def segment_stats(log: DataFrame, floor: int = 0) -> DataFrame:
    """segment_id, records, bytes, garbage_bytes, active; active is the newest segment."""
    stats = _sums(log, floor).groupBy("segment_id").agg(_total("records").alias("records"), _total("bytes").alias("bytes"), (_total("bytes") - _total("live")).alias("garbage_bytes"))
    newest = F.max("segment_id").over(Window.partitionBy(F.lit(0)))  # one row a segment
    return stats.withColumn("active", F.col("segment_id") == newest)


def garbage(log: DataFrame, floor: int = 0) -> DataFrame:
    """total_bytes, garbage_bytes."""
    return _sums(log, floor).agg(_total("bytes").alias("total_bytes"), (_total("bytes") - _total("live")).alias("garbage_bytes"))


def newest_closed(log: DataFrame) -> int:
    """The number of the newest segment but one; -1 if there is none."""
    rows = log.select("segment_id").distinct().orderBy(F.desc("segment_id")).limit(2).collect()
    return rows[1][0] if len(rows) == 2 else -1


def closed(log: DataFrame, max_closed: int) -> DataFrame:
    return log.where(F.col("segment_id") <= max_closed)


def compacted(log: DataFrame, max_closed: int, floor: int = 0) -> DataFrame:
    """Records that the segment merged from all closed ones holds: the log's live rows in them, seq kept, tombstones gone."""
    return survivors(log, floor).where(F.col("segment_id") <= max_closed)


def reclaimed(log: DataFrame, max_closed: int, floor: int = 0) -> DataFrame:
    """reclaimed_bytes: what compaction of the closed segments frees."""
    return closed(_sums(log, floor), max_closed).agg((_total("bytes") - _total("live")).alias("reclaimed_bytes"))


def compaction_due(log: DataFrame, max_closed: int, ratio: float, floor: int = 0) -> DataFrame:
    """due: whether the closed segments' dead part is above the ratio; a ratio of 0 turns it off."""
    due = F.coalesce(F.sum("bytes") - F.sum("live") > F.lit(ratio) * F.sum("bytes"), F.lit(False)) if ratio else F.lit(False)
    return closed(_sums(log, floor), max_closed).agg(due.alias("due"))
