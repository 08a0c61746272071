"""Point and range reads, and the existence of keys before a delete."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .resolve import live_set


def _bounds(lo: Any, hi: Any) -> None:
    if lo is None or hi is None:
        raise ValueError("bounds may not be null")


def get(log: DataFrame, key: Any) -> DataFrame:
    """The live row of one key; the predicate reaches the scan."""
    if key is None:
        raise ValueError("a key may not be null")
    return live_set(log.where(F.col("key") == F.lit(key)))


def record_at(log: DataFrame, seq: int) -> DataFrame:
    """The one record with this seq, tombstone or not; none if it was compacted away. The predicate reaches the scan."""
    return log.where(F.col("seq") == F.lit(seq))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """Every row of keys (column key) with the live columns of its key, null if it has none. Only the keys' records are resolved."""
    asked = keys.select("key").distinct()
    found = live_set(log.join(asked, "key", "left_semi"))
    return keys.join(found, "key", "left")


def key_range(log: DataFrame, lo: Any, hi: Any) -> DataFrame:
    """Live rows with lo <= key <= hi in key order; none if lo > hi."""
    _bounds(lo, hi)
    return live_set(log.where(F.col("key").between(F.lit(lo), F.lit(hi)))).orderBy("key")


def existed(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, existed: whether each key is live, as a delete of it would report."""
    there = live_set(log.join(keys.select("key").distinct(), "key", "left_semi")).select("key", F.lit(True).alias("existed"))
    return keys.join(there, "key", "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def size(live: DataFrame) -> DataFrame:
    return live.agg(F.count("*").alias("size"))
