"""State resolution: the live set of a mutation log, as of any record, and retention.

Every function takes a log (seq, key, deleted, and any other columns). The window over (key, seq desc) plans as a
partial and a final group limit, so each task sends at most one row a key to the shuffle. Predicates on the key may be
pushed below it; predicates on other columns may not, and `deleted` is tested only after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import TOP, at_ranks


def newest(log: DataFrame) -> DataFrame:
    """The last mutation of every key, tombstones included."""
    last = Window.partitionBy("key").orderBy(F.desc("seq"))
    return log.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def live_set(log: DataFrame) -> DataFrame:
    """Last writer wins: the newest put of every key whose newest mutation isn't a tombstone."""
    return newest(log).where(~F.col("deleted")).drop("deleted")


def tombstoned(log: DataFrame) -> DataFrame:
    """Keys whose newest mutation is a tombstone."""
    return newest(log).where("deleted")


def first_records(log: DataFrame, n: int, dense: bool = True) -> DataFrame:
    """The first n records in write order; all if n is negative.

    dense: no seq is missing below n, as in a log that was never compacted, so that this is a range that Parquet can skip
    by. Otherwise the n-th seq that is left is looked up first.
    """
    if n < 0:
        return log
    if dense or n == 0:
        return log.where(F.col("seq") < n)
    total = log.count()
    if n >= total:
        return log
    return log.where(F.col("seq") <= at_ranks(log, "seq", [n], total).first()["key"])


def as_of_record(log: DataFrame, n: int, dense: bool = True) -> DataFrame:
    """The live set after the first n records that the log still holds."""
    if n < 0:
        raise ValueError("as_of_record needs n >= 0")
    return live_set(first_records(log, n, dense))


def from_checkpoint(checkpoint: DataFrame, delta: DataFrame) -> DataFrame:
    """The live set from a checkpoint's live rows and the log after it: the same answer as from the whole log."""
    old = checkpoint.withColumn("deleted", F.lit(False))
    return live_set(old.unionByName(delta.select(old.columns)))


def retain_newest(live: DataFrame, n: int, indexed: bool = False) -> DataFrame:
    """The n live rows written last; a rewrite makes a key young again. Not for a store with secondary indexes."""
    if n <= 0:
        raise ValueError("retain_newest needs n >= 1")
    if indexed:
        raise ValueError("retention and secondary indexes exclude each other")
    return live.orderBy(F.desc("seq")).limit(n)


def floor(live: DataFrame, n: int) -> int:
    """The seq of the n-th newest live row: older ones are evicted. 0 if there are no more than n."""
    age = live.select((-F.col("seq")).alias("age"))
    total = n + 1 if n < TOP else live.count()
    found = at_ranks(age, "age", [n + 1], total).first()
    return 1 - found["key"] if found else 0


def overwrites(log: DataFrame) -> DataFrame:
    """key, seq and previous seq of the same key: what each mutation made garbage."""
    return log.select("key", "seq", F.lag("seq").over(Window.partitionBy("key").orderBy("seq")).alias("previous"))


def intact(log: DataFrame, strict: bool = False) -> DataFrame:
    """Rows before the first record of their segment whose checksum fails; strict: an error if there is one."""
    from keelson.functions.records import checksum

    ok = F.col("crc") == checksum(F.col("key"), F.col("deleted"), F.col("value"))
    marked = log.withColumn("__bad", F.when(ok, None).otherwise(F.col("seq")))
    first_bad = marked.groupBy("segment_id").agg(F.min("__bad").alias("__first")).where("__first IS NOT NULL")
    if strict and not first_bad.isEmpty():
        raise ValueError("the log holds records whose checksum fails")
    kept = log.join(first_bad, "segment_id", "left").where("__first IS NULL OR seq < __first")
    return kept.select(log.columns)
