"""Structured Streaming over a store's commits: tails and watches, gap signals, replicas, and a continuous live view.

The stream is the folder of manifests: one manifest is one commit. So a commit is delivered whole, in seq order, however
many files it has; what no manifest names is never delivered; and compaction, which adds no seq, delivers nothing again.
Records come from the segments that the newest manifest of a trigger names. How far a tail has come is kept beside the
stream's checkpoint, so that a restart neither repeats nor skips: a batch whose listener had finished isn't delivered again.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from keelson.sources import log as segments
from keelson.sources import manifest as manifests
from keelson.sources.fs import Files
from keelson.sources.manifest import Manifest


def contiguous(rows: DataFrame, applied: int) -> DataFrame:
    """Rows that follow `applied` without a hole, each seq once.

    The first hole is the least seq that is missing: one anti-join and a minimum, no window over all rows.
    """
    new = rows.where(F.col("seq") > applied).dropDuplicates(["seq"])
    marks = new.select("seq").union(rows.sparkSession.createDataFrame([(applied,)], "seq long"))
    missing = marks.select((F.col("seq") + 1).alias("seq")).join(marks, "seq", "left_anti").agg(F.min("seq").alias("hole"))
    return new.join(F.broadcast(missing), F.col("seq") < F.col("hole")).drop("hole")


def follow(spark: SparkSession, path: str, on_commit: Callable[[Manifest], None], checkpoint: str, available_now: bool = False, commits_a_trigger: int = 64) -> StreamingQuery:
    """Call on_commit with the newest manifest of each trigger."""
    files = Files(spark, path)
    files.make(manifests.FOLDER)
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "manifest-*.json").option("maxFilesPerTrigger", commits_a_trigger).load(f"{path}/{manifests.FOLDER}")

    def each(batch: DataFrame, _: int) -> None:
        found = [m for r in batch.select("value").collect() if (m := manifests.parse(r["value"]))]  # one row a commit
        if found:
            on_commit(max(found, key=lambda m: m.generation))

    writer = stream.select("value").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def records_after(spark: SparkSession, path: str, manifest: Manifest, last: int) -> DataFrame:
    """The records of a manifest with a seq over `last`; other segments aren't opened. What a vacuum has taken away since is read as the newest manifest has it."""
    files = Files(spark, path)
    newest = manifest
    if not all(files.exists(s.folder) for s in manifest.segments if s.high > last):
        newest = manifests.latest(files) or manifest
    rows = segments.scan(files, newest, T.StructType.fromJson(json.loads(manifest.schema)), after=last)
    return rows.where(F.col("seq") < manifest.next_seq)


class Tail:
    """Delivers records in order from `from_seq` on, those that `only` selects, to listener(rows, gap).

    gap is true if records before these were missed: the first seq isn't the one after the last seen, some were compacted
    away before they were delivered, or more than `ring` records were waiting and only the newest `ring` are delivered. A
    listener's error is counted and doesn't stop the tail.
    """

    def __init__(self, listener: Callable[[DataFrame, bool], None], from_seq: int = 0, only: Column | None = None, ring: int = 0):
        self.listener, self.only, self.ring = listener, only, ring
        self.last, self.gaps, self.errors = from_seq - 1, 0, 0

    def __call__(self, batch: DataFrame, _: int = 0) -> None:
        new = batch.where(F.col("seq") > self.last).dropDuplicates(["seq"])
        n, low, high = new.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
        if not n:
            return
        gap = low != self.last + 1 or high - low + 1 != n
        if self.ring and n > self.ring:
            new, gap = new.orderBy(F.desc("seq")).limit(self.ring), True
        self.last, self.gaps = high, self.gaps + gap
        rows = new if self.only is None else new.where(self.only)
        try:
            self.listener(rows.orderBy("seq"), gap)
        except Exception:  # noqa: BLE001 - a listener's failure is its own
            self.errors += 1

    def start(self, spark: SparkSession, path: str, checkpoint: str, available_now: bool = False, commits_a_trigger: int = 64) -> StreamingQuery:
        """Follow the store at path. A checkpoint that was used before goes on where it was left, whatever from_seq says."""
        notes = Files(spark, checkpoint)
        notes.make("position")
        seen = [int(n) for n in notes.names("position") if n.isdigit()]
        self.last = max([self.last, *seen])

        def on_commit(manifest: Manifest) -> None:
            if manifest.next_seq <= self.last + 1:
                return
            before = self.last
            self(records_after(spark, path, manifest, self.last))
            if self.last < manifest.next_seq - 1:  # the newest ones are gone already
                self.last = manifest.next_seq - 1
            notes.write_new("", "position", f"{self.last:020d}")
            if before in seen:
                notes.delete("position", f"{before:020d}")
            seen.append(self.last)

        return follow(spark, path, on_commit, checkpoint, available_now, commits_a_trigger)


def watch_key(key: Any) -> Column:
    return F.col("key") == F.lit(key)


def watch_range(lo: Any, hi: Any) -> Column:
    return F.col("key").between(F.lit(lo), F.lit(hi))


class Replica:
    """Applies a primary's records to a store of its own, in seq order and without holes.

    At a hole it keeps the clean prefix, sets gapped and applies nothing more. Records met again change nothing.
    """

    def __init__(self, store: Any):
        self.store, self.gapped = store, False

    @property
    def applied(self) -> int:
        return self.store.manifest.next_seq - 1

    @classmethod
    def bootstrap(cls, primary: Any, target: str) -> Replica:
        """A replica that starts from a backup of the primary; records after it come by apply or by start()."""
        primary.backup(target)
        return cls(type(primary).open(primary.spark, target))

    def lag(self, primary_next_seq: int) -> int:
        return max(0, primary_next_seq - 1 - self.applied)

    def __call__(self, batch: DataFrame, _: int = 0) -> None:
        if self.gapped:
            return
        new = batch.where(F.col("seq") > self.applied)
        n, rows, low, high = new.agg(F.count_distinct("seq"), F.count("*"), F.min("seq"), F.max("seq")).first()
        if not n:
            return
        if low == self.applied + 1 and high - low + 1 == n == rows:  # the usual case: nothing is missing or twice
            self.store.append_records(new, n)
            return
        prefix = contiguous(batch, self.applied)
        whole = prefix.count()
        if whole:
            self.store.append_records(prefix, whole)
        self.gapped = whole < n

    def start(self, spark: SparkSession, path: str, checkpoint: str, available_now: bool = False, commits_a_trigger: int = 64) -> StreamingQuery:
        """Follow the primary at path. What is applied is known from the replica's own manifest, so a restart goes on from there."""

        def on_commit(manifest: Manifest) -> None:
            if manifest.next_seq - 1 > self.applied:
                self(records_after(spark, path, manifest, self.applied))

        return follow(spark, path, on_commit, checkpoint, available_now, commits_a_trigger)


def caught_up(query: StreamingQuery, replica: Replica, primary_next_seq: int) -> bool:
    """Wait until all that is on disk has been taken in; whether the replica then has everything."""
    query.processAllAvailable()
    return not replica.gapped and replica.lag(primary_next_seq) == 0


def live_view(stream: DataFrame, columns: list[str]) -> DataFrame:
    """The newest mutation of every key as a streaming aggregate (update mode); tombstones show as deleted."""
    newest = F.max_by(F.struct("seq", "deleted", *columns), "seq").alias("newest")
    return stream.groupBy("key").agg(newest).select("key", "newest.*")
