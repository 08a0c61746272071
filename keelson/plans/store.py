"""A store: a folder with a log and manifests, and the operators bound to it.

The log is the truth; the newest valid manifest says which segments it has. Every batch of puts or deletes is one commit.
Reads are lazy DataFrames over the manifest that was newest when they were made, so they never see half a batch, and
later commits don't change them. Ordering within a batch follows `ordinal` if the rows have it, else their given order.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.records import Options, is_invalid, schema, with_record_columns
from keelson.operators import lookup, order, resolve, space
from keelson.operators.indexes import IndexSet
from keelson.sources import files as sources
from keelson.sources import log as segments
from keelson.sources import manifest as manifests
from keelson.sources.fs import Files
from keelson.sources.manifest import Manifest


class StoreError(RuntimeError):
    """A commit or an import that isn't possible in the store's present state."""


class View:
    """Reads of one fixed state; Store and Snapshot share them."""

    live: DataFrame
    log: DataFrame

    def size(self) -> int:
        return self.live.count()

    def get(self, key: Any) -> Any:
        """The live value of a key, or None."""
        if key is None:
            raise ValueError("a key may not be null")
        row = self.live.where(F.col("key") == F.lit(key)).select("value").first()
        return row[0] if row else None

    def range(self, lo: Any, hi: Any) -> DataFrame:
        if lo is None or hi is None:
            raise ValueError("bounds may not be null")
        return self.live.where(F.col("key").between(F.lit(lo), F.lit(hi))).select("key", "value").orderBy("key")

    def first_key(self) -> Any:
        return order.first_last(self.live).first()["first_key"]

    def last_key(self) -> Any:
        return order.first_last(self.live).first()["last_key"]


class Snapshot(View):
    """The store at one manifest. While it is open the store isn't compacted; close() may be called again.

    Its pin expires after `seconds`, so that a reader that died doesn't block compaction for good; renew() prolongs it.
    """

    def __init__(self, store: Store, seconds: float = 3600):
        self.log, self.live, self._files, self._seconds = store.log, store.live, store.files, seconds
        self._name = f"{store.manifest.generation:08d}-{uuid.uuid4().hex}"
        self._pin = ""
        self._files.make("pins")
        self.renew()

    def renew(self) -> None:
        old, self._pin = self._pin, f"{int((time.time() + self._seconds) * 1000)}-{self._name}"
        if old != self._pin:
            self._files.write_new("", "pins", self._pin)
            if old:
                self._files.delete("pins", old)

    def close(self) -> None:
        if self._pin:
            self._files.delete("pins", self._pin)
        self._pin = ""

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def pinned(files: Files) -> bool:
    """Whether a snapshot is open whose pin hasn't expired."""
    ends = [name.split("-")[0] for name in files.names("pins") if not name.startswith(".")]
    return any(e.isdigit() and int(e) > time.time() * 1000 for e in ends)


class Store(View):
    def __init__(self, spark: SparkSession, path: str, manifest: Manifest, indexes: IndexSet | None = None):
        self.spark, self.files, self.manifest = spark, Files(spark, path), manifest
        self.schema = T.StructType.fromJson(json.loads(manifest.schema))
        self.options = Options(**manifest.options)
        self.indexes = indexes or IndexSet()
        if self.options.retain_newest and (self.indexes.attributes or self.indexes.intervals):
            raise ValueError("retention and secondary indexes exclude each other")
        self.refresh(manifest)

    # --- opening ---

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: T.DataType, value: T.DataType, options: Options | None = None, indexes: IndexSet | None = None) -> Store:
        """A new store; an error if the folder holds one."""
        files = Files(spark, path)
        if manifests.generations(files):
            raise StoreError(f"{path} holds a store already")
        first = Manifest(1, 0, (), schema(key, value).json(), None, (options or Options()).__dict__)
        if not manifests.publish(files, first):
            raise StoreError(f"{path} was created by another writer")
        return cls(spark, path, first, indexes)

    @classmethod
    def open(cls, spark: SparkSession, path: str, indexes: IndexSet | None = None) -> Store:
        """The store as of its newest valid manifest. A backup or a replica's folder opens alike."""
        found = manifests.latest(Files(spark, path))
        if not found:
            raise StoreError(f"{path} holds no valid manifest")
        return cls(spark, path, found, indexes)

    def refresh(self, manifest: Manifest | None = None) -> Store:
        """Go on to the newest manifest (or the given one)."""
        self.manifest = manifest or manifests.latest(self.files) or self.manifest
        self.log = segments.scan(self.files, self.manifest, self.schema)
        self.live = self._live()
        return self

    def _live(self) -> DataFrame:
        columns = [f.name for f in self.schema.fields if f.name != "deleted"]
        if self.manifest.checkpoint:
            seq, folder = self.manifest.checkpoint
            old = self.spark.read.schema(T.StructType([self.schema[c] for c in columns])).parquet(f"{self.files.base}/{folder}")
            found = resolve.from_checkpoint(old, self.log.where(F.col("seq") > seq))
        else:
            found = resolve.live_set(self.log)
        found = found.select(columns)
        return resolve.retain_newest(found, self.options.retain_newest) if self.options.retain_newest else found

    def _floor(self) -> int:
        """Live rows with a seq under it are evicted; 0 without retention."""
        return resolve.floor(resolve.live_set(self.log), self.options.retain_newest) if self.options.retain_newest else 0

    def _commit(self, **changed: Any) -> None:
        to = replace(self.manifest, generation=manifests.next_generation(self.files), **changed)
        if manifests.latest(self.files) != self.manifest or not manifests.publish(self.files, to):
            raise StoreError("another writer has committed; refresh() and try again")
        self.refresh(to)

    # --- writing ---

    def apply(self, mutations: DataFrame) -> int:
        """Append mutations (key, value, deleted, and ordinal if their order matters) as one commit; the number of records."""
        rows = mutations.orderBy("ordinal") if "ordinal" in mutations.columns else mutations
        scratch = f"scratch/{uuid.uuid4().hex}"
        checks = (is_invalid(rows.schema).alias("invalid"), (~F.col("deleted") & self.indexes.is_rejected()).alias("rejected"))
        typed = [F.col(c).cast(self.schema[c].dataType).alias(c) for c in ("key", "value")]
        # Written once before numbering: a task's rows are numbered as they stand, and tasks by their counts.
        checked = rows.select("key", "value", "deleted", *checks).select(*typed, "deleted", "invalid", "rejected")
        with_record_columns(checked).withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{self.files.base}/{scratch}")
        try:
            names = T.StructType([*[self.schema[c] for c in ("key", "value", "deleted", "record_bytes", "crc")], *[T.StructField(c, T.BooleanType()) for c in ("invalid", "rejected")], T.StructField("place", T.LongType())])
            staged = self.spark.read.schema(names).parquet(f"{self.files.base}/{scratch}").withColumn("task", F.shiftright("place", 33).cast("int"))
            sums = (F.count("*").alias("n"), F.sum("record_bytes").alias("bytes"), F.sum("crc").alias("crc_sum"), F.bit_xor("crc").alias("crc_xor"))
            seen = staged.groupBy("task").agg(*sums, F.bool_or("invalid").alias("invalid"), F.bool_or("rejected").alias("rejected")).orderBy("task").collect()  # one row a task
            if any(r["invalid"] for r in seen):
                raise ValueError("null key, null value of a put, or a key or value over its limit")
            if any(r["rejected"] for r in seen):
                raise ValueError("an index refuses a row: null attribute or endpoint, or start after end")
            start, total, size, xor = [], 0, 0, 0
            for r in seen:
                start.append((r["task"], total, size, r["bytes"] / r["n"]))
                total, size, xor = total + r["n"], size + r["bytes"], xor ^ r["crc_xor"]
            if not total:
                return 0
            starts = F.broadcast(self.spark.createDataFrame(start, "task int, start long, before long, mean double"))
            nth = F.col("place") - F.shiftleft(F.col("task").cast("long"), 33)
            first = self._next_segment()
            cuts = -(-size // self.options.segment_bytes)
            number = F.least(F.floor((F.col("before") + nth * F.col("mean")) / self.options.segment_bytes), F.lit(cuts - 1))
            numbered = staged.join(starts, "task").withColumn("seq", F.lit(self.manifest.next_seq) + F.col("start") + nth).withColumn("segment_id", (F.lit(first) + number).cast("int"))
            known = {"segment_id": first, "records": total, "bytes": size, "crc_sum": sum(r["crc_sum"] for r in seen), "crc_xor": xor, "low": self.manifest.next_seq, "high": self.manifest.next_seq + total - 1}
            self._append(numbered.select([f.name for f in self.schema.fields]), total, cuts, known if cuts == 1 else None)
        finally:
            self.files.delete(scratch)
        return total

    def _next_segment(self) -> int:
        return max((s.segment_id for s in self.manifest.segments), default=-1) + 1

    def append_records(self, rows: DataFrame, total: int) -> None:
        """Commit records (seq, key, deleted, value) that have their seq already, the first being next_seq and none missing: a replica's way to write."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        rows = rows.select("seq", F.col("key").cast(kinds["key"]).alias("key"), "deleted", F.col("value").cast(kinds["value"]).alias("value"))
        rows = with_record_columns(rows)
        size = rows.agg(F.sum("record_bytes")).first()[0]
        cuts = max(1, -(-size // self.options.segment_bytes))
        number = F.lit(self._next_segment()) + F.floor((F.col("seq") - F.lit(self.manifest.next_seq)) * cuts / total)
        self._append(rows.withColumn("segment_id", number.cast("int")).select([f.name for f in self.schema.fields]), total, cuts, None)

    def _append(self, rows: DataFrame, total: int, cuts: int, known: dict[str, int] | None) -> None:
        if cuts > 1:
            rows = rows.repartitionByRange(int(cuts), "seq")
        new = segments.write_segments(self.files, rows.sortWithinPartitions("segment_id", "seq"), known)
        self._commit(next_seq=self.manifest.next_seq + total, segments=(*self.manifest.segments, *new))

    def put_all(self, rows: DataFrame) -> int:
        """Upsert rows (key, value); later rows of the same key win."""
        return self.apply(rows.withColumn("deleted", F.lit(False)))

    def delete_all(self, keys: DataFrame) -> DataFrame:
        """Append a tombstone for every key, live or not; key, existed as of before."""
        before = lookup.existed(self.log, keys.select("key")).select("key", "existed")  # of the files there are now
        self.apply(keys.withColumn("value", F.lit(None).cast(self.schema["value"].dataType)).withColumn("deleted", F.lit(True)))
        return before

    def put(self, key: Any, value: Any) -> None:
        self.put_all(self.spark.createDataFrame([(key, value)], T.StructType([self.schema["key"], self.schema["value"]])))

    def delete(self, key: Any) -> bool:
        return self.delete_all(self.spark.createDataFrame([(key,)], T.StructType([self.schema["key"]]))).first()["existed"]

    # --- reading ---

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.live.join(keys.select("key").distinct(), "key", "left_semi"), "key", "left")

    def as_of_record(self, n: int) -> DataFrame:
        """The live set after the first n records still in the log, by seq; changes nothing. Compaction leaves fewer records to count."""
        return resolve.as_of_record(self.log, n, dense=sum(s.records for s in self.manifest.segments) == self.manifest.next_seq)

    def by_attribute(self, name: str, lo: Any, hi: Any) -> DataFrame:
        return self.indexes.by_attribute(self.live, name, lo, hi)

    def stab(self, name: str, point: Any) -> DataFrame:
        return self.indexes.stab(self.live, name, point)

    def overlapping(self, name: str, lo: Any, hi: Any) -> DataFrame:
        return self.indexes.overlapping(self.live, name, lo, hi)

    def snapshot(self, seconds: float = 3600) -> Snapshot:
        return Snapshot(self, seconds)

    def tail_sequence(self) -> int:
        return self.manifest.next_seq

    def stats(self) -> dict[str, Any]:
        """Figures of the store."""
        r = space.garbage(self.log, self._floor()).first()
        return {"generation": self.manifest.generation, "records": segments.count_records(self.files, self.manifest), "live": self.size(), "segments": len(self.manifest.segments), "bytes": r["total_bytes"], "garbage_bytes": r["garbage_bytes"], "next_seq": self.manifest.next_seq}

    # --- upkeep ---

    def checkpoint(self) -> None:
        """Write the live set, so that opening reads it and only the log after it."""
        folder = f"checkpoints/{uuid.uuid4().hex}"
        resolve.live_set(self.log).write.parquet(f"{self.files.base}/{folder}")
        self._commit(checkpoint=(self.manifest.next_seq - 1, folder))

    def _closed(self) -> int:
        return sorted(s.segment_id for s in self.manifest.segments)[-2] if len(self.manifest.segments) > 1 else -1

    def compact(self) -> int:
        """Merge all closed segments into one that holds their live records in key order; the bytes reclaimed.

        Nothing happens (0) without closed segments, while a snapshot is open, or if another writer commits meanwhile.
        """
        top = self._closed()
        if top < 0 or pinned(self.files):
            return 0
        old = [s for s in self.manifest.segments if s.segment_id <= top]
        merged = space.compacted(self.log, top, self._floor()).withColumn("segment_id", F.lit(top)).withColumn("deleted", F.lit(False))
        rows = merged.select([f.name for f in self.schema.fields]).repartitionByRange("key").sortWithinPartitions("key")
        new = segments.write_segments(self.files, rows)
        try:
            self._commit(segments=(*new, *(s for s in self.manifest.segments if s.segment_id > top)), checkpoint=None)
        except StoreError:
            return 0
        return sum(s.bytes for s in old) - sum(s.bytes for s in new)

    def maintain(self) -> int:
        """Compact if the closed segments' garbage is above the configured part."""
        due = space.compaction_due(self.log, self._closed(), self.options.compact_when_garbage_above, self._floor()).first()["due"]
        return self.compact() if due else 0

    def vacuum(self, older_than: float = 86_400) -> int:
        """Delete batch, checkpoint and scratch folders that the newest manifest doesn't name; nothing while a snapshot is open.

        Folders younger than older_than seconds are spared, since a writer may not have committed them yet.
        """
        if pinned(self.files):
            return 0
        named = {s.folder.split("/")[1] for s in self.manifest.segments}
        if self.manifest.checkpoint:
            named.add(self.manifest.checkpoint[1].split("/")[1])
        limit = time.time() - older_than
        loose = [(folder, n) for folder in ("segments", "checkpoints", "scratch") for n, at in self.files.modified(folder).items() if n not in named and at <= limit]
        for parts in loose:
            self.files.delete(*parts)
        return len(loose)

    def verify(self) -> list[int]:
        """Numbers of damaged or missing segments."""
        return segments.verify(self.files, self.manifest, self.schema)

    # --- copies ---

    def backup(self, target: str) -> int:
        """Copy the segments that the manifest names, then the manifest; its generation. Later writes don't reach the copy.

        The copy is a job of its own, spread over the executors, and holds the same records and checksums under new folders.
        """
        to = Files(self.spark, target)
        if manifests.load(to, self.manifest.generation):
            raise StoreError(f"{target} holds this generation already")
        folder, checkpoint = f"{segments.FOLDER}/backup-{uuid.uuid4().hex}", self.manifest.checkpoint
        if self.manifest.segments:
            segments.scan(self.files, self.manifest, self.schema).withColumn("part", F.col("segment_id")).sortWithinPartitions("part", "seq").write.partitionBy("part").parquet(f"{to.base}/{folder}")
        if checkpoint:
            self.spark.read.parquet(f"{self.files.base}/{checkpoint[1]}").write.parquet(f"{to.base}/{checkpoint[1]}")
        copied = tuple(replace(s, folder=f"{folder}/part={s.segment_id}") for s in self.manifest.segments)
        if not manifests.publish(to, replace(self.manifest, segments=copied)):
            raise StoreError(f"{target} holds this generation already")
        return self.manifest.generation

    def export_sorted(self, path: str) -> int:
        return sources.export_sorted(self.live, path)

    @classmethod
    def import_into(cls, spark: SparkSession, path: str, rows: DataFrame, options: Options | None = None) -> Store:
        """A new store from rows (key, value, ordinal); later rows of a key win, and earlier ones stay in the log until it is compacted."""
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        store = cls.create(spark, path, kinds["key"], kinds["value"], options)
        store.put_all(rows)
        return store

    @classmethod
    def import_sorted(cls, spark: SparkSession, path: str, run: str, options: Options | None = None) -> Store:
        """A new store from a sorted run: its state, without history or tombstones."""
        return cls.import_into(spark, path, sources.scan_sorted(spark, run), options)
