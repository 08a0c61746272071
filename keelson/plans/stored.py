"""Registered queries that go through streams and through stores on disk; each is bounded and returns a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.records import Options
from keelson.operators import resolve
from keelson.operators.indexes import IndexSet
from keelson.sources import files
from keelson.sources import log as segments
from keelson.sources import manifest as manifests
from keelson.sources.scratch import scratch
from keelson.sources.workload import workload
from keelson.streaming import tail

from . import views
from .catalogue import BASE, BASE_DENSE, DENSE, LIVE, LOG, query
from .store import Store, StoreError

#: The first commit of a stored log holds the records before this one.
HALF = 5000
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def delivered(store: Store, from_seq: int = 0, only=None, ring: int = 0, commits_a_trigger: int = 64) -> DataFrame:
    """What a tail over a store delivers, gathered in a folder."""
    spark, to = store.spark, scratch(store.spark, "tail")
    columns = ["seq", "key", "deleted", F.col("value.event_type").alias("event_type")]
    follower = tail.Tail(lambda rows, gap: rows.select(*columns).withColumn("gap", F.lit(gap)).write.mode("append").parquet(f"{to}/rows"), from_seq, only, ring)
    follower.start(spark, store.files.base, f"{to}/state", available_now=True, commits_a_trigger=commits_a_trigger).awaitTermination()
    return spark.read.schema("seq long, key long, deleted boolean, event_type string, gap boolean").parquet(f"{to}/rows")


_TAILED = f"WITH {LOG} SELECT seq, k AS key, del AS deleted, CASE WHEN NOT del THEN et END AS event_type, false AS gap FROM log"


@query(f"{_TAILED} WHERE seq >= 250")
def tail_from(spark, sf_dir):
    return delivered(stored_log(spark, sf_dir), 250)


@query(_TAILED)
def tail_many_files(spark, sf_dir):
    """Commits of many segments, one commit a trigger: every record once, no gap."""
    return delivered(stored_log(spark, sf_dir, options=Options(segment_bytes=32 << 10)), commits_a_trigger=1)


@query(_TAILED)
def tail_orphan_batch(spark, sf_dir):
    """A batch that its writer never committed isn't delivered."""
    store = stored_log(spark, sf_dir)
    lost = store.log.limit(7).withColumn("seq", F.col("seq") + 10**9).withColumn("segment_id", F.lit(99))
    segments.write_segments(store.files, lost)
    return delivered(store)


@query(f"WITH {LOG}, n AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS back FROM log WHERE seq >= 10) SELECT seq, k AS key, true AS gap FROM n WHERE back <= 100")
def tail_ring_gap(spark, sf_dir):
    """More records wait than a tail's ring holds: the newest come, and the gap is told."""
    return delivered(stored_log(spark, sf_dir), 10, ring=100).select("seq", "key", "gap")


@query(f"WITH {LOG} SELECT seq, k AS key, del AS deleted FROM log WHERE k = 42")
def watch_key(spark, sf_dir):
    return delivered(stored_log(spark, sf_dir), 0, tail.watch_key(42)).select("seq", "key", "deleted")


@query(f"WITH {LOG} SELECT seq, k AS key, del AS deleted FROM log WHERE k BETWEEN 10 AND 20")
def watch_range(spark, sf_dir):
    return delivered(stored_log(spark, sf_dir), 0, tail.watch_range(10, 20)).select("seq", "key", "deleted")


@query(BASE + "SELECT k AS key, seq, et AS event_type FROM live")
def replica_over_stream(spark, sf_dir):
    """A replica that starts empty and follows the primary's commits."""
    primary = stored_log(spark, sf_dir, options=Options(segment_bytes=64 << 10))
    to = scratch(spark, "replica")
    replica = tail.Replica(Store.create(spark, f"{to}/store", T.LongType(), _value()))
    replica.start(spark, primary.files.base, f"{to}/state", available_now=True, commits_a_trigger=1).awaitTermination()
    return Store.open(spark, f"{to}/store").live.select("key", "seq", F.col("value.event_type").alias("event_type"))


@query(f"WITH {LOG} SELECT seq, k AS key FROM (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM log WHERE seq >= 100 AND seq <> 250) WHERE seq = 99 + n")
def replica_prefix(spark, sf_dir):
    return tail.contiguous(views.event_log(spark, sf_dir).where("seq <> 250"), 99).select("seq", "key")


@query(BASE + "SELECT coalesce(max(seq) + 1, 0) AS next_seq FROM log")
def tail_sequence(spark, sf_dir):
    return views.event_log(spark, sf_dir).agg((F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("next_seq"))


@query(BASE + "SELECT k AS key, seq, et AS event_type FROM live")
def continuous_live_view(spark, sf_dir):
    stream = spark.readStream.schema(_EVENTS).parquet(f"{sf_dir}/events.parq*")
    log = stream.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), (F.col("event_type") == "error").alias("deleted"), "event_type")
    to = scratch(spark, "live-view")
    done = tail.live_view(log, ["event_type"]).writeStream.outputMode("update").option("checkpointLocation", f"{to}/state").trigger(availableNow=True)
    done.foreachBatch(lambda rows, epoch: rows.write.mode("append").parquet(f"{to}/rows")).start().awaitTermination()
    return resolve.live_set(spark.read.schema("key long, seq long, deleted boolean, event_type string").parquet(f"{to}/rows")).select("key", "seq", "event_type")


def _value() -> T.StructType:
    return T.StructType([T.StructField("event_type", T.StringType()), T.StructField("props", T.StringType())])


def _rows(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    log = views.event_log(spark, sf_dir, dense)
    return log.select("key", F.when(~F.col("deleted"), F.struct("event_type", "props")).alias("value"), "deleted", F.col("seq").alias("ordinal"))


def stored_log(spark: SparkSession, sf_dir: str, dense: bool = False, options: Options | None = None) -> Store:
    """events as a store on disk, in two commits."""
    store = Store.create(spark, scratch(spark, "store"), T.LongType(), _value(), options)
    rows = _rows(spark, sf_dir, dense)
    store.apply(rows.where(F.col("ordinal") < HALF))
    store.apply(rows.where(F.col("ordinal") >= HALF))
    return store


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events put into a new store in one commit: what a cold build writes; its segments' sizes."""
    store = Store.create(spark, scratch(spark, "store"), T.LongType(), _value())
    store.apply(_rows(spark, sf_dir))
    return spark.createDataFrame([(s.segment_id, s.records, s.bytes) for s in store.manifest.segments], "segment_id int, records long, bytes long")


@query(BASE + "SELECT k AS key, seq, et AS event_type FROM live")
def stored_live_set(spark, sf_dir):
    store = stored_log(spark, sf_dir)
    store.checkpoint()
    return Store.open(spark, store.files.base).live.select("key", "seq", F.col("value.event_type").alias("event_type"))


@query(f"WITH {DENSE}, {LIVE} SELECT k AS key, seq, et AS event_type FROM live")
def stored_compaction(spark, sf_dir):
    store = stored_log(spark, sf_dir, dense=True)
    store.compact()
    return Store.open(spark, store.files.base).live.select("key", "seq", F.col("value.event_type").alias("event_type"))


@query(BASE + "SELECT row_number() OVER (ORDER BY k) AS pos, k AS key, et AS event_type FROM live")
def sorted_run(spark, sf_dir):
    from keelson.operators.order import global_rank

    live = resolve.live_set(views.event_log(spark, sf_dir)).select("key", F.struct("event_type", "props").alias("value"))
    path = scratch(spark, "run")
    files.export_sorted(live, path)
    return global_rank(files.scan_sorted(spark, path), "key", "pos").select("pos", "key", F.col("value.event_type").alias("event_type"))


@query("SELECT user_id AS key, max_by(event_type, event_id) AS value, count(*) AS records FROM events GROUP BY 1")
def import_lww_dups(spark, sf_dir):
    """Events as CSV lines, imported in line order: the last line of a key wins, all lines stay in the log."""
    path = scratch(spark, "csv")
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select("user_id", "event_type").write.csv(f"{path}/lines")
    source = files.csv_source(spark, f"{path}/lines", "key long, value string", "key", "value")
    store = Store.import_into(spark, f"{path}/store", source)
    return store.live.select("key", "value").join(store.log.groupBy("key").agg(F.count("*").alias("records")), "key")


_LAST = "SELECT user_id AS key, max_by(event_type, event_id) AS value, count(*) AS records FROM events GROUP BY 1"


def _last_and_count(store: Store) -> DataFrame:
    return store.live.select("key", "value").join(store.log.groupBy("key").agg(F.count("*").alias("records")), "key")


@query(_LAST)
def import_jsonl(spark, sf_dir):
    path = scratch(spark, "jsonl")
    spark.read.parquet(f"{sf_dir}/events.parquet").orderBy("event_id").select("user_id", "event_type").write.json(f"{path}/lines")
    source = files.jsonl_source(spark, f"{path}/lines", "user_id long, event_type string", "user_id", "event_type")
    return _last_and_count(Store.import_into(spark, f"{path}/store", source))


@query(_LAST)
def import_binary(spark, sf_dir):
    """Through the binary format and back: written by the sink, read by the source."""
    path = scratch(spark, "binary")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("ordinal"))
    files.parquet_sink(rows, f"{path}/rows")
    return _last_and_count(Store.import_into(spark, f"{path}/store", files.parquet_source(spark, f"{path}/rows", "key", "value")))


@query(BASE + "SELECT k AS key, et AS event_type FROM live")
def import_sorted_run(spark, sf_dir):
    path = scratch(spark, "run")
    files.export_sorted(resolve.live_set(views.event_log(spark, sf_dir)).select("key", F.col("event_type").alias("value")), f"{path}/run")
    store = Store.import_sorted(spark, f"{path}/store", f"{path}/run")
    return store.live.select("key", F.col("value").alias("event_type"))


@query(BASE.replace("FROM events)", f"FROM events WHERE event_id < {HALF})") + "SELECT k AS key, seq, et AS event_type FROM live")
def backup_restore(spark, sf_dir):
    """A backup between two commits holds the first alone."""
    rows, path = _rows(spark, sf_dir), scratch(spark, "backup")
    store = Store.create(spark, f"{path}/store", T.LongType(), _value())
    store.apply(rows.where(F.col("ordinal") < HALF))
    store.backup(f"{path}/copy")
    store.apply(rows.where(F.col("ordinal") >= HALF))
    return Store.open(spark, f"{path}/copy").live.select("key", "seq", F.col("value.event_type").alias("event_type"))


@query("SELECT 1 AS segment_id WHERE (SELECT max(event_id) FROM events) >= 5000")
def verify_damaged(spark, sf_dir):
    store = stored_log(spark, sf_dir)
    for s in store.manifest.segments:
        if s.segment_id == 1:
            store.files.delete(s.folder)
    return spark.createDataFrame([(n,) for n in store.verify()], "segment_id int")


@query(BASE_DENSE + "SELECT count(*) AS records, (SELECT count(*) FROM live) AS live, sum(bytes)::BIGINT AS bytes, (sum(bytes) - (SELECT sum(bytes) FROM live))::BIGINT AS garbage_bytes, max(seq) + 1 AS next_seq FROM log")
def store_stats(spark, sf_dir):
    found = stored_log(spark, sf_dir, dense=True).stats()
    names = ("records", "live", "bytes", "garbage_bytes", "next_seq")
    return spark.createDataFrame([tuple(found[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("SELECT o_orderkey AS key, o_custkey AS attribute FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey BETWEEN 100 AND 300 UNION ALL SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 = 0 AND o_custkey + 1 BETWEEN 100 AND 300")
def indexed_store(spark, sf_dir):
    """An indexed store after puts, puts that replace others, deletes, and a batch that is refused as a whole."""
    rows = views.orders(spark, sf_dir).select("key", F.col("o_custkey").alias("value"))
    store = Store.create(spark, scratch(spark, "indexed"), T.LongType(), T.LongType(), indexes=IndexSet().secondary("customer", F.col("value")))
    store.put_all(rows)
    store.put_all(rows.where("key % 7 = 0").withColumn("value", F.col("value") + 1))
    store.delete_all(rows.where("key % 3 = 0").select("key"))
    try:
        store.put_all(rows.limit(5).withColumn("value", F.lit(None).cast("long")))
    except ValueError:
        pass
    return store.by_attribute("customer", 100, 300).select("key", "attribute")


def _live(store: Store) -> DataFrame:
    return store.live.select("key", "seq", F.col("value.event_type").alias("event_type"))


_LIVE_ROWS = BASE + "SELECT k AS key, seq, et AS event_type FROM live"


@query(_LIVE_ROWS)
def interrupted_commit(spark, sf_dir):
    """A writer that died before its manifest leaves a batch that no reader sees, and a later writer isn't hindered by it."""
    store = Store.create(spark, scratch(spark, "store"), T.LongType(), _value())
    rows = _rows(spark, sf_dir)
    store.apply(rows.where(F.col("ordinal") < HALF))
    segments.write_segments(store.files, store.log.limit(9).withColumn("seq", F.col("seq") + 10**9).withColumn("segment_id", F.lit(1)))
    again = Store.open(spark, store.files.base)
    again.apply(rows.where(F.col("ordinal") >= HALF))
    return _live(Store.open(spark, store.files.base))


@query(_LIVE_ROWS)
def racing_writers(spark, sf_dir):
    """Of two writers on the same state one commits and the other is refused; neither a compaction of the old state goes through."""
    store = stored_log(spark, sf_dir)
    late = Store.open(spark, store.files.base)
    store.checkpoint()
    try:
        late.put_all(spark.createDataFrame([(1, ("never", "never"))], T.StructType([T.StructField("key", T.LongType()), T.StructField("value", _value())])))
    except StoreError:
        pass
    late.compact()
    return _live(Store.open(spark, store.files.base))


@query("SELECT n AS generation, n = CASE WHEN (SELECT max(event_id) FROM events) >= 5000 THEN 4 ELSE 3 END AS newest FROM range(1, CASE WHEN (SELECT max(event_id) FROM events) >= 5000 THEN 5 ELSE 4 END) t(n)")
def manifest_list(spark, sf_dir):
    """Generations of a store after its creation, its commits and a checkpoint; an empty batch makes none, and a damaged manifest is passed over."""
    store = stored_log(spark, sf_dir)
    store.checkpoint()
    top = manifests.next_generation(store.files)
    store.files.write_new("{damaged", manifests.FOLDER, f"manifest-{top:08d}.json")
    found = [(g, g == manifests.latest(store.files).generation) for g in manifests.generations(store.files) if manifests.load(store.files, g)]
    return spark.createDataFrame(found, "generation long, newest boolean")


@query(f"WITH {LOG} SELECT seq, k AS key, del AS deleted FROM log")
def listener_isolation(spark, sf_dir):
    """A listener that fails stops neither its own tail nor another."""
    store = stored_log(spark, sf_dir)

    def fail(rows: DataFrame, gap: bool) -> None:
        raise ValueError("a listener's own trouble")

    failing = tail.Tail(fail)
    failing.start(spark, store.files.base, f"{scratch(spark, 'tail')}/state", available_now=True, commits_a_trigger=1).awaitTermination()
    if not failing.errors or failing.last != store.tail_sequence() - 1:
        raise AssertionError("the failing tail stopped")
    return delivered(store).select("seq", "key", "deleted")


@query(f"WITH {LOG} SELECT least(count(*), 5000) - 1 AS applied, count(*) - least(count(*), 5000) AS lag, count(*) AS next_seq FROM log")
def replica_lag(spark, sf_dir):
    """How far a replica is behind that was made between two commits."""
    store = Store.create(spark, scratch(spark, "store"), T.LongType(), _value())
    rows = _rows(spark, sf_dir)
    store.apply(rows.where(F.col("ordinal") < HALF))
    replica = tail.Replica.bootstrap(store, scratch(spark, "replica"))
    store.apply(rows.where(F.col("ordinal") >= HALF))
    return spark.createDataFrame([(replica.applied, replica.lag(store.tail_sequence()), store.tail_sequence())], "applied long, lag long, next_seq long")


@query(_LIVE_ROWS.replace("FROM live", "FROM live WHERE k <> 42") + " UNION ALL SELECT 42, (SELECT count(*) FROM log), 'promoted'")
def promoted_replica(spark, sf_dir):
    """A replica's folder opens as a store that takes writes."""
    primary = stored_log(spark, sf_dir)
    replica = tail.Replica.bootstrap(primary, scratch(spark, "replica"))
    store = Store.open(spark, replica.store.files.base)
    store.put_all(spark.createDataFrame([(42, ("promoted", ""))], T.StructType([T.StructField("key", T.LongType()), T.StructField("value", _value())])))
    return _live(store)


@query(None)
def generated_workload(spark, sf_dir):
    """The live set after a skewed workload of puts and deletes."""
    rows = workload(spark, 20_000, 1_000, "skewed")
    store = Store.create(spark, scratch(spark, "store"), T.LongType(), T.StringType())
    store.apply(rows)
    return store.live.select("key", "seq")
