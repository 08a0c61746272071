"""Stores on disk against a dict, across reopening, compaction and damage; streams and replicas."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.records import Options
from keelson.operators.indexes import IndexSet
from keelson.plans.store import Store, StoreError
from keelson.sources import files, manifest
from keelson.sources.fs import Files
from keelson.streaming import tail


def new(spark, tmp_path, name="s", **how):
    return Store.create(spark, f"file://{tmp_path}/{name}", T.LongType(), T.StringType(), **how)


def batch(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, key long, value string, deleted boolean")


def contents(live):
    return {r["key"]: r["value"] for r in live.collect()}


def ops(seed, n, keys):
    r = random.Random(seed)
    return [(r.randrange(keys), None, True) if r.random() < 0.25 else (r.randrange(keys), f"v{i}", False) for i in range(n)]


def replay(rows, into=None):
    live = dict(into or {})
    for k, v, d in rows:
        live.pop(k, None) if d else live.__setitem__(k, v)
    return live


def test_state_survives_batches_reopening_checkpoint_and_compaction(spark, tmp_path):
    store, want = new(spark, tmp_path), {}
    for seed in range(3):
        rows = ops(seed, 300, 80)
        assert store.apply(batch(spark, rows)) == 300
        want = replay(rows, want)
        assert contents(store.live) == want
    path = store.files.base
    assert [r["seq"] for r in store.log.orderBy("seq").collect()] == list(range(900))
    assert contents(Store.open(spark, path).live) == want
    store.checkpoint()
    rows = ops(9, 100, 80)
    store.apply(batch(spark, rows))
    want = replay(rows, want)
    assert contents(Store.open(spark, path).live) == want
    before = store.stats()
    freed = store.compact()
    after = store.stats()
    assert freed > 0 and before["bytes"] - after["bytes"] == freed and after["live"] == len(want)
    assert contents(Store.open(spark, path).live) == want
    assert store.verify() == [] and store.vacuum() == 0 and store.vacuum(older_than=0) > 0 and contents(Store.open(spark, path).live) == want
    ages = {r["key"]: r["seq"] for r in store.live.collect()}
    assert max(ages.values()) < 1000 and len(set(ages.values())) == len(ages)  # compaction keeps seq


def test_as_of_every_prefix(spark, tmp_path):
    rows = ops(424242, 150, 40)
    store = new(spark, tmp_path)
    store.apply(batch(spark, rows))
    for n in (0, 1, 37, 149, 150, 999):
        assert contents(store.as_of_record(n)) == replay(rows[:n])


def test_points_deletes_and_refusals(spark, tmp_path):
    store = new(spark, tmp_path)
    store.put(5, "a")
    store.put(5, "b")
    assert store.get(5) == "b" and store.get(6) is None and store.size() == 1
    assert store.delete(5) is True and store.delete(5) is False and store.tail_sequence() == 4
    with pytest.raises(ValueError):
        store.apply(batch(spark, [(1, None, False)]))
    with pytest.raises(StoreError):
        new(spark, tmp_path)
    other = Store.open(spark, store.files.base)
    other.put(1, "x")
    with pytest.raises(StoreError):
        store.put(2, "y")
    assert store.refresh().get(1) == "x"


def test_indexed_batches_are_refused_whole(spark, tmp_path):
    parts = F.split("value", ":")
    declared = IndexSet().interval("span", parts[0].cast("int"), parts[1].cast("int"))
    store = new(spark, tmp_path, indexes=declared)
    with pytest.raises(ValueError):
        store.apply(batch(spark, [(1, "1:2", False), (2, "5:3", False)]))
    assert store.size() == 0
    store.apply(batch(spark, [(1, "1:9", False), (2, "3:4", False)]))
    assert [r["key"] for r in store.stab("span", 4).collect()] == [1, 2]
    store.apply(batch(spark, [(2, "7:8", False)]))
    assert [r["key"] for r in store.stab("span", 4).collect()] == [1]
    with pytest.raises(ValueError):
        new(spark, tmp_path, "r", options=Options(retain_newest=5), indexes=declared)


def test_segments_are_cut_and_retention_is_a_view(spark, tmp_path):
    store = new(spark, tmp_path, options=Options(segment_bytes=2048, retain_newest=10))
    store.apply(batch(spark, [(k, "x" * 100, False) for k in range(100)]))
    assert len(store.manifest.segments) >= 5
    assert sorted(contents(store.live)) == list(range(90, 100))


def test_snapshot_is_fixed_and_blocks_compaction(spark, tmp_path):
    store = new(spark, tmp_path)
    for v in ("a", "b", "c"):
        store.apply(batch(spark, [(k, v, False) for k in range(20)]))
    with store.snapshot() as snap:
        store.apply(batch(spark, [(k, "later", False) for k in range(30)]))
        assert snap.size() == 20 and snap.get(3) == "c" and (snap.first_key(), snap.last_key()) == (0, 19)
        assert store.compact() == 0
        snap.close()
    assert store.compact() > 0
    assert store.maintain() == 0


def test_backup_restore_and_damage(spark, tmp_path):
    store = new(spark, tmp_path)
    store.apply(batch(spark, [(k, f"v{k}", False) for k in range(50)]))
    store.backup(f"file://{tmp_path}/copy")
    store.apply(batch(spark, [(1, "changed", False)]))
    copy = Store.open(spark, f"file://{tmp_path}/copy")
    assert copy.get(1) == "v1" and copy.verify() == []
    folder = copy.manifest.segments[0].folder
    copy.files.delete(folder)
    assert copy.verify() == [0]
    f = Files(spark, f"file://{tmp_path}/s")
    g = manifest.next_generation(f)
    f.write_new("{damaged", "manifests", f"manifest-{g:08d}.json")
    assert manifest.latest(f).generation == g - 1 and manifest.next_generation(f) == g + 1
    assert Store.open(spark, f.base).get(1) == "changed"


def test_csv_and_json_import_in_line_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text('5,first\n5,second\n6,"a, ""b"""\n5,third\n')
    rows = files.csv_source(spark, f"file://{tmp_path}/a.csv", "key long, value string", "key", "value")
    store = Store.import_into(spark, f"file://{tmp_path}/csv", rows)
    assert contents(store.live) == {5: "third", 6: 'a, "b"'} and store.log.count() == 4
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 1, "v": "y"}\n')
    rows = files.jsonl_source(spark, f"file://{tmp_path}/a.jsonl", "k long, v string", "k", "v")
    assert contents(Store.import_into(spark, f"file://{tmp_path}/json", rows).live) == {1: "y"}
    with pytest.raises(StoreError):
        Store.import_into(spark, f"file://{tmp_path}/csv", rows)


def test_sorted_runs(spark, tmp_path):
    store = new(spark, tmp_path)
    rows = ops(42, 300, 100)
    store.apply(batch(spark, rows))
    path = f"file://{tmp_path}/run"
    assert store.export_sorted(path) == len(replay(rows))
    got = [(r["key"], r["value"]) for r in files.scan_sorted(spark, path).collect()]
    assert got == sorted(replay(rows).items())
    assert contents(Store.import_sorted(spark, f"file://{tmp_path}/again", path).live) == replay(rows)
    new(spark, tmp_path, "empty").export_sorted(f"file://{tmp_path}/none")
    assert files.scan_sorted(spark, f"file://{tmp_path}/none").count() == 0
    spark.createDataFrame([(1, "x")], "key long, value string").write.mode("append").parquet(f"{path}/run")
    with pytest.raises(OSError):
        files.scan_sorted(spark, path)
    with pytest.raises(OSError):
        files.scan_sorted(spark, f"file://{tmp_path}/absent")


def test_replica_follows_and_stops_at_a_hole(spark, tmp_path):
    store, replica = new(spark, tmp_path), tail.Replica(new(spark, tmp_path, "replica"))
    for seed in (1, 2):
        store.apply(batch(spark, ops(seed, 100, 30)))
        replica(store.log)
        replica(store.log)  # met again: nothing changes
        assert contents(replica.store.live) == contents(store.live) and replica.lag(store.tail_sequence()) == 0
    store.apply(batch(spark, [(k, "new", False) for k in range(5)]))
    replica(store.log.where("seq <> 202"))
    assert replica.gapped and replica.applied == 201 and replica.lag(store.tail_sequence()) == 3
    assert Store.open(spark, replica.store.files.base).size() == replica.store.size()  # a replica is a plain store


def test_tail_order_gaps_and_listener_errors(spark, tmp_path):
    seen, store = [], new(spark, tmp_path)
    store.apply(batch(spark, [(k, f"v{k}", False) for k in range(20)]))
    follower = tail.Tail(lambda rows, gap: seen.append(([r["seq"] for r in rows.collect()], gap)), from_seq=3)
    follower.start(spark, store.files.base, f"file://{tmp_path}/state", available_now=True).awaitTermination()
    assert seen == [(list(range(3, 20)), False)]
    follower(store.log.withColumn("seq", F.col("seq") + 25))
    assert seen[-1][1] is True and follower.gaps == 1
    narrow = tail.Tail(lambda rows, gap: seen.append(([r["seq"] for r in rows.collect()], gap)), ring=8)
    narrow(store.log)
    assert seen[-1] == (list(range(12, 20)), True)
    failing = tail.Tail(lambda rows, gap: 1 / 0)
    failing(store.log)
    assert failing.errors == 1 and failing.last == 19


def collected(seen):
    return lambda rows, gap: seen.append(([r["seq"] for r in rows.collect()], gap))


def test_a_tail_goes_on_where_its_checkpoint_stands(spark, tmp_path):
    store, seen = new(spark, tmp_path, options=Options(segment_bytes=1024)), []
    for n in range(3):
        store.apply(batch(spark, [(k, f"v{n}" * 20, False) for k in range(40)]))
        tail.Tail(collected(seen)).start(spark, store.files.base, f"file://{tmp_path}/state", available_now=True).awaitTermination()
    assert len(store.manifest.segments) >= 9
    assert seen == [(list(range(40 * n, 40 * n + 40)), False) for n in range(3)]


def test_a_tail_delivers_commits_whole_and_nothing_uncommitted(spark, tmp_path):
    from keelson.sources import log as segments

    store, seen = new(spark, tmp_path, options=Options(segment_bytes=1024)), []
    store.apply(batch(spark, [(k, "x" * 50, False) for k in range(400)]))
    segments.write_segments(store.files, store.log.limit(3).withColumn("seq", F.col("seq") + 5000).withColumn("segment_id", F.lit(999)))
    store.apply(batch(spark, [(k, "y", False) for k in range(5)]))
    tail.Tail(collected(seen)).start(spark, store.files.base, f"file://{tmp_path}/one", available_now=True, commits_a_trigger=1).awaitTermination()
    assert [x for rows, _ in seen for x in rows] == list(range(405)) and not any(gap for _, gap in seen)
    replica = tail.Replica(new(spark, tmp_path, "replica"))
    replica.start(spark, store.files.base, f"file://{tmp_path}/two", available_now=True, commits_a_trigger=1).awaitTermination()
    assert not replica.gapped and contents(replica.store.live) == contents(store.live)


def test_a_late_tail_is_told_what_compaction_took(spark, tmp_path):
    store, seen = new(spark, tmp_path), []
    for n in range(3):
        store.apply(batch(spark, [(k, f"v{n}", False) for k in range(20)]))
    store.compact()
    store.vacuum(older_than=0)
    tail.Tail(collected(seen)).start(spark, store.files.base, f"file://{tmp_path}/state", available_now=True).awaitTermination()
    assert seen == [(list(range(40, 60)), True)]


def test_retention_frees_what_it_evicts(spark, tmp_path):
    store = new(spark, tmp_path, options=Options(retain_newest=3))
    store.apply(batch(spark, [(k, f"v{k}", False) for k in range(10)]))
    store.apply(batch(spark, [(99, "last", False)]))
    stats = store.stats()
    assert stats["live"] == 3 and stats["garbage_bytes"] > 0
    assert store.compact() > 0 and store.log.count() == 3
    assert contents(store.live) == contents(Store.open(spark, store.files.base).live) == {8: "v8", 9: "v9", 99: "last"}


def test_as_of_counts_what_compaction_left(spark, tmp_path):
    store = new(spark, tmp_path)
    for n in range(2):
        store.apply(batch(spark, [(k, f"{n}", False) for k in range(3)]))
    store.apply(batch(spark, [(0, "end", False)]))
    store.compact()
    left = [(r["key"], r["value"]) for r in store.log.orderBy("seq").collect()]
    assert len(left) == 3  # keys 1 and 2 of the second batch, and the third
    for n in range(5):
        assert contents(store.as_of_record(n)) == dict(left[:n])


def test_only_one_of_two_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    f = Files(spark, f"file://{tmp_path}/race")
    f.make("manifests")
    with ThreadPoolExecutor(8) as pool:
        for n in range(20):
            won = list(pool.map(lambda i: f.write_new(f"writer {i}", "manifests", f"m{n}"), range(8)))  # noqa: B023
            assert sum(won) == 1 and f.read("manifests", f"m{n}") == f"writer {won.index(True)}"
    assert len(f.names("manifests")) == 20  # no scratch file is left
    store = new(spark, tmp_path)

    def write(i):
        try:
            return Store.open(spark, store.files.base).apply(batch(spark, [(i, f"v{i}", False)]))
        except StoreError:
            return 0

    with ThreadPoolExecutor(4) as pool:
        done = sum(pool.map(write, range(4)))
    now = Store.open(spark, store.files.base)
    assert done >= 1 and now.size() == done == now.manifest.next_seq and now.verify() == []


def test_many_commits_are_one_relation(spark, tmp_path):
    store = new(spark, tmp_path)
    for k in range(6):
        store.put(k, "x")
    plan = store.log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan and contents(store.live) == {k: "x" for k in range(6)}


def test_a_pin_expires_and_can_be_renewed(spark, tmp_path):
    store = new(spark, tmp_path)
    for v in ("a", "b", "c"):
        store.apply(batch(spark, [(k, v, False) for k in range(20)]))
    dead = store.snapshot(seconds=-1)  # its reader is gone
    held = store.snapshot(seconds=600)
    assert store.compact() == 0
    held.close()
    assert store.compact() > 0 and dead.size() == 20
    dead.close()


def test_large_rows_dont_overfill_segments(spark, tmp_path):
    store = new(spark, tmp_path, options=Options(segment_bytes=4096))
    rows = spark.createDataFrame([(i, i, "x" * (900 if i < 20 else 10), False) for i in range(400)], "ordinal long, key long, value string, deleted boolean")
    store.apply(rows)
    assert sum(s.records for s in store.manifest.segments) == 400 and store.verify() == []
    assert [s.low for s in store.manifest.segments] == sorted(s.low for s in store.manifest.segments)


def test_binary_sink_and_source(spark, tmp_path):
    rows = spark.createDataFrame([(3, 1, "b"), (1, 1, "a"), (2, 2, "c")], "ordinal long, key long, value string")
    files.parquet_sink(rows, f"file://{tmp_path}/bin")
    store = Store.import_into(spark, f"file://{tmp_path}/from-bin", files.parquet_source(spark, f"file://{tmp_path}/bin", "key", "value"))
    assert contents(store.live) == {1: "b", 2: "c"} and store.log.count() == 3


def test_replica_from_a_backup_follows_a_stream(spark, tmp_path):
    store = new(spark, tmp_path)
    store.apply(batch(spark, ops(1, 100, 30)))
    replica = tail.Replica.bootstrap(store, f"file://{tmp_path}/copy")
    assert contents(replica.store.live) == contents(store.live) and replica.lag(store.tail_sequence()) == 0
    query = replica.start(spark, store.files.base, f"file://{tmp_path}/replica-state")
    store.apply(batch(spark, ops(2, 60, 30)))
    try:
        assert tail.caught_up(query, replica, store.tail_sequence())
    finally:
        query.stop()
    assert contents(replica.store.live) == contents(store.live)


@pytest.mark.parametrize("regime", ["uniform", "sequential", "skewed", "churn"])
def test_workloads_are_repeatable(spark, tmp_path, regime):
    from keelson.sources.workload import workload

    rows = workload(spark, 500, 64, regime)
    assert rows.collect() == workload(spark, 500, 64, regime).collect()
    store = new(spark, tmp_path)
    store.apply(rows)
    assert contents(store.live) == replay([(r["key"], r["value"], r["deleted"]) for r in rows.orderBy("ordinal").collect()])
