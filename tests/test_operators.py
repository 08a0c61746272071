"""Operators against a dict and sorted lists, from seeded random logs."""

import random

import pytest
from pyspark.sql import functions as F

from keelson.functions.records import Options, byte_size, invalid, schema, with_record_columns
from keelson.operators import indexes, interval_join, lookup, order, resolve, space


def random_log(seed, n, keys, deletes=0.25):
    r = random.Random(seed)
    return [(i, r.randrange(keys), r.random() < deletes, f"v{i}", i // 100, 20 + i % 7) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "seq long, key long, deleted boolean, value string, segment_id int, record_bytes long")


def replay(rows):
    live = {}
    for seq, key, deleted, value, *_ in rows:
        live.pop(key, None) if deleted else live.__setitem__(key, (seq, value))
    return live


@pytest.fixture(scope="module")
def rows():
    return random_log(42, 2000, 400)


@pytest.fixture(scope="module")
def log(spark, rows):
    return frame(spark, rows).cache()


def test_live_set_equals_replay(log, rows):
    assert {r["key"]: (r["seq"], r["value"]) for r in resolve.live_set(log).collect()} == replay(rows)


@pytest.mark.parametrize("n", [0, 1, 50, 777, 2000, 5000])
def test_as_of_is_a_prefix(log, rows, n):
    assert {r["key"] for r in resolve.as_of_record(log, n).collect()} == set(replay(rows[:n]))


def test_as_of_refuses_negative(log):
    with pytest.raises(ValueError):
        resolve.as_of_record(log, -1)


def test_checkpoint_and_delta_equal_whole(log, rows):
    old = resolve.live_set(log.where("segment_id <= 9"))
    assert {r["key"]: r["seq"] for r in resolve.from_checkpoint(old, log.where("segment_id > 9")).collect()} == {k: v[0] for k, v in replay(rows).items()}


def test_retention_keeps_the_newest_and_rewrites_refresh(spark):
    writes = [*range(150), *range(50), *range(150, 200)]
    live = resolve.live_set(frame(spark, [(i, k, False, "v", 0, 20) for i, k in enumerate(writes)]))
    assert sorted(r["key"] for r in resolve.retain_newest(live, 100).collect()) == [*range(50), *range(150, 200)]
    with pytest.raises(ValueError):
        resolve.retain_newest(live, 10, indexed=True)


def test_reads(spark, log, rows):
    live = replay(rows)
    assert [r["key"] for r in lookup.key_range(log, 100, 200).collect()] == sorted(k for k in live if 100 <= k <= 200)
    assert lookup.key_range(log, 200, 100).count() == 0
    asked = spark.createDataFrame([(3,), (3,), (9999,)], "key long")
    found = lookup.multi_get(log, asked).collect()
    assert sorted((r["key"], r["seq"]) for r in found if r["key"] == 3) == [(3, live[3][0])] * 2 if 3 in live else True
    assert [r["seq"] for r in found if r["key"] == 9999] == [None]
    assert {r["key"]: r["existed"] for r in lookup.existed(log, asked).collect()} == {3: 3 in live, 9999: False}
    with pytest.raises(ValueError):
        lookup.get(log, None)


def test_order_statistics(spark, log, rows):
    keys = sorted(replay(rows))
    live = resolve.live_set(log).cache()
    assert order.count_range(live, 20, 90).first()["n"] == sum(20 <= k <= 90 for k in keys)
    assert order.count_range(live, 90, 20).first()["n"] == 0
    for rank in (1, 5, len(keys)):
        assert order.nth_key(live, rank).first()["key"] == keys[rank - 1]
    for rank in (0, -1, len(keys) + 1):
        with pytest.raises(IndexError):
            order.nth_key(live, rank)
    asked = [keys[0], keys[7], keys[-1], -5, 10**6]
    found = {r["key"]: r["rank"] for r in order.rank_of(live, spark.createDataFrame([(k,) for k in asked], "key long")).collect()}
    assert found == {k: keys.index(k) + 1 if k in keys else 0 for k in asked}
    assert {r["pct"]: r["key"] for r in order.percentile_keys(live, [0, 1, 50, 99, 100]).collect()} == {p: keys[max(1, -(-p * len(keys) // 100)) - 1] for p in (0, 1, 50, 99, 100)}
    assert order.median_key(live).first()["key"] == keys[(len(keys) + 1) // 2 - 1]
    assert tuple(order.first_last(live).first()) == (keys[0], keys[-1])
    with pytest.raises(ValueError):
        order.percentile_keys(live, [101])


def test_order_statistics_of_nothing(spark):
    none = resolve.live_set(frame(spark, []))
    assert order.count_range(none, 0, 10).first()["n"] == 0
    assert order.percentile_keys(none, [50]).count() == 0
    assert tuple(order.first_last(none).first()) == (None, None)
    with pytest.raises(IndexError):
        order.nth_key(none, 1)


def test_global_rank_of_strings_and_large_ranks(spark, monkeypatch):
    names = [f"k{i:05d}" for i in random.Random(1).sample(range(50_000), 3000)]
    df = spark.createDataFrame([(n,) for n in names], "key string")
    assert [r["key"] for r in order.global_rank(df, "key").orderBy("rank").collect()] == sorted(names)
    monkeypatch.setattr(order, "TOP", 10)
    monkeypatch.setattr(order, "ROWS_A_RANGE", 50)
    assert [r["key"] for r in order.global_rank(df, "key").orderBy("rank").collect()] == sorted(names)
    assert {r["pct"]: r["key"] for r in order.percentile_keys(df, [0, 33, 100]).collect()} == {0: min(names), 33: sorted(names)[989], 100: max(names)}
    assert order.nth_key(df, 2500).first()["key"] == sorted(names)[2499]


def test_no_range_holds_much_more_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(order, "ROWS_A_RANGE", 1000)
    rows = order._hashed(spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderpriority"))
    by = order._order(rows, "o_orderpriority", None)
    n = rows.count()
    number, several = order._ranges(rows, by, n)
    held = [r["count"] for r in rows.groupBy(number.alias("r")).count().collect()]
    assert several == len(held) == -(-n // 1000) and max(held) <= 2 * n / several
    ranked = order.global_rank(rows.drop("__row_hash"), "o_orderpriority").collect()
    assert sorted(r["rank"] for r in ranked) == list(range(1, n + 1))
    assert [r["o_orderpriority"] for r in sorted(ranked, key=lambda r: r["rank"])] == sorted(r["o_orderpriority"] for r in ranked)
    nulls = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(5000)], "k long, v double")
    assert [r["v"] is None for r in order.global_rank(nulls, "v").orderBy("rank").collect()] == [True] * 3333 + [False] * 1667


def spans(spark, seed=42, n=400):
    r = random.Random(seed)
    rows = [(i, (s := r.randrange(200)), s + r.choice([0, 3, 29, 150]), r.randrange(40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "key long, start long, end long, attr int")


def test_indexes(spark):
    rows, live = spans(spark)
    declared = indexes.IndexSet().secondary("attr", F.col("attr")).interval("span", F.col("start"), F.col("end"))
    assert [r["key"] for r in declared.by_attribute(live, "attr", 10, 20).collect()] == [k for a, k in sorted((a, k) for k, _, _, a in rows if 10 <= a <= 20)]
    assert declared.by_attribute(live, "attr", 20, 10).count() == 0
    for p in (0, 57, 199, 400):
        assert [r["key"] for r in declared.stab(live, "span", p).collect()] == [k for s, e, k in sorted((s, e, k) for k, s, e, _ in rows if s <= p <= e)]
    assert [r["key"] for r in declared.overlapping(live, "span", 50, 60).collect()] == [k for s, e, k in sorted((s, e, k) for k, s, e, _ in rows if s <= 60 and e >= 50)]
    with pytest.raises(ValueError):
        declared.overlapping(live, "span", 60, 50)
    with pytest.raises(ValueError):
        declared.by_attribute(live, "attr", None, 5)
    with pytest.raises(ValueError):
        declared.secondary("span", F.col("attr"))
    with pytest.raises(KeyError, match="attr.*span"):
        declared.stab(live, "attr", 5)


def test_duplicate_spans_keep_their_order(spark):
    live = spark.createDataFrame([(1, 10, 20), (2, 10, 15), (3, 10, 20), (4, 12, 13)], "key long, start int, end int")
    assert [r["key"] for r in indexes.stab(live, F.col("start"), F.col("end"), 16).collect()] == [1, 3]
    assert [r["key"] for r in indexes.stab(live, F.col("start"), F.col("end"), 12).collect()] == [2, 1, 3, 4]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_interval_join_equals_nested_loops(spark, width):
    r = random.Random(width)
    some = [(i, (s := r.randrange(-300, 300)), s + r.choice([-1, 0, 2, 40, 5000])) for i in range(200)]
    asked = [(i, (s := r.randrange(-300, 300)), s + r.choice([-1, 0, 5, 900])) for i in range(60)]
    got = interval_join.overlap_join(spark.createDataFrame(some, "key long, start long, end long"), spark.createDataFrame(asked, "q long, lo long, hi long"), width)
    want = sorted((k, q) for k, s, e in some for q, lo, hi in asked if s <= e and lo <= hi and s <= hi and e >= lo)
    assert sorted((x["key"], x["q"]) for x in got.collect()) == want


def test_interval_join_of_nothing(spark):
    none = spark.createDataFrame([], "key long, start long, end long")
    assert interval_join.stab_join(none, spark.createDataFrame([(1,)], "point long"), 10).count() == 0


def test_interval_join_refuses_fractions_and_clashing_widths(spark):
    some = spark.createDataFrame([(1, 0.5, 1.5)], "key long, start double, end double")
    with pytest.raises(TypeError):
        interval_join.stab_join(some, spark.createDataFrame([(1,)], "point long"), 10)
    with pytest.raises(ValueError):
        interval_join.overlap_join(some, some, 0)


def test_space(log, rows):
    live = {v[0] for v in replay(rows).values()}
    stats = {r["segment_id"]: r for r in space.segment_stats(log).collect()}
    for seg, r in stats.items():
        mine = [x for x in rows if x[4] == seg]
        assert (r["records"], r["bytes"], r["garbage_bytes"], r["active"]) == (len(mine), sum(x[5] for x in mine), sum(x[5] for x in mine if x[0] not in live), seg == 19)
    total = space.garbage(log).first()
    assert total["garbage_bytes"] == sum(r["garbage_bytes"] for r in stats.values())
    assert {r["seq"] for r in space.compacted(log, 18).collect()} == {s for s in live if s < 1900}
    assert space.reclaimed(log, 18).first()[0] == sum(x[5] for x in rows if x[4] <= 18 and x[0] not in live)
    part = space.reclaimed(log, 18).first()[0] / sum(x[5] for x in rows if x[4] <= 18)
    assert space.compaction_due(log, 18, part).first()["due"] is False  # the ratio must be exceeded
    assert space.compaction_due(log, 18, part - 0.01).first()["due"] is True
    assert space.compaction_due(log, 18, 0).first()["due"] is False


def test_records(spark):
    from pyspark.sql import types as T

    log = spark.createDataFrame([(0, "a", False, (1, "xy"), 0), (1, "bcd", True, None, 0)], "seq long, key string, deleted boolean, value struct<n:int,s:string>, segment_id int")
    assert [r["record_bytes"] for r in with_record_columns(log).orderBy("seq").collect()] == [13 + 1 + 4 + 2, 13 + 3]
    bad = spark.createDataFrame([(None, False, "x"), ("k", False, None), ("k", True, None)], "key string, deleted boolean, value string")
    assert invalid(bad).count() == 2
    with pytest.raises(TypeError):
        schema(T.ArrayType(T.LongType()), T.StringType())
    assert spark.createDataFrame([("é",)], "s string").select(byte_size(F.col("s"), T.StringType())).first()[0] == 2


def test_torn_segments_are_cut_and_later_ones_apply(spark, rows):
    log = with_record_columns(frame(spark, rows).drop("record_bytes"))
    torn = log.withColumn("crc", F.when(F.col("seq") == 350, F.col("crc") + 1).otherwise(F.col("crc")))
    assert {r["seq"] for r in resolve.intact(torn).collect()} == {s for s in range(2000) if not 350 <= s < 400}
    with pytest.raises(ValueError):
        resolve.intact(torn, strict=True)
    assert resolve.intact(log, strict=True).count() == 2000


@pytest.mark.parametrize("bad", [{"segment_bytes": 100}, {"retain_newest": -1}, {"compact_when_garbage_above": 1.0}, {"tail_ring": 7}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        Options().with_(**bad)
