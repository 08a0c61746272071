"""Plans that must stay as they are: what is pushed down, pruned, and shuffled."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.operators import indexes, interval_join, lookup, order, resolve, space
from keelson.plans.store import Store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path):
    store = Store.create(spark, f"file://{tmp_path}/s", T.LongType(), T.StringType())
    store.put_all(spark.range(100).select(F.col("id").alias("key"), F.col("id").cast("string").alias("value")))
    return store


def test_key_predicates_reach_the_scan(spark, tmp_path):
    log = stored(spark, tmp_path).log
    assert "EqualTo(key,5)" in plan(lookup.get(log, 5))
    assert "GreaterThanOrEqual(key,5)" in plan(lookup.key_range(log, 5, 9))
    assert "LessThan(seq,7)" in plan(resolve.as_of_record(log, 7))


def test_value_predicates_stay_above_resolution(spark, tmp_path):
    found = plan(resolve.live_set(stored(spark, tmp_path).log).where("value = '5'"))
    assert "EqualTo(value,5)" not in found


def test_only_needed_columns_are_read(spark, tmp_path):
    found = plan(space.garbage(stored(spark, tmp_path).log))
    schema = found.split("ReadSchema: struct<", 1)[1].split(">", 1)[0]
    assert "value" not in schema and "crc" not in schema


def test_resolution_limits_groups_before_the_shuffle(spark, tmp_path):
    found = plan(resolve.live_set(stored(spark, tmp_path).log))
    assert "WindowGroupLimit" in found and "Partial" in found and found.count("Exchange hashpartitioning") == 1


def test_dead_bytes_need_one_shuffle_by_key_and_no_join(spark, tmp_path):
    assert "Join" not in plan(space.segment_stats(stored(spark, tmp_path).log))


def test_no_plan_multiplies_rows(spark, tmp_path):
    live = stored(spark, tmp_path).live
    spans = live.select("key", F.col("key").alias("start"), (F.col("key") + 3).alias("end"))
    points = spark.range(5).select(F.col("id").alias("point"))
    for df in (interval_join.stab_join(spans, points, 4), order.global_rank(live, "key"), order.rank_of(live, live.select("key")), indexes.stab(spans, F.col("start"), F.col("end"), 4)):
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
