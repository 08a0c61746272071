"""Registered queries over the driver tables, and for each the DuckDB SQL of the same result.

The Spark side is built from the operators; the SQL shares no code with it. Ordered results carry their position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import indexes, interval_join, lookup, order, resolve, space

from . import views

LOG = """log AS (SELECT event_id AS seq, user_id AS k, event_type = 'error' AS del, event_type AS et, props,
  CAST(event_id // 1000 AS INT) AS seg,
  CAST(21 + CASE WHEN event_type = 'error' THEN 0 ELSE strlen(event_type) + strlen(props) END AS BIGINT) AS bytes FROM events)"""
DENSE = LOG.replace("user_id AS k", "user_id * 100 + day(ts) AS k")
LIVE = """r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log),
live AS (SELECT k, seq, et, props, seg, bytes FROM r WHERE rn = 1 AND NOT del)"""
BASE = f"WITH {LOG}, {LIVE} "
BASE_DENSE = f"WITH {DENSE}, {LIVE} "
SPANS = "sp AS (SELECT l_orderkey AS k, min(l_shipdate) AS s, max(l_shipdate) AS e FROM lineitem GROUP BY 1)"
#: The newest closed segment: all but the newest are closed.
CLOSED = "(SELECT max(seg) - 1 FROM log)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _keys(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "key long")


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _moment(text: str):
    import datetime

    return datetime.datetime.fromisoformat(text)


# --- state ---


@query(BASE + "SELECT k AS key, seq, et AS event_type, props FROM live")
def live_set(spark, sf_dir):
    return resolve.live_set(views.event_log(spark, sf_dir)).select("key", "seq", "event_type", "props")


@query(BASE + "SELECT k AS key, seq FROM r WHERE rn = 1 AND del")
def tombstoned_keys(spark, sf_dir):
    return resolve.tombstoned(views.event_log(spark, sf_dir)).select("key", "seq")


@query(BASE.replace("FROM events)", "FROM events WHERE event_id < 4000)") + "SELECT k AS key, seq, et AS event_type FROM live")
def as_of_4000(spark, sf_dir):
    return resolve.as_of_record(views.event_log(spark, sf_dir), 4000).select("key", "seq", "event_type")


@query(BASE.replace("FROM events)", "FROM events WHERE event_id < 0)") + "SELECT k AS key, seq FROM live")
def as_of_zero(spark, sf_dir):
    return resolve.as_of_record(views.event_log(spark, sf_dir), 0).select("key", "seq")


@query(BASE + "SELECT k AS key, seq FROM live ORDER BY seq DESC LIMIT 50")
def retain_newest_50(spark, sf_dir):
    return resolve.retain_newest(resolve.live_set(views.event_log(spark, sf_dir)), 50).select("key", "seq")


@query(f"WITH {LOG} SELECT k AS key, seq, lag(seq) OVER (PARTITION BY k ORDER BY seq) AS previous FROM log")
def overwrite_chain(spark, sf_dir):
    return resolve.overwrites(views.event_log(spark, sf_dir))


@query(BASE_DENSE + "SELECT k AS key, seq FROM live")
def checkpoint_plus_delta(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    checkpoint = resolve.live_set(log.where("segment_id <= 4"))
    return resolve.from_checkpoint(checkpoint, log.where("segment_id > 4")).select("key", "seq")


@query(
    f"""WITH {LOG}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq < 4000) WHERE rn = 1 AND NOT del),
{LIVE} SELECT coalesce(a.k, live.k) AS key, a.seq AS seq_then, live.seq AS seq_now FROM a FULL JOIN live ON a.k = live.k WHERE a.seq IS DISTINCT FROM live.seq"""
)
def snapshot_vs_live_diff(spark, sf_dir):
    log = views.event_log(spark, sf_dir)
    then = resolve.as_of_record(log, 4000).select("key", F.col("seq").alias("seq_then"))
    now = resolve.live_set(log).select("key", F.col("seq").alias("seq_now"))
    return then.join(now, "key", "full").where(~F.col("seq_then").eqNullSafe(F.col("seq_now")))


@query(f"WITH {LOG} SELECT count(*) AS n FROM log")
def count_records(spark, sf_dir):
    return views.event_log(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT seq, k AS key, del AS deleted FROM log WHERE seg > 6")
def delta_scan(spark, sf_dir):
    return views.event_log(spark, sf_dir).where("segment_id > 6").select("seq", "key", "deleted")


@query(f"WITH {LOG} SELECT seq, k AS key, del AS deleted FROM log WHERE seq = 4321")
def positional_read(spark, sf_dir):
    return lookup.record_at(views.event_log(spark, sf_dir), 4321).select("seq", "key", "deleted")


@query(f"WITH {LOG} SELECT seq, k AS key FROM log WHERE NOT (seg = 3 AND seq >= 3300)")
def torn_segment_truncation(spark, sf_dir):
    records = views.event_records(spark, sf_dir).withColumn("crc", F.when(F.col("seq").isin(3300, 3700), F.col("crc") + 1).otherwise(F.col("crc")))
    return resolve.intact(records).select("seq", "key")


# --- points and ranges ---


@query(BASE + "SELECT q.key, seq, et AS event_type FROM (VALUES (3), (7), (999)) q(key) LEFT JOIN live ON k = q.key")
def multi_get(spark, sf_dir):
    return lookup.multi_get(views.event_log(spark, sf_dir), _keys(spark, 3, 7, 999)).select("key", "seq", "event_type")


@query(BASE + "SELECT k AS key, seq, et AS event_type FROM live WHERE k = 7")
def get_key(spark, sf_dir):
    return lookup.get(views.event_log(spark, sf_dir), 7).select("key", "seq", "event_type")


@query(BASE + "SELECT row_number() OVER (ORDER BY k) AS pos, k AS key, et AS event_type FROM live WHERE k BETWEEN 20 AND 90")
def range_scan(spark, sf_dir):
    found = lookup.key_range(views.event_log(spark, sf_dir), 20, 90)
    return order.global_rank(found, "key", "pos").select("pos", "key", "event_type")


@query(BASE + "SELECT row_number() OVER (ORDER BY k) AS pos, k AS key, seq FROM live")
def full_ordered_scan(spark, sf_dir):
    return order.global_rank(resolve.live_set(views.event_log(spark, sf_dir, dense=False)), "key", "pos").select("pos", "key", "seq")


@query(BASE + "SELECT q.key, k IS NOT NULL AS existed FROM (VALUES (3), (7), (999)) q(key) LEFT JOIN live ON k = q.key")
def delete_existed(spark, sf_dir):
    return lookup.existed(views.event_log(spark, sf_dir), _keys(spark, 3, 7, 999)).select("key", "existed")


@query(BASE + "SELECT count(*) AS size FROM live")
def store_size(spark, sf_dir):
    return lookup.size(resolve.live_set(views.event_log(spark, sf_dir)))


@query(f"WITH {DENSE}, {LIVE}, " + "q AS (SELECT DISTINCT user_id * 100 + day(ts) AS key FROM events) SELECT q.key, live.seq FROM q LEFT JOIN live ON k = q.key")
def batch_lookup(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    return lookup.multi_get(log, log.select("key").distinct()).select("key", "seq")


# --- order statistics ---


@query(BASE + "SELECT count(*) AS n FROM live WHERE k BETWEEN 20 AND 90")
def count_range(spark, sf_dir):
    return order.count_range(resolve.live_set(views.event_log(spark, sf_dir)), 20, 90)


@query(BASE + "SELECT k AS key FROM (SELECT k, row_number() OVER (ORDER BY k) AS n FROM live) WHERE n = 5")
def nth_key(spark, sf_dir):
    return order.nth_key(resolve.live_set(views.event_log(spark, sf_dir)), 5)


@query(BASE + "SELECT q.key, CASE WHEN EXISTS (SELECT 1 FROM live WHERE k = q.key) THEN (SELECT count(*) FROM live WHERE k <= q.key) ELSE 0 END AS rank FROM (VALUES (3), (74), (999)) q(key)")
def rank_of_keys(spark, sf_dir):
    return order.rank_of(resolve.live_set(views.event_log(spark, sf_dir)), _keys(spark, 3, 74, 999))


@query(
    BASE
    + """, n AS (SELECT k, row_number() OVER (ORDER BY k) AS pos, count(*) OVER () AS c FROM live)
SELECT CAST(p AS INT) AS pct, k AS key FROM n, (VALUES (0), (25), (50), (90), (100)) v(p) WHERE pos = greatest(1, CAST(ceil(p * c / 100.0) AS BIGINT))"""
)
def percentile_keys(spark, sf_dir):
    return order.percentile_keys(resolve.live_set(views.event_log(spark, sf_dir)), [0, 25, 50, 90, 100])


@query(BASE + "SELECT k AS key FROM (SELECT k, row_number() OVER (ORDER BY k) AS n, count(*) OVER () AS c FROM live) WHERE n = (c + 1) // 2")
def median_key(spark, sf_dir):
    return order.median_key(resolve.live_set(views.event_log(spark, sf_dir)))


@query(BASE + "SELECT min(k) AS first_key, max(k) AS last_key FROM live")
def first_last_key(spark, sf_dir):
    return order.first_last(resolve.live_set(views.event_log(spark, sf_dir)))


# --- attributes and intervals ---


def _attribute(column: str, kind: str, lo: str, hi: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {column}, o_orderkey) AS pos, o_orderkey AS key FROM orders WHERE {column} BETWEEN {kind}{lo} AND {kind}{hi}"


def _by(spark, sf_dir, name, lo, hi):
    declared = indexes.IndexSet()
    for c in ("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice"):
        declared.secondary(c, F.col(c))
    found = declared.by_attribute(views.orders(spark, sf_dir), name, lo, hi)
    return order.global_rank(found, "attribute", "pos", ["key"]).select("pos", "key")


@query(_attribute("o_custkey", "", "100", "120"))
def attr_range_custkey(spark, sf_dir):
    return _by(spark, sf_dir, "o_custkey", 100, 120)


@query(_attribute("o_orderpriority", "", "'1'", "'2-HIGH'"))
def attr_range_string(spark, sf_dir):
    return _by(spark, sf_dir, "o_orderpriority", "1", "2-HIGH")


@query(_attribute("o_orderdate", "TIMESTAMP ", "'1996-01-01'", "'1996-03-31'"))
def attr_range_ts(spark, sf_dir):
    return _by(spark, sf_dir, "o_orderdate", _moment("1996-01-01"), _moment("1996-03-31"))


@query(_attribute("o_totalprice", "", "1000.0", "50000.0"))
def attr_range_double(spark, sf_dir):
    return _by(spark, sf_dir, "o_totalprice", 1000.0, 50000.0)


def _spans(spark, sf_dir):
    return views.ship_spans(spark, sf_dir), indexes.IndexSet().interval("ship", F.col("start"), F.col("end"))


def _placed(found):
    return order.global_rank(found, "start", "pos", ["end", "key"]).select("pos", "key")


_INT_SPANS = "sp AS (SELECT o_orderkey AS k, o_custkey AS s, o_custkey + o_orderkey % 40 AS e FROM orders)"


def _int_spans(spark, sf_dir):
    return views.orders(spark, sf_dir), indexes.IndexSet().interval("around", F.col("o_custkey"), F.col("o_custkey") + F.col("key") % 40)


@query(f"WITH {_INT_SPANS} SELECT row_number() OVER (ORDER BY s, e, k) AS pos, k AS key FROM sp WHERE s <= 57 AND e >= 57")
def stab_integers(spark, sf_dir):
    rows, declared = _int_spans(spark, sf_dir)
    return _placed(declared.stab(rows, "around", 57))


@query(f"WITH {_INT_SPANS} SELECT row_number() OVER (ORDER BY s, e, k) AS pos, k AS key FROM sp WHERE s <= 75 AND e >= 60")
def overlap_integers(spark, sf_dir):
    rows, declared = _int_spans(spark, sf_dir)
    return _placed(declared.overlapping(rows, "around", 60, 75))


@query(f"WITH {SPANS} SELECT row_number() OVER (ORDER BY s, e, k) AS pos, k AS key FROM sp WHERE s <= TIMESTAMP '1998-01-01' AND e >= TIMESTAMP '1998-01-01'")
def stab_ship_span(spark, sf_dir):
    rows, declared = _spans(spark, sf_dir)
    return _placed(declared.stab(rows, "ship", _moment("1998-01-01")))


@query(f"WITH {SPANS} SELECT row_number() OVER (ORDER BY s, e, k) AS pos, k AS key FROM sp WHERE s <= TIMESTAMP '1995-03-01' AND e >= TIMESTAMP '1995-02-01'")
def overlap_ship_span(spark, sf_dir):
    rows, declared = _spans(spark, sf_dir)
    return _placed(declared.overlapping(rows, "ship", _moment("1995-02-01"), _moment("1995-03-01")))


_DAY = 86_400_000_000
_MONTHS = "m AS (SELECT unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-01', INTERVAL 1 MONTH)) AS p)"


def _months(spark):
    return spark.sql("SELECT explode(sequence(timestamp_ntz'1995-01-01', timestamp_ntz'1996-12-01', interval 1 month)) AS point")


@query(f"WITH {SPANS}, {_MONTHS} SELECT p AS point, k AS key FROM sp JOIN m ON s <= p AND e >= p")
def batch_stab_join(spark, sf_dir):
    return interval_join.stab_join(views.ship_spans(spark, sf_dir), _months(spark), 64 * _DAY).select("point", "key")


@query(f"WITH {SPANS}, {_MONTHS} SELECT p AS lo, count(*) AS n, sum(k)::BIGINT AS keys FROM sp JOIN m ON s <= p + INTERVAL 10 DAY AND e >= p GROUP BY 1")
def batch_overlap_join(spark, sf_dir):
    asked = _months(spark).select(F.col("point").alias("lo"), F.expr("point + interval 10 days").alias("hi"))
    met = interval_join.overlap_join(views.ship_spans(spark, sf_dir), asked, 64 * _DAY)
    return met.groupBy("lo").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("SELECT count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate")
def inverted_span_rejects(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = views.orders(spark, sf_dir).join(items, F.col("key") == F.col("l_orderkey"))
    declared = indexes.IndexSet().interval("wait", F.col("o_orderdate"), F.col("l_shipdate"))
    return declared.rejected(rows).agg(F.count("*").alias("n"))


# --- space ---


@query(
    BASE_DENSE
    + """SELECT log.seg AS segment_id, count(*) AS records, sum(log.bytes)::BIGINT AS bytes, sum(CASE WHEN live.seq IS NULL THEN log.bytes ELSE 0 END)::BIGINT AS garbage_bytes,
log.seg = (SELECT max(seg) FROM log) AS active FROM log LEFT JOIN live ON log.seq = live.seq GROUP BY log.seg"""
)
def segment_map(spark, sf_dir):
    return space.segment_stats(views.event_log(spark, sf_dir, dense=True))


@query(BASE_DENSE + "SELECT (SELECT sum(bytes) FROM log)::BIGINT AS total_bytes, ((SELECT sum(bytes) FROM log) - (SELECT sum(bytes) FROM live))::BIGINT AS garbage_bytes")
def garbage_total(spark, sf_dir):
    return space.garbage(views.event_log(spark, sf_dir, dense=True))


@query(BASE_DENSE + f"SELECT row_number() OVER (ORDER BY k) AS pos, k AS key, seq FROM live WHERE seg <= {CLOSED}")
def compaction_result(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    return order.global_rank(space.compacted(log, space.newest_closed(log)), "key", "pos").select("pos", "key", "seq")


@query(BASE_DENSE + f"SELECT (coalesce((SELECT sum(bytes) FROM log WHERE seg <= {CLOSED}), 0) - coalesce((SELECT sum(bytes) FROM live WHERE seg <= {CLOSED}), 0))::BIGINT AS reclaimed_bytes")
def compaction_reclaimed(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    return space.reclaimed(log, space.newest_closed(log))


@query(BASE_DENSE + f"SELECT coalesce((SELECT sum(bytes) FROM log WHERE seg <= {CLOSED}) - coalesce((SELECT sum(bytes) FROM live WHERE seg <= {CLOSED}), 0) > 0.5 * (SELECT sum(bytes) FROM log WHERE seg <= {CLOSED}), false) AS due")
def auto_compact_due(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    return space.compaction_due(log, space.newest_closed(log), 0.5)


_KEPT = "kept AS (SELECT * FROM live ORDER BY seq DESC LIMIT 50), "


@query(f"WITH {LOG}, {LIVE}, {_KEPT}t AS (SELECT sum(bytes)::BIGINT AS total_bytes FROM log) SELECT total_bytes, (total_bytes - (SELECT sum(bytes) FROM kept))::BIGINT AS garbage_bytes FROM t")
def retained_garbage(spark, sf_dir):
    """Rows that retention evicts are garbage too."""
    log = views.event_log(spark, sf_dir)
    return space.garbage(log, resolve.floor(resolve.live_set(log), 50))


@query(f"WITH {DENSE}, {LIVE}, kept AS (SELECT * FROM live ORDER BY seq DESC LIMIT 700) SELECT k AS key, seq FROM kept WHERE seg <= {CLOSED}")
def retained_compaction(spark, sf_dir):
    log = views.event_log(spark, sf_dir, dense=True)
    return space.compacted(log, space.newest_closed(log), resolve.floor(resolve.live_set(log), 700)).select("key", "seq")


@query(
    f"""WITH {DENSE}, {LIVE}, left_over AS (SELECT seq, k, del FROM log WHERE seg > {CLOSED} UNION ALL SELECT seq, k, false FROM live WHERE seg <= {CLOSED}),
p AS (SELECT * FROM left_over ORDER BY seq LIMIT 300), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM p)
SELECT k AS key, seq FROM n WHERE rn = 1 AND NOT del"""
)
def as_of_after_compaction(spark, sf_dir):
    """The first 300 records that compaction has left."""
    log = views.event_log(spark, sf_dir, dense=True)
    top = space.newest_closed(log)
    columns = ["seq", "key", "deleted"]
    left = space.compacted(log, top).withColumn("deleted", F.lit(False)).select(columns).union(log.where(F.col("segment_id") > top).select(columns))
    return resolve.as_of_record(left, 300, dense=False).select("key", "seq")
