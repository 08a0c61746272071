"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line. Each query runs once to warm up; the better of two timed runs counts."""

from __future__ import annotations

import json
import os
import time

from keelson.operators import lookup, order, resolve, space
from keelson.plans import stored, views  # noqa: F401 - stored adds its queries
from keelson.plans.catalogue import QUERIES
from keelson.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    last = views.event_log(spark, SF).agg({"segment_id": "max"}).first()[0]
    base = stored.stored_log(spark, SF)  # a tail is timed by itself, over a store that is there
    batch = {
        # the nearest batch shape of each published figure
        "cold_build": lambda: stored.built(spark, SF),
        "tail_from": lambda: stored.delivered(base, 250),
        "resolve_full_log": lambda: resolve.live_set(views.event_log(spark, SF, dense=True)),
        "ordered_scan": lambda: resolve.live_set(views.event_log(spark, SF, dense=True)).orderBy("key"),
        "range_129_keys": lambda: lookup.key_range(views.event_log(spark, SF, dense=True), 5000, 5128),
        "batch_lookup": lambda: QUERIES["batch_lookup"](spark, SF),
        "compaction": lambda: space.compacted(views.event_log(spark, SF, dense=True), last - 1).orderBy("key"),
        "count_range": lambda: order.count_range(resolve.live_set(views.event_log(spark, SF, dense=True)), 2000, 9000),
    }
    named = ["live_set", "as_of_4000", "percentile_keys", "attr_range_custkey", "stab_ship_span", "overlap_ship_span", "batch_stab_join", "batch_overlap_join", "segment_map", "stored_live_set", "stored_compaction"]
    runs = batch | {n: (lambda n=n: QUERIES[n](spark, SF)) for n in named}
    took = {}
    for name, make in runs.items():
        each = []
        for _ in range(3):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(min(each[1:]), 4)
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
