"""Generated mutation logs for trials: four regimes of key choice, made on the executors and alike in every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of deletes, and how a key is drawn from a span by a uniform number u.
REGIMES = {
    "uniform": (0.10, lambda u, seq, span: F.floor(u * span)),
    "sequential": (0.00, lambda u, seq, span: seq % span),
    "skewed": (0.10, lambda u, seq, span: F.floor(u * u * span)),
    "churn": (0.45, lambda u, seq, span: F.floor(u * (span / 8))),
}


def workload(spark: SparkSession, n: int, span: int, regime: str = "uniform", seed: int = 1) -> DataFrame:
    """n mutations (ordinal, key, value, deleted) over about `span` keys."""
    if regime not in REGIMES:
        raise ValueError(f"no regime {regime!r}; there are {sorted(REGIMES)}")
    deletes, key = REGIMES[regime]
    u = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    rows = spark.range(n).withColumn("deleted", u(1) < deletes).withColumn("key", key(u(2), F.col("id"), span).cast("long"))
    value = F.when(~F.col("deleted"), F.concat(F.lit("v"), F.col("id"), F.lit(":"), F.repeat(F.lit("x"), 96)))
    return rows.select(F.col("id").alias("ordinal"), "key", value.alias("value"), "deleted")
