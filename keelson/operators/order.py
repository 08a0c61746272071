"""Order statistics over the keys of a live set. Ranks start at 1; ranges are closed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Up to this rank a top-k scan beats counting ranges.
TOP = 10_000
#: Rows that are numbered in one task; more are dealt into ranges of about so many, MOST_RANGES at most.
ROWS_A_RANGE = 250_000
MOST_RANGES = 16_384
#: Sampled rows a range, from which its bound is found. Sample and bounds shape the work, not the result.
SAMPLE = 24
_FAN = 32


def _order(df: DataFrame, column: str, ties: list[str] | None) -> list[str]:
    """The columns to order by: column, ties, and a hash of the row, so that rows with equal values can be dealt apart too."""
    return [column, *(ties or []), "__row_hash"]


def _hashed(df: DataFrame) -> DataFrame:
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]
    return df.withColumn("__row_hash", F.xxhash64(*columns))


def _ranges(df: DataFrame, by: list[str], n: int) -> tuple[Column, int]:
    """(range number of a row, number of ranges): it grows with the columns `by`. Bounds come from a fair sample of the n rows."""
    wanted = min(MOST_RANGES, -(-n // ROWS_A_RANGE))
    if wanted < 2:
        return F.lit(0), 1
    drawn = df.select(*by).sample(min(1.0, SAMPLE * wanted / n), 17).orderBy(*by).collect()
    bounds = [drawn[i * len(drawn) // wanted] for i in range(1, wanted)] if drawn else []
    if not bounds:
        return F.lit(0), 1
    kinds = {f.name: f.dataType for f in df.schema.fields}
    value = F.struct(*[F.col(c) for c in by])
    literal = lambda row: F.struct(*[F.lit(row[c]).cast(kinds[c]).alias(c) for c in by])
    # Found in steps of _FAN, as in a tree: how many bounds are at most the value.
    levels = [[literal(b) for b in bounds]]
    while len(levels[-1]) > _FAN:
        levels.append(levels[-1][::_FAN])
    found = F.size(F.filter(F.array(*levels[-1]), lambda b: b <= value))
    for level in reversed(levels[:-1]):
        low = F.greatest(found - 1, F.lit(0)) * _FAN
        found = F.when(found == 0, F.lit(0)).otherwise(low + F.size(F.filter(F.slice(F.array(*level), low + 1, _FAN), lambda b: b <= value)))
    return found, len(bounds) + 1


def global_rank(df: DataFrame, column: str, name: str = "rank", ties: list[str] | None = None) -> DataFrame:
    """df with the 1-based rank of each row in ascending order, without a task that sees more than a range of rows.

    Rows are counted; more than ROWS_A_RANGE are dealt into ranges by bounds over (column, ties, row), so that many rows
    of one value are dealt apart too. Each range is numbered by itself, and the counts of the ranges before it are added.
    """
    rows = _hashed(df)
    by = _order(df, column, ties)
    number, several = _ranges(rows, by, df.count())
    dealt = rows.withColumn("__range", number)
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*by))
    if several == 1:
        return dealt.withColumn(name, within.cast("long")).drop("__range", "__row_hash")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    start = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = dealt.withColumn("__row", within).join(F.broadcast(start), "__range")
    return ranked.withColumn(name, (F.col("__start") + F.col("__row")).cast("long")).drop("__range", "__row", "__start", "__row_hash")


def at_ranks(df: DataFrame, column: str, ranks: list[int], n: int) -> DataFrame:
    """rank, key: the values of column that stand at these ranks among its n rows. Only the ranges that hold a rank are sorted."""
    spark = df.sparkSession
    kind = df.schema[column].dataType.simpleString()
    ranks = sorted({r for r in ranks if 1 <= r <= n})
    if not ranks:
        return spark.createDataFrame([], f"rank long, key {kind}")
    keys = df.select(F.col(column).alias("key"))
    if ranks[-1] <= TOP:
        few = keys.orderBy("key").limit(ranks[-1])
        numbered = few.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("key")))
        return numbered.where(F.col("rank").isin(ranks)).select(F.col("rank").cast("long").alias("rank"), "key")
    number, several = _ranges(keys, ["key"], n)
    dealt = keys.select("key", number.alias("__range"))
    if several == 1:
        asked = [(r, 0, r) for r in ranks]
    else:
        asked, before = [], 0
        for r in dealt.groupBy("__range").count().orderBy("__range").collect():  # one row a range
            asked += [(x, r["__range"], x - before) for x in ranks if before < x <= before + r["count"]]
            before += r["count"]
        dealt = dealt.where(F.col("__range").isin(sorted({x[1] for x in asked})))
    numbered = dealt.withColumn("__row", F.row_number().over(Window.partitionBy("__range").orderBy("key")))
    wanted = spark.createDataFrame(asked, "rank long, __range int, __row int")
    return numbered.join(F.broadcast(wanted), ["__range", "__row"]).select("rank", "key")


def count_range(live: DataFrame, lo: Any, hi: Any) -> DataFrame:
    """n: live keys in [lo, hi]; 0 if lo > hi."""
    return live.where(F.col("key").between(F.lit(lo), F.lit(hi))).agg(F.count("*").alias("n"))


def nth_key(live: DataFrame, rank: int) -> DataFrame:
    """key: the rank-th smallest; an IndexError if there is none."""
    if rank < 1:
        raise IndexError(f"rank {rank} is below 1")
    found = at_ranks(live, "key", [rank], rank if rank <= TOP else live.count()).select("key")
    if found.isEmpty():
        raise IndexError(f"rank {rank} is above the number of keys")
    return found


def rank_of(live: DataFrame, keys: DataFrame) -> DataFrame:
    """key, rank for every asked key: its 1-based rank, 0 if it isn't live.

    Asked keys and live keys are numbered together by one distributed rank, so this holds for any number of either.
    """
    asked = keys.select("key").distinct().withColumn("__asked", F.lit(1))
    both = live.select("key").join(asked, "key", "left").withColumn("__asked", F.coalesce("__asked", F.lit(0)))
    found = global_rank(both, "key").where("__asked = 1").select("key", "rank")
    return keys.select("key").join(found, "key", "left").select("key", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def percentile_ranks(n: int, percents: list[int]) -> dict[int, int]:
    """The rank of each percentile of n keys: nearest rank, so 50 is the lower median, 100 the last and 0 the first."""
    for p in percents:
        if not 0 <= p <= 100:
            raise ValueError(f"percentile {p} is not in 0..100")
    return {p: max(1, -(-p * n // 100)) for p in percents} if n else {}


def percentile_keys(live: DataFrame, percents: list[int]) -> DataFrame:
    """pct, key for each percentile; no row if the store is empty."""
    n = live.count()
    ranks = percentile_ranks(n, percents)
    asked = live.sparkSession.createDataFrame(list(ranks.items()), "pct int, rank long")
    return at_ranks(live, "key", list(ranks.values()), n).join(F.broadcast(asked), "rank").select("pct", "key")


def median_key(live: DataFrame) -> DataFrame:
    """key: the lower median; no row if the store is empty."""
    return percentile_keys(live, [50]).select("key")


def first_last(live: DataFrame) -> DataFrame:
    """first_key, last_key; null if the store is empty."""
    return live.agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"))
