"""Batch stab and overlap: many spans against many points or spans, as an equi-join on bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A row covers this many bins of its own level at most.
MOST_BINS = 8


def as_long(c: Column, kind: T.DataType) -> Column:
    """A monotone 64-bit number of an integer, date or timestamp."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"endpoints must be integers, dates or timestamps, not {kind.simpleString()}")
    return c.cast("long")


def _on_levels(rows: DataFrame, first: str, last: str, own: str, widths: list[int]) -> DataFrame:
    """rows with their level (own), and a copy for each bin of each level from it on (__level, __bin)."""
    level = F.lit(len(widths) - 1)
    for i in reversed(range(len(widths) - 1)):
        level = F.when(F.expr(_bin(last, widths[i])) - F.expr(_bin(first, widths[i])) < MOST_BINS, F.lit(i)).otherwise(level)
    rows = rows.withColumn(own, level).withColumn("__level", F.explode(F.sequence(F.col(own), F.lit(len(widths) - 1))))
    rows = rows.withColumn("__w", F.element_at(F.array(*[F.lit(w).cast("long") for w in widths]), F.col("__level") + 1))
    return rows.withColumn("__bin", F.explode(F.sequence(F.expr(_bin(first, "__w")), F.expr(_bin(last, "__w")))))


def _bin(x: str, w: str | int) -> str:
    """x divided by w, rounded down, in 64-bit integers."""
    return f"({x} - pmod({x}, {w})) div {w}"


def overlap_join(spans: DataFrame, asked: DataFrame, bin_width: int) -> DataFrame:
    """All pairs of a span (start, end, ...) and an asked range (lo, hi, ...) that meet, with the columns of both.

    Bins of level l are MOST_BINS ** l times as wide as those of level 0. A row's own level is the first where it covers
    MOST_BINS bins at most; it is copied into its bins there and on all coarser levels, up to the coarsest that any row
    needs. A pair meets on the coarser of its two levels, and counts only in the bin of the later of its two starts.
    Rows with start > end, lo > hi or a null endpoint meet nothing. Columns must not clash. A bin that many rows share
    is one key of a plain equi-join, which adaptive execution splits where it is skewed.
    """
    if bin_width < 1:
        raise ValueError("bin_width must be 1 or more")
    kinds = {f.name: f.dataType for f in [*spans.schema.fields, *asked.schema.fields]}
    span = spans.withColumns({"__s": as_long(F.col("start"), kinds["start"]), "__e": as_long(F.col("end"), kinds["end"])}).where("__s <= __e")
    ask = asked.withColumns({"__lo": as_long(F.col("lo"), kinds["lo"]), "__hi": as_long(F.col("hi"), kinds["hi"])}).where("__lo <= __hi")
    lengths = span.select(F.expr("__e - __s").alias("n")).union(ask.select(F.expr("__hi - __lo")))
    longest = lengths.agg(F.max("n")).first()[0] or 0
    widths = [bin_width]
    while widths[-1] * (MOST_BINS - 1) < longest and widths[-1] < 1 << 58:
        widths.append(widths[-1] * MOST_BINS)
    left, right = _on_levels(span, "__s", "__e", "__own_s", widths), _on_levels(ask, "__lo", "__hi", "__own_a", widths).drop("__w")
    met = left.join(right, ["__level", "__bin"]).where("__s <= __hi AND __e >= __lo AND (__level = __own_s OR __level = __own_a)")
    once = met.where(F.expr("__bin = " + _bin("greatest(__s, __lo)", "__w")))
    return once.select(*spans.columns, *asked.columns)


def stab_join(spans: DataFrame, points: DataFrame, bin_width: int) -> DataFrame:
    """All pairs of a span and a point (column point, ...) within it."""
    asked = points.withColumn("lo", F.col("point")).withColumn("hi", F.col("point"))
    return overlap_join(spans, asked, bin_width).drop("lo", "hi")
