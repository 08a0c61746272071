"""Secondary attributes and intervals: declared as column expressions over the live set, never kept apart from it."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_attribute(live: DataFrame, attribute: Column, lo: Any, hi: Any) -> DataFrame:
    """key, attribute of rows with lo <= attribute <= hi, in the order (attribute, key); none if lo > hi."""
    if lo is None or hi is None:
        raise ValueError("bounds may not be null")
    return live.where(attribute.between(F.lit(lo), F.lit(hi))).select("key", attribute.alias("attribute")).orderBy("attribute", "key")


def stab(live: DataFrame, start: Column, end: Column, point: Any) -> DataFrame:
    """key, start, end of rows whose closed span holds the point, in the order (start, end, key)."""
    if point is None:
        raise ValueError("a point may not be null")
    return overlapping(live, start, end, point, point)


def overlapping(live: DataFrame, start: Column, end: Column, lo: Any, hi: Any) -> DataFrame:
    """key, start, end of rows whose closed span meets [lo, hi], in the order (start, end, key); an error if lo > hi."""
    if lo is None or hi is None:
        raise ValueError("bounds may not be null")
    if lo > hi:
        raise ValueError(f"inverted range: {lo} > {hi}")
    met = live.where((start <= F.lit(hi)) & (end >= F.lit(lo)))
    return met.select("key", start.alias("start"), end.alias("end")).orderBy("start", "end", "key")


def inverted(rows: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows that no interval index accepts: a null endpoint, or start after end."""
    return rows.where(start.isNull() | end.isNull() | (start > end))


@dataclass
class IndexSet:
    """Declared indexes by name. A name is declared once, whatever the kind."""

    attributes: dict[str, Column] = field(default_factory=dict)
    intervals: dict[str, tuple[Column, Column]] = field(default_factory=dict)

    def _new(self, name: str) -> None:
        if name in self.attributes or name in self.intervals:
            raise ValueError(f"index {name!r} is declared already")

    def secondary(self, name: str, attribute: Column) -> IndexSet:
        self._new(name)
        self.attributes[name] = attribute
        return self

    def interval(self, name: str, start: Column, end: Column) -> IndexSet:
        self._new(name)
        self.intervals[name] = (start, end)
        return self

    def _find(self, name: str, where: dict, kind: str) -> Any:
        if name not in where:
            raise KeyError(f"no {kind} index {name!r}; secondary: {sorted(self.attributes)}, interval: {sorted(self.intervals)}")
        return where[name]

    def by_attribute(self, live: DataFrame, name: str, lo: Any, hi: Any) -> DataFrame:
        return by_attribute(live, self._find(name, self.attributes, "secondary"), lo, hi)

    def stab(self, live: DataFrame, name: str, point: Any) -> DataFrame:
        return stab(live, *self._find(name, self.intervals, "interval"), point)

    def overlapping(self, live: DataFrame, name: str, lo: Any, hi: Any) -> DataFrame:
        return overlapping(live, *self._find(name, self.intervals, "interval"), lo, hi)

    def is_rejected(self) -> Column:
        """Whether an index refuses a put."""
        bad = F.lit(False)
        for a in self.attributes.values():
            bad = bad | a.isNull()
        for s, e in self.intervals.values():
            bad = bad | s.isNull() | e.isNull() | (s > e)
        return bad

    def rejected(self, puts: DataFrame) -> DataFrame:
        """Rows of a batch of puts that an index refuses; a batch with any is refused as a whole."""
        return puts.where(self.is_rejected())
