"""What the operators of this subpackage share: the shared folder, tables that cut lineage, and word hashing on Arrow buffers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts give it: space and 0x09 to 0x0D. All other bytes belong to words.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SLICE_BYTES = 2_000_000
#: Bytes of text that are hashed at once.
STRETCH = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own in local mode, and an error on a cluster."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="keelson-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/keelson-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation.

    The table goes when the application ends, or before by discard().
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.__dict__["written"] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.__dict__["written"])
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """name, or the first longer one that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Keys that attach() broadcasts at most.
HOTTEST = 10_000


def attach(rows: DataFrame, counted: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with counted (a table with one row a key, and n, its number of rows), inner or left.

    The HOTTEST keys of largest n are broadcast. Where there are more, rows of the others meet in a sort-merge join: none
    of these keys then holds more than 1 / HOTTEST of the rows, so no task gets a hot key at any size.
    """
    top = counted.select("n").orderBy(F.desc("n")).limit(HOTTEST + 1).agg(F.count("*").alias("keys"), F.min("n").alias("least")).first()
    if top["keys"] <= HOTTEST:
        return rows.join(F.broadcast(counted), key, how)
    hot = F.broadcast(counted.where(F.col("n") > top["least"]))  # fewer than HOTTEST
    rest = counted.where(F.col("n") <= top["least"]).hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(rest, key, how))


# --- words of Arrow string columns, without a Python object per word ---


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values, alike on every machine."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_BYTE = stream(1, 256)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WHITE)] = False
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept and grown as needed."""
    found = _powers.get(int(base))
    if found is None or len(found) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        found = _powers[int(base)] = np.cumprod(steps)
    return found[:n]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of at most `most` bytes of text; a longer text comes alone."""
    text = batch.column(column)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    i, n = 0, len(text)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = j


class Words:
    """Words of a string array: hash (uint64), start and end byte of each, and first[i]:first[i + 1] for row i.

    A null text has no words. A word's hash is the polynomial of its bytes' random values, modulo 2 ** 64, taken as a
    difference of running sums and then mixed, so that equal words have equal hashes wherever they stand.
    """

    def __init__(self, text: pa.Array, lower: bool = False):
        if text.null_count:
            text = text.fill_null("")
        n = len(text)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        low, high = int(ends[0]), int(ends[-1])
        self.data = np.frombuffer(text.buffers()[2], np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        size, bounds = high - low, ends - low
        inside = _IS_WORD[self.data]
        before = np.empty(size, bool)
        if size:
            before[0], before[1:] = False, inside[:-1]
            before[bounds[:-1][bounds[:-1] < size]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(size, bool)
        if size:
            after[-1], after[:-1] = False, inside[1:]
            after[bounds[1:][bounds[1:] > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        values = _LOWER if lower else _BYTE
        self.hash = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):  # a very long text goes in stretches, which bounds memory and changes no hash
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + STRETCH)))
            low, high = self.start[i], self.end[j - 1]
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(values[self.data[low:high]] * powers(_BASE, high - low), out=sums[1:])
            start, end = self.start[i:j] - low, self.end[i:j] - low
            self.hash[i:j] = mix((sums[end] - sums[start]) * powers(_INVERSE, high - low + 1)[start] + (end - start).astype(np.uint64))
            i = j
        self.first = np.searchsorted(self.start, bounds)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbours in h; callers leave out runs that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(stream(2, k) | np.uint64(1)):
        out += h[j : j + n] * m
    return mix(out)


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def letters(text) -> F.Column:
    """Whether a text holds any letter."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def single_thread() -> None:
    """Libraries that start threads of their own stay on one core in a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


# --- groups and components ---


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches, cut anew so that no group of equal keys is divided; only the last group is held back."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if not len(held):
            continue
        same = np.ones(len(held), bool)
        for k in keys:
            x = held.column(k).to_numpy()
            same &= x == x[-1]
        other = np.flatnonzero(~same)
        if len(other):
            cut = int(other[-1]) + 1
            yield held.slice(0, cut).combine_chunks()
            held = held.slice(cut)
    if held is not None and len(held):
        yield held.combine_chunks()


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """First row of each run of equal values, and the number of rows."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return np.append(np.flatnonzero(new), n)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n nodes by edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id, component (the smallest id reachable) of every node of the edges; nodes that are their own component are left out.

    Large-star and small-star steps in turn: each replaces a node's edges by edges to the smallest neighbour, until only
    stars are left. Every step is written to the shared folder; no step holds a node's neighbours in memory.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before = mark
        old, both = now, now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(old)
