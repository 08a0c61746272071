"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors are one class, compared once and counted with their number. Each class vector is turned by three rounds of
random signs and a Hadamard transform; a hash is the signed axis it then lies closest to. A table's key joins `hashes`
of them; besides its own bucket a vector enters those buckets where one hash is replaced by its second closest axis, so
two vectors meet if either probe reaches the other. Within buckets all pairs are compared by cosine in double precision,
and those at the threshold are links. A pair counts only in the smallest bucket key that both share, so each link counts
once. Buckets over BLOCK rows are cut into blocks, and each pair of blocks is a group of its own, so that no task gets
an unbounded bucket; links leave a task as a count a vector and a spanning forest, never as all pairs.

Vectors of each length are hashed and compared among themselves, with hashes and tables of their own number: from
`hashes_for` on hashes grow with the logarithm of the number of rows, and tables with them.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths aren't linked. Rows that repeat a vec_id are vectors of their own. An empty table gives no row. Only
vec_id and the vector are read; other columns aren't returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, discard, group_bounds, local_roots, materialize, mix, stream, whole_groups
from .vectors import by_length, dimensions, unit, usable

THRESHOLD = 0.9
TABLES = 8
#: Tables grow by this factor with each further hash.
GROWTH = 2.0
BLOCK = 1024
#: Rows a bucket is meant to hold on average at most.
PER_BUCKET = 16


def hashes_for(rows: int, d: int) -> int:
    return max(2, math.ceil(math.log(max(rows / PER_BUCKET, 2)) / math.log(2 * d)))


def tables_for(hashes: int) -> int:
    return math.ceil(TABLES * GROWTH ** (hashes - 2))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, times 1 / sqrt(width); the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def signs(seed: int, d: int) -> np.ndarray:
    return np.where(stream(100 + seed, d) >> np.uint64(63), 1.0, -1.0)


def keys(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """tables * (1 + hashes) bucket keys of each row: own bucket first, then the probes. Rows of different lengths share none."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    rows, out = np.arange(len(x)), []
    for t in range(tables):
        first, second = [], []
        for k in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs((t * hashes + k) * 3 + r, width))
            size = np.abs(y)
            a = size.argmax(axis=1)
            first.append(2 * a + (y[rows, a] > 0))
            size[rows, a] = -1
            b = size.argmax(axis=1)
            second.append(2 * b + (y[rows, b] > 0))
        for changed in (None, *range(hashes)):
            key = np.full(len(x), t << 32 | x.shape[1], np.uint64)
            for k in range(hashes):
                key = mix(key + (second if k == changed else first)[k].astype(np.uint64) + np.uint64(1))
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def links_within(x: np.ndarray, bounds: np.ndarray, side: np.ndarray, cross: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs at the threshold within each group; groups that are marked cross compare only rows of different sides."""
    left, right = [], []

    def verify(i: np.ndarray, j: np.ndarray, c: bool) -> None:
        if c:
            other = side[i] != side[j]
            i, j = i[other], j[other]
        for s in range(0, len(i), 200_000):
            a, b = i[s : s + 200_000], j[s : s + 200_000]
            ok = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
            left.append(a[ok])
            right.append(b[ok])

    sizes = np.diff(bounds)
    for large in np.flatnonzero(sizes > 128):
        lo, hi = bounds[large], bounds[large + 1]
        for s in range(lo, hi, 512):
            i, j = np.nonzero(x[s : min(s + 512, hi)] @ x[lo:hi].T >= threshold - 1e-9)
            i, j = i + s, j + lo
            verify(i[i < j], j[i < j], bool(cross[large]))
    for c in (False, True):
        small = np.flatnonzero((sizes > 1) & (sizes <= 128) & (cross == c))
        for s in range(0, len(small), 2000):
            lo, n = bounds[small[s : s + 2000]], sizes[small[s : s + 2000]]
            i = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # every row of these groups
            rest = np.repeat(lo + n, n) - i - 1  # rows after it in its group
            j = np.repeat(i, rest) + 1 + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
            verify(np.repeat(i, rest), j, c)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def link(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, hashes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, counts): members has vec_id, rep and size of each usable row's class; counts has id (a class), n (linked rows of other classes) and root (an edge of the links)."""
    use = {d: (n, hashes or hashes_for(n, d)) for d, n in dimensions(vectors, "embedding").items()}
    valid = vectors.where(usable(F.col("embedding"))).select("vec_id", "embedding")
    classes = materialize(valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "vectors")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column("embedding")):
                h = use[x.shape[1]][1]
                found = keys(unit(x), tables or tables_for(h), h)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, lists], names=[*b.schema.names, "keys"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    each = materialize(classes.mapInArrow(hashed, f"embedding {kind}, rep long, size long, keys array<long>"), "vector-keys")
    # Buckets are counted and cut without the vectors, which join last and travel to buckets once.
    entries = each.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    blocks = entries.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "rep", "side", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"))
    dealt = dealt.join(each, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, ["key", "i", "j"]):
            for at, x in by_length(chunk.column("embedding")):  # a group's vectors are of one length
                t = chunk if len(at) == len(chunk) else chunk.take(pa.array(at))
                key, i, j, side, rep, size = (t.column(c).to_numpy() for c in ("key", "i", "j", "side", "rep", "size"))
                bounds = group_bounds(key, i, j)
                a, b = links_within(unit(x), bounds, side, (i != j)[bounds[:-1]], threshold)
                all_keys = t.column("keys").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
                keep = np.zeros(len(a), bool)
                for s in range(0, len(a), 20_000):
                    p, q = all_keys[a[s : s + 20_000]], all_keys[b[s : s + 20_000]]
                    shared = (p[:, :, None] == q[:, None, :]).any(axis=2)
                    keep[s : s + 20_000] = np.where(shared, p, np.iinfo(np.int64).max).min(axis=1) == key[a[s : s + 20_000]]
                a, b = a[keep], b[keep]
                n = np.zeros(len(t), np.int64)
                np.add.at(n, a, size[b])
                np.add.at(n, b, size[a])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(n[some]), pa.array(rep[local_roots(len(t), a, b)][some])], names=["id", "n", "root"])

    found = materialize(dealt.mapInArrow(compare, "id long, n long, root long"), "vector-links")
    discard(each)
    return valid.join(classes, "embedding").select("vec_id", "rep", "size"), found


def dedup(vectors: DataFrame, threshold: float = THRESHOLD, **how: int) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    members, found = link(vectors, threshold, **how)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = components(found, "id", "root").withColumnRenamed("id", "cid")
    of_class = members.join(links, members["rep"] == links["id"], "left").join(parts, F.col("rep") == F.col("cid"), "left")
    linked = of_class.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = vectors.where(~usable(F.col("embedding"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = parts.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM parts
"""
