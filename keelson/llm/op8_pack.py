"""Packing of token sequences: shortest-pack-first over the histogram of piece lengths.

Each document's ids, with an end id, are cut into pieces of `length` ids and a rest. Only the histogram of the piece
lengths, `length` counts at most, reaches the driver. There lengths are placed longest first, each into the pack that is
shortest so far among those with room, all copies of a pack at once; what results is a list of packing patterns with
counts, at most two new ones a length. A piece then finds its place by its rank among the pieces of its length.

The rank needs no sort: while pieces are written, each task numbers its pieces of each length, and the sums of earlier
tasks' counts are added by a join on (task, length).

Defined results: a null text counts as empty; an empty text is one piece that holds the end id alone. Repeated rows and
rows without a doc_id are each packed. A long text is cut into as many pieces as it takes. An empty table gives no row.
Columns of the input other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, table_path
from .tokens import ByteEncoder, encoder, text_slices

LENGTH = 1024
END = 0


class Packed(NamedTuple):
    #: doc_id, start, length, doc_tokens, ids (binary: little-endian unsigned 32-bit), task, nth
    pieces: DataFrame
    #: (lengths of the pattern's pieces, count of sequences), at most a few thousand
    patterns: list[tuple[tuple[int, ...], int]]


def patterns(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns with counts: lengths longest first, each into the shortest packs that have room."""
    packs: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(length + 1)]  # by room that is left
    top = 0  # no pack has more room than this
    for size in sorted((s for s, n in histogram.items() if n), reverse=True):
        n = histogram[size]
        room = top
        while n and room >= size:  # what has grown has less room and is met again on the way down
            while n and packs[room]:
                pattern, count = packs[room].pop()
                used = min(n, count)
                if count > used:
                    packs[room].append((pattern, count - used))
                packs[room - size].append(((*pattern, size), used))
                n -= used
            if n:
                room -= 1
        if n:
            each = length // size  # new packs hold this size alone
            whole, rest = divmod(n, each)
            if whole:
                packs[length - each * size].append(((size,) * each, whole))
            if rest:
                packs[length - rest * size].append(((size,) * rest, 1))
        top = max((r for r in range(length, -1, -1) if packs[r]), default=0)
    return [p for of in packs for p in of]


def cut(docs: DataFrame, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """The pieces of all documents, as a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, task, seen = encoder(ByteEncoder, path), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for whole in batches:
            for b in text_slices(whole):
                flat, at = made.ids(b.column("text"))
                n = len(b)
                ids = np.insert(flat, at[1:], end).astype("<u4")
                at = at + np.arange(n + 1)  # each document has its end id now
                tokens = np.diff(at)
                count = -(-tokens // length)
                row = np.repeat(np.arange(n), count)
                start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * length
                size = np.minimum(tokens[row] - start, length)
                order = np.argsort(size, kind="stable")
                ordered = size[order]
                first = np.searchsorted(ordered, ordered)
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - first + seen[ordered]
                seen += np.bincount(size, minlength=length + 1)
                bounds = np.concatenate([(at[:-1][row] + start) * 4, [at[-1] * 4]]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(size), pa.array(tokens[row]), binary, pa.array(np.full(len(size), task, np.int32)), pa.array(nth)],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "task", "nth"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, ids binary, task int, nth long")
    to = table_path(docs.sparkSession, "pieces")
    pieces.write.option("compression", "zstd").parquet(to)
    return docs.sparkSession.read.schema(pieces.schema).parquet(to)


def pack(docs: DataFrame, path: str, end: int = END, length: int = LENGTH) -> Packed:
    pieces = cut(docs, path, end, length)
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `length` rows at most
    return Packed(pieces, patterns(histogram, length))


def layout(pieces: DataFrame, found: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """The columns of pieces with sequence_id and offset. Drop ids, or reduce them to what is needed, before: rows are shuffled here."""
    slots: dict[int, list[tuple[int, int, int]]] = {}  # by length: (first rank, first sequence, offset) of each slot
    ranks: dict[int, int] = {}
    sequence = 0
    for pattern, count in found:
        at = 0
        for size in pattern:
            slots.setdefault(size, []).append((ranks.get(size, 0), sequence, at))
            ranks[size] = ranks.get(size, 0) + count
            at += size
        sequence += count
    table = {size: np.array(x, np.int64).T for size, x in slots.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, rank = size.to_numpy(), rank.to_numpy()
        out = np.zeros((len(sizes), 2), np.int64)
        for s in np.unique(sizes):
            rows = np.flatnonzero(sizes == s)
            first, base, at = table[int(s)]
            k = np.searchsorted(first, rank[rows], "right") - 1
            out[rows, 0], out[rows, 1] = base[k] + rank[rows] - first[k], at[k]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(earlier, ["task", "length"]).withColumn("at", place(F.col("length"), F.col("earlier") + F.col("nth")))
    return ranked.select(*[c for c in pieces.columns if c not in ("task", "nth")], "at.sequence_id", "at.offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_rows(documents(spark, sf_dir))


def pack_rows(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    packed = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    narrow = packed.pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return layout(narrow, packed.patterns).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
