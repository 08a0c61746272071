"""Token-id files: a shared zstandard dictionary, one frame a document, and an offset index in every block.

The files are Parquet tables in the shared folder, since executors may reach it only through Spark. A row of `blocks` is
a block of about BLOCK_BYTES: documents in ascending doc_id order (lists doc_ids, tokens, and offsets into the payload)
and the payload of their frames, one after another. A frame is the zstandard compression, with the shared dictionary, of
the ids as little-endian unsigned integers of `width` bytes. `dictionary` holds the dictionary and its SHA-256, which
each block repeats, so a block is never read with another dictionary. To read one short document take the block whose
first_doc and last_doc enclose it, cut its frame out by the offsets and decompress that alone: read_document() does so.

Documents are dealt by ranges of doc_id (quantiles of doc_id alone), sorted within each range, and blocks never cross a
range; a document's start is the sum of the tokens of all earlier ranges and of earlier documents in its own. Files follow
each other in doc_id order too: a range is never in two files, and later ranges are in files of later names.

Defined results: a null text counts as empty; such documents hold the end id alone. Rows without a doc_id come first.
Rows with the same doc_id follow each other in an order fixed by their hash. A long text is one frame. An empty table
gives empty files and no row. Where zstandard finds too little to train on (a few short documents), there is no dictionary:
its bytes are empty, its hash is theirs, and frames are compressed without one. Columns of the input other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, partitions, table_path
from .tokens import WordEncoder, encoder, text_slices

END = 2
LEVEL = 3
BLOCK_BYTES = 4_000_000
#: The dictionary is trained on this many documents at most (those of lowest hash), each cut to SAMPLE_CHARS, into DICTIONARY_BYTES.
SAMPLE_DOCS = 2_000
SAMPLE_CHARS = 4_000
DICTIONARY_BYTES = 65_536
_BLOCK = "bucket int, first_doc long, last_doc long, first_start long, dictionary_hash string, width int, doc_ids array<long>, tokens array<long>, offsets array<long>, payload binary"


class TokenFiles(NamedTuple):
    blocks: str
    dictionary: str


def train(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """The shared dictionary, or b"" where there is too little to train on."""
    # A hash filter first leaves about twice as many as needed, so that tasks don't each send a whole sample.
    every = max(1, docs.count() // (2 * SAMPLE_DOCS))
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    few = some.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).orderBy(F.xxhash64("text"), "text").limit(SAMPLE_DOCS)
    texts = [r["text"] for r in few.collect()]
    flat, at = encoder(WordEncoder, path).ids(pa.array(texts, pa.string()))
    samples = [np.append(flat[a:b], end).astype(f"<u{width}").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(raw: bytes, compress: bool = False) -> zstandard.ZstdCompressionDict | None:
    if not raw:
        return None
    found = zstandard.ZstdCompressionDict(raw)
    if compress:
        found.precompute_compress(level=LEVEL)  # else every frame digests the dictionary anew
    return found


def write(docs: DataFrame, path: str, end: int = END) -> TokenFiles:
    """Encode every text and write the files; docs: doc_id (integer) and text."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    width = 2 if max(end + 1, Tokenizer.from_file(path).get_vocab_size()) <= 1 << 16 else 4
    raw = train(docs, path, end, width)
    name = hashlib.sha256(raw).hexdigest()
    to = TokenFiles(table_path(spark, "token-blocks"), table_path(spark, "token-dictionary"))
    spark.createDataFrame([(name, raw)], "hash string, dictionary binary").write.parquet(to.dictionary)
    ranges = 4 * partitions(spark)
    # One sketch of the ids, whose size grows with the ranges alone.
    shares = [i / ranges for i in range(1, ranges)]
    bounds = np.array(sorted(set(docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), shares, 20 * ranges)).first()[0] or [])), np.int64)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, compress = encoder(WordEncoder, path), zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw, compress=True)).compress
        for whole in batches:
            for b in text_slices(whole):
                flat, at = made.ids(b.column("text"))
                ids = np.insert(flat, at[1:], end).astype(f"<u{width}").tobytes()
                at = at + np.arange(len(b) + 1)
                view = memoryview(ids)
                found = [compress(view[x * width : y * width]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                docs_of = b.column("doc_id").cast(pa.int64())
                known = docs_of.fill_null(0).to_numpy(zero_copy_only=False)
                bucket = np.where(docs_of.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, known, "right"))
                yield pa.RecordBatch.from_arrays(
                    [docs_of, pa.array(np.diff(at)), pa.array(found, pa.binary()), pa.array(bucket.astype(np.int32))], names=["doc_id", "tokens", "frame", "bucket"]
                )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, bytes]] = []
        state = {"bucket": None, "start": 0, "bytes": 0}

        def close() -> pa.RecordBatch:
            doc_ids, tokens, each = map(list, zip(*held, strict=True))
            offsets = [0, *np.cumsum([len(x) for x in each]).tolist()]
            row = (state["bucket"], doc_ids[0], doc_ids[-1], state["start"], name, width, doc_ids, tokens, offsets, b"".join(each))
            state["start"] += sum(tokens)
            state["bytes"] = 0
            held.clear()
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[f.split()[0] for f in _BLOCK.split(", ")])

        for b in batches:
            for bucket, doc, tokens, frame in zip(*[b.column(c).to_pylist() for c in ("bucket", "doc_id", "tokens", "frame")], strict=True):
                if held and (bucket != state["bucket"] or state["bytes"] >= BLOCK_BYTES):
                    yield close()
                if bucket != state["bucket"]:
                    state |= {"bucket": bucket, "start": 0}
                held.append((doc, tokens, frame))
                state["bytes"] += len(frame)
        if held:
            yield close()

    framed = docs.select("doc_id", "text").mapInArrow(frames, "doc_id long, tokens long, frame binary, bucket int")
    tasks = partitions(spark)
    dealt = framed.repartitionById(tasks, F.floor(F.col("bucket") * tasks / (len(bounds) + 1)).cast("int")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"))
    dealt.mapInArrow(blocks, _BLOCK).write.option("compression", "uncompressed").parquet(to.blocks)
    return to


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary: little-endian unsigned 32-bit) of every document, from the files."""
    table = spark.read.schema(_BLOCK).parquet(files.blocks)
    held = {r["hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(files.dictionary).collect()}  # one row
    totals = {r["bucket"]: r["n"] for r in table.select("bucket", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    earlier, total = {}, 0  # one number a range
    for bucket in sorted(totals):
        earlier[bucket], total = total, total + totals[bucket]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {}
        for b in batches:
            for i in range(len(b)):
                row = {c: b.column(c)[i] for c in b.schema.names}
                name, width = row["dictionary_hash"].as_py(), row["width"].as_py()
                if name not in readers:
                    readers[name] = zstandard.ZstdDecompressor(dict_data=_dictionary(held[name])).decompress
                offsets, tokens = row["offsets"].as_py(), np.array(row["tokens"].as_py(), np.int64)
                payload = memoryview(row["payload"].as_buffer())
                starts = earlier[row["bucket"].as_py()] + row["first_start"].as_py() + np.concatenate([[0], np.cumsum(tokens)[:-1]])
                ids = [np.frombuffer(readers[name](payload[x:y]), f"<u{width}").astype("<u4").tobytes() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                if not np.array_equal(sizes, tokens):
                    raise ValueError("a block's index and its frames differ")
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return table.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def read_document(spark: SparkSession, files: TokenFiles, doc_id: int) -> list[list[int]]:
    """The ids of the rows with this doc_id, decompressing no other document."""
    rows = spark.read.schema(_BLOCK).parquet(files.blocks).where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    held = {r["hash"]: bytes(r["dictionary"]) for r in spark.read.parquet(files.dictionary).collect()}
    at = F.explode(F.filter(F.sequence(F.lit(0), F.size("doc_ids") - 1), lambda i: F.get("doc_ids", i) == doc_id))
    cut = rows.select("dictionary_hash", "width", "payload", "offsets", at.alias("i")).select("dictionary_hash", "width", F.expr("substring(payload, int(offsets[i]) + 1, int(offsets[i + 1] - offsets[i]))").alias("frame"))
    return [np.frombuffer(zstandard.ZstdDecompressor(dict_data=_dictionary(held[r["dictionary_hash"]])).decompress(bytes(r["frame"])), f"<u{r['width']}").tolist() for r in cut.collect()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
