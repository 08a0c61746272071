"""Sharding by vector bin packing: bytes, tokens (words) and rows of the shards are balanced jointly.

Rows with equal texts form a group. The largest groups first, each goes to the shard where the dot product of its size
with the shard's residual capacity is highest, among shards that it overfills in nothing; where there is none, to the
shard that it overfills least. Then the fullest and the emptiest shard exchange a group while that brings their bytes
nearer and leaves tokens and rows as near as they were (law `bytes`).

Only sums reach the driver, and their number doesn't grow with the input: a group that holds 1 / PARCELS of all bytes,
tokens or rows or more is an item (there can't be more than 3 * PARCELS), and lighter ones fall by the hash of their
text into PARCELS parcels, each an item. A heavy group is summed and numbered in pieces of a parcel's size, by a hash of
the row, so that no task gets a hot group; its pieces are placed as one, unless the group outweighs a whole shard: then
each is an item, since no law of near equal sizes could hold otherwise. All other groups stay together. Slots follow
from the sums: a piece's first slot is the sum of the rows of its shard's earlier pieces.

Defined results: a null text has 0 bytes, no words and CRC 0, and all null texts are one group, apart from the empty
text's. A single row that outweighs a shard fills one. Long texts only count by their sums; none is ever carried. Ties
and repeated rows are ordered by doc_id, then by the row's hash, and each has a slot of its own. An empty table gives no
row. Columns of the input other than doc_id and text are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, materialize

SHARDS = 40
#: Hash parcels of light groups: a parcel holds about 1/400 of a shard, and so does a piece of a group that outweighs one.
PARCELS = 16_384
#: Shards whose bytes differ by less than this part of the mean aren't brought nearer.
NEAR = 0.001
ROW_OVERHEAD = 16


def place(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of sizes: bytes, tokens, rows): largest items first, by dot product with the residual capacity."""
    total = sizes.sum(axis=0)
    share = sizes / np.where(total > 0, total, 1) * shards  # 1 is a shard's capacity in each dimension
    left = np.ones((shards, sizes.shape[1]))
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable") if len(sizes) else ():
        room = (left - share[i]).min(axis=1)
        fits = room >= 0
        out[i] = k = int(np.argmax(np.where(fits, left @ share[i], -np.inf) if fits.any() else room))
        left[k] -= share[i]
    return exchange(share, out, shards)


def exchange(share: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """at, with items exchanged between the fullest and the emptiest shard in bytes while that brings the two nearer."""
    load = np.zeros((shards, share.shape[1]))
    np.add.at(load, at, share)
    while True:
        full, empty = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        gap = load[full, 0] - load[empty, 0]
        a, b = np.flatnonzero(at == full), np.flatnonzero(at == empty)
        if gap < NEAR or not len(a) or not len(b):
            return at
        moved = share[a][:, None, :] - share[b][None, :, :]
        off = np.maximum(np.abs(load[full, 1:] - moved[:, :, 1:] - 1), np.abs(load[empty, 1:] + moved[:, :, 1:] - 1)).max(axis=2)
        bound = max(np.abs(load[[full, empty], 1:] - 1).max(), 0.02)
        gain = np.minimum(moved[:, :, 0], gap - moved[:, :, 0])  # at most half the gap; below zero the two would part
        gain[off > bound] = 0
        best = int(gain.argmax())
        if gain.flat[best] < gap / 1000:
            return at
        i, j = a[best // len(b)], b[best % len(b)]
        at[i], at[j] = empty, full
        load[full] -= share[i] - share[j]
        load[empty] += share[i] - share[j]


def shard(docs: DataFrame, shards: int = SHARDS, parcels: int = PARCELS) -> DataFrame:
    """doc_id, size, text_crc32, tokens, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = materialize(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode(text, "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(text, text.isNull()).alias("group"),
            F.xxhash64("doc_id", text).alias("row"),
        ),
        "shard-rows",
    )
    sums = (F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    names = ("size", "tokens", "rows")
    total = {c: n or 0 for c, n in rows.agg(*sums).first().asDict().items()}
    # Groups that hold 1 / parcels of a total or more: at most 3 * parcels, whatever the input.
    weight = F.greatest(*[F.col(c) * F.lit(parcels / max(total[c], 1)) for c in names])
    heavy = rows.groupBy("group").agg(*sums).where(weight >= 1).select("group", "rows", F.ceil(weight).alias("weight")).collect()
    pieces = [(h["group"], min(h["rows"], h["weight"] + 1)) for h in heavy]
    cut = {h["group"] for h in heavy if h["weight"] * shards > parcels}  # outweighs a shard
    known = F.broadcast(spark.createDataFrame(pieces, "group long, pieces int"))
    keyed = rows.join(known, "group", "left")
    # A piece is named by its group and a hash of the row, so that no piece needs the rows of its group together.
    keyed = keyed.withColumn("piece", F.when(F.col("pieces").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("row", F.lit(7)), F.col("pieces"))).cast("int"))
    keyed = keyed.withColumn("item", F.when(F.col("piece") < 0, F.pmod("group", F.lit(parcels))).otherwise(F.col("group")))
    parts = sorted(keyed.groupBy("item", "piece").agg(*sums).collect(), key=lambda r: (r["piece"] < 0, r["item"], r["piece"]))
    units: dict[tuple, int] = {}
    unit = [units.setdefault((r["item"], r["piece"] if r["piece"] < 0 or r["item"] in cut else 0), len(units)) for r in parts]
    sizes = np.zeros((len(units), 3))
    np.add.at(sizes, np.array(unit, np.int64), np.array([[r[c] for c in names] for r in parts], float).reshape(-1, 3))
    at = place(sizes, shards)[unit] if parts else []
    first, used = [], [0] * shards
    for r, k in zip(parts, at, strict=True):
        first.append(used[k])
        used[k] += r["rows"]
    where = spark.createDataFrame([(r["item"], r["piece"], int(k), f) for r, k, f in zip(parts, at, first, strict=True)], "item long, piece int, shard int, first long")
    order = Window.partitionBy("item", "piece").orderBy("doc_id", "row")
    return (
        keyed.join(F.broadcast(where), ["item", "piece"])
        .withColumn("slot", F.col("first") + F.row_number().over(order) - 1)
        .select("doc_id", "size", "text_crc32", "tokens", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
