"""Near-duplicate texts: b-bit MinHash signatures, a multi-index Hamming join, links confirmed on full shingle sets.

A text's set holds its distinct k-word shingles (64-bit hashes of lower-cased words). Texts with equal sets are one
class, and the class goes on as its smallest doc_id. A signature is 48 MinHash values of 16 bits, in 12 chunks of four.
Two signatures that differ in at most 23 values have, by the pigeonhole principle, a chunk that differs in at most one;
so each class enters, for each chunk and each of its values, a bucket named by the other three (the allowed error
enumerated), and every pair within distance 23 shares a bucket. A pair of similarity 0.8 differs in more than 23 values
with a chance of 2e-6, and even then mostly shares a bucket: all 12 chunks fail with a chance of 1e-9. Signatures only
propose pairs; they reject none.

Buckets never become all pairs. A bucket's smallest member, the hub, is a partial aggregate; every member is compared
with it on full sets, and the links found are joined to components. Buckets and hubs are found again by joins in which
the hottest keys are broadcast (a bounded number, see common.attach), so that no task gets all rows of one. The comparison also writes a member's set in terms of the hub's: a mask of the
hub's shingles that it holds, and the list of its further ones. Members of one hub that then still lie in different
components are compared by these, which is again the exact comparison of full sets, in groups of hub and pair of blocks
(a hub of any size is spread over tasks, and rows of its largest component only meet others); one link a member and
component leaves a group. So no component is lost, and
copies and near copies of one text send a number of rows in proportion to them.

Defined results: a null or empty text, or one of white space, has an empty set and is linked with nothing; with fewer
than k words the whole sequence is the one shingle. A row without a doc_id is linked with nothing and kept. Rows that
share a doc_id are one document. An empty table gives no row. Whole texts count, however long. Columns of the input other
than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, as_signed, attach, components, discard, documents, grams, group_bounds, materialize, mix, slices, stream, whole_groups

VALUES = 48
CHUNK = 4
#: Rows of a block of a hub's members, and of a block of those in its largest component.
BLOCK, MAIN_BLOCK = 256, 128
#: Members that are confirmed against one text in one group of rows.
FAN = 64
_FLIP, _FACTOR = stream(11, VALUES), stream(12, VALUES) | np.uint64(1)
_SALT = stream(13, VALUES)


def shingle_sets(text: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = Words(text, lower=True)
    g = grams(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(w.hash[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 2048):
        part = (shingles[None, s : s + 2048] ^ _FLIP[:, None]) * _FACTOR[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype("<u2")


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """VALUES keys of each signature: of every chunk, its values without one of them."""
    s = signatures.astype(np.uint64).reshape(len(signatures), VALUES // CHUNK, CHUNK)
    out = []
    for left_out in range(CHUNK):
        key = np.zeros(s.shape[:2], np.uint64)
        for j in range(CHUNK):
            if j != left_out:
                key = key << np.uint64(16) | s[:, :, j]
        out.append(key)
    return as_signed(mix(np.stack(out, axis=2).reshape(len(s), VALUES) ^ _SALT))


def fingerprints(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, s1 and s2 (a 128-bit hash of the set), sig; as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                sets = shingle_sets(b.column("text"), k)
                sums = [as_signed(np.array([x.sum(dtype=np.uint64) if how == 0 else mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)) for how in (0, 1)]
                sig = [signature(x).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("text_hash"), pa.array(np.array([len(x) for x in sets], np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sig, pa.binary())],
                    names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, s1 long, s2 long, sig binary"), "fingerprints")


def confirm(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """id, hub, linked, mask, others of every pair (id, hub), from the full sets of their texts; as a table.

    mask has a bit for each of the hub's shingles in order, others holds id's further ones (8 bytes each). Texts travel
    once a pair: a hub's pairs are cut into groups of about FAN, each with the hub's text.
    """
    large = materialize(pairs.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > FAN), "large-hubs")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / FAN)
    pairs = attach(pairs, large, "hub", "left").select("id", "hub", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(1).alias("kind"))
    needed = materialize(pairs.union(pairs.select(F.col("hub").alias("id"), "hub", "part", F.lit(0).alias("kind")).distinct()), "needed")
    # Always a sort-merge join: the rows needed grow with the corpus, and so the plan is the same at every size.
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(needed.hint("merge"), "id").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []
        for whole in batches:
            for b in slices(whole):
                found = []
                rows = zip(shingle_sets(b.column("text"), k), *[b.column(c).to_pylist() for c in ("id", "hub", "part", "kind")], strict=True)
                for own, doc, hub, part, kind in rows:
                    if kind == 0:
                        if at != (hub, part):
                            at, hubs = (hub, part), []
                        hubs.append(own)  # more than one only where rows share a doc_id
                        continue
                    linked = False
                    for nth, other in enumerate(hubs):
                        place = np.minimum(np.searchsorted(own, other), max(len(own) - 1, 0))
                        held = own[place] == other if len(own) else np.zeros(len(other), bool)
                        both = int(held.sum())
                        linked |= both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
                        if nth == 0:
                            further = np.ones(len(own), bool)
                            further[place[held]] = False
                            mask, others = np.packbits(held).tobytes(), own[further].tobytes()
                    found.append((doc, hub, linked, mask, others))
                columns = zip(*found, strict=True) if found else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "hub", "linked", "mask", "others"])

    found = materialize(texts.select("id", "hub", "part", "kind", "text").mapInArrow(run, "id long, hub long, linked boolean, mask binary, others binary"), "confirmed")
    discard(large, needed)
    return found


def more_links(tested: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(id, hub): links between a hub's members in different components, one at least for each member and component it reaches.

    tested: as from confirm(); parts: id, component.
    """
    labelled = tested.drop("linked").join(parts, "id", "left").withColumn("part_of", F.coalesce("component", "id"))
    each = labelled.groupBy("hub", "part_of").agg(F.count("*").alias("n"))
    state = each.groupBy("hub").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part_of")).alias("most"))
    # Rows of the largest component (main) have blocks of their own, after the others', and meet only the others.
    todo = state.where("most.n < n").select("hub", "n", F.col("most.part_of").alias("main"), F.ceil((F.col("n") - F.col("most.n")) / BLOCK).cast("int").alias("few"), F.ceil(F.col("most.n") / MAIN_BLOCK).cast("int").alias("many"))
    todo = materialize(todo, "split-hubs")
    drawn = F.xxhash64("id", F.lit(3))
    dealt = attach(labelled, todo, "hub").withColumn("is_main", F.col("part_of") == F.col("main"))
    dealt = dealt.withColumn("side", F.when(F.col("is_main"), F.col("few") + F.pmod(drawn, F.col("many"))).otherwise(F.pmod(drawn, F.col("few"))).cast("int"))
    meets = F.when(F.col("is_main"), F.col("few")).otherwise(F.col("few") + F.col("many"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), meets - 1))).withColumn("i", F.least("side", "o")).withColumn("j", F.greatest("side", "o"))
    dealt = dealt.select("hub", "i", "j", "id", "part_of", "side", "mask", "others").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["hub", "i", "j"]):
            hub, i, j, ids, part_of, side = (t.column(c).to_numpy() for c in ("hub", "i", "j", "id", "part_of", "side"))
            bounds = group_bounds(hub, i, j)
            found = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                part, mine = part_of[a:b], side[a:b]
                if (part == part[0]).all():
                    continue
                masks = [m.as_py() for m in t.column("mask")[a:b]]
                width = max(map(len, masks))  # rows that share a doc_id may bring masks of two lengths
                bits = np.frombuffer(b"".join(m.ljust(width, b"\0") for m in masks), np.uint8).reshape(b - a, width)
                lists = [np.frombuffer(m.as_py(), np.uint64) for m in t.column("others")[a:b]]
                n_others = np.array(list(map(len, lists)))
                names, flat = np.unique(np.concatenate(lists), return_inverse=True)
                owner, present = np.repeat(np.arange(b - a), n_others), np.zeros(len(names), bool)
                start = np.concatenate([[0], np.cumsum(n_others)])
                size = np.bitwise_count(bits).sum(axis=1, dtype=np.int64) + n_others
                values, counts = np.unique(part, return_counts=True)
                done = np.zeros(b - a, bool)
                for x in np.flatnonzero(part != values[counts.argmax()]).tolist():  # the largest component's rows are met from the other side
                    done[x] = True
                    at = np.flatnonzero((part != part[x]) & ~done & (True if i[a] == j[a] else mine != mine[x]))
                    both = np.bitwise_count(bits[at] & bits[x]).sum(axis=1, dtype=np.int64)
                    most = both + np.minimum(n_others[at], n_others[x])
                    likely = 100 * most >= percent * (size[at] + size[x] - most)
                    if not likely.any():
                        continue
                    at, both = at[likely], both[likely]
                    own = flat[start[x] : start[x + 1]]
                    present[own] = True
                    both = both + np.bincount(owner[present[flat]], minlength=b - a)[at]
                    present[own] = False
                    at = at[100 * both >= percent * (size[at] + size[x] - both)]
                    at = at[np.unique(part[at], return_index=True)[1]]
                    found += [(ids[a + x], y) for y in ids[a + at].tolist()]
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["id", "hub"])

    return dealt.mapInArrow(run, "id long, hub long")


def link(docs: DataFrame, k: int, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(prints, parts): prints has doc_id, text_hash, n_shingles and rep (the class, null if linked with nothing); parts has id and component of linked classes."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = fingerprints(docs, k)
    classes = prints.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = materialize(classes, "classes")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(len(b), VALUES)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_keys(sig).ravel()), pa.array(np.repeat(b.column("rep").to_numpy(), VALUES))], names=["key", "id"])

    entries = classes.select("rep", "sig").mapInArrow(keyed, "key long, id long")
    shared = materialize(entries.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    # Only pairs of a member and its bucket's smallest one leave the buckets.
    stars = materialize(attach(entries, shared, "key").where("id != hub").select("id", "hub").distinct(), "pairs")
    discard(shared)
    tested = confirm(docs, stars, k, percent)
    discard(stars)
    links = tested.where("linked").select("id", "hub")
    parts = components(links, "id", "hub")
    more = materialize(more_links(tested, parts, percent), "links")
    if not more.isEmpty():
        parts = components(links.union(more), "id", "hub")
    discard(tested, more)
    rows = prints.join(classes.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"], "left")
    return rows.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep")), parts


def dedup(docs: DataFrame, k: int, percent: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text, to tell rows that share a doc_id), n_shingles, component_id, kept for every row."""
    prints, parts = link(docs, k, percent)
    rows = prints.join(parts, F.col("rep") == F.col("id"), "left")
    rows = rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir), k=2).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + 1) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 1, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
ids AS (SELECT doc_id, hash(g) AS h, n FROM sh JOIN n USING (doc_id)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS x FROM ids a JOIN ids b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, 3, 4),
links AS (SELECT a, b FROM shared WHERE 100 * x >= 80 * (na + nb - x)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM parts LEFT JOIN n USING (doc_id)
"""
