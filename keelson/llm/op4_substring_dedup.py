"""Exact substring deduplication by suffix trees over prefix groups: repeats of `length` words or more are cut out.

A window is `length` consecutive words; it is a repeat if the same words also start earlier (a smaller doc_id, or the
same document further left). Only suffixes that can share `length` words with another are ever brought together:

1. Prefix groups. Suffixes don't travel one by one (`length` words each would be about twenty times the input). Each
   window is carried by one sampled suffix: the one that starts, within the window, at its GRAM-word sequence of smallest
   hash, so that equal windows are carried by suffixes with the same GRAM-word prefix. Neighbouring windows of one
   sampled suffix form a run, a stretch of text that holds all suffixes starting in it. The prefix names the run's group.
2. Prefixes are of variable length. Those that hold a large part of the corpus are known beforehand (HOT_PARTS) and aren't
   taken where a window offers another; and a group of more than GROUP different runs, whatever the reason, is split by
   lengthening its prefix to whole windows. So groups fit in memory, a common phrase or a text copied by the thousand
   included.
3. Equal runs collapse, first within a batch, then in their group: all but the earliest are repeats as they stand.
4. Groups in which different runs are left get the runs' text, and a compacted suffix tree of all suffixes of `length`
   words or more. The shallowest internal nodes `length` deep or more are the roots of what repeats: of the leaves below
   one, all but the earliest are repeats. Deep nodes with different words before their leaves are the maximal repeats.
5. Repeats return to their documents, and words covered by one go.

Memory holds a batch of runs or a chunk of groups, never a document set. Defined results: a null text has no words; texts
under `length` words keep all. Words are cut at ASCII white space and kept words joined by one space. Rows without a
doc_id come after all others. Rows with equal doc_id and text are one occurrence, and neither removes from the other.
A long text is cut into runs in stretches, whole. An empty table gives no row. Other columns pass through untouched,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _BASE, _INVERSE, Words, as_signed, discard, documents, grams, group_bounds, materialize, mix, powers, slices, whole_groups

LENGTH = 20
GRAM = 5
#: A prefix is frequent if it has more occurrences than FREQUENT and one of HOT_PARTS equal parts of all or more; so there
#: are at most HOT_PARTS of them (8 bytes each). A batch reports what holds one of BATCH_PARTS parts of it, so that a
#: prefix with two such parts of the corpus is surely found. This keeps tasks even; results and memory don't rest on it.
FREQUENT = 512
HOT_PARTS = 100_000
BATCH_PARTS = 5_000
#: Different runs of a group at most; a larger group is split by lengthening its prefix.
GROUP = 8_192
#: Runs whose trees are built at once.
CHUNK = 20_000
_LAST = (1 << 63) - 1
REPEAT, SMALL, LARGE = 1, 2, 3
_PLACE = np.uint64((1 << 20) - 1)


def frequent_prefixes(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of GRAM-word sequences that occur too often to name a group, counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                w = Words(b.column("text"))
                g = grams(w.hash, GRAM)
                inside = np.ones(len(g), bool)
                for back in range(1, GRAM):
                    ends = w.first[1:-1] - back
                    inside[ends[(ends >= 0) & (ends < len(g))]] = False
                found, n = np.unique(g[inside], return_counts=True)
                total = int(n.sum())
                many = n * BATCH_PARTS >= total
                yield pa.RecordBatch.from_arrays([pa.array([*as_signed(found[many]).tolist(), None], pa.int64()), pa.array([*n[many].tolist(), total], pa.int64())], names=["gram", "n"])

    counts = docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "prefix-counts")
    total = counts.where("gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("gram").isNotNull() & (F.col("n") > FREQUENT) & (F.col("n") * HOT_PARTS >= total)).select("gram").toArrow()
    discard(counts)
    return np.sort(rows.column("gram").to_numpy().astype(np.int64).view(np.uint64))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """digest(s, n): a hash of the words of n windows from word s on, alike wherever they stand."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(_BASE, len(h)), out=sums[1:])
    back = powers(_INVERSE, len(h) + 1)

    def digest(s: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mix((sums[s + n + length - 1] - sums[s]) * back[s] + n.astype(np.uint64))

    return digest


def runs_of(h: np.ndarray, first: np.ndarray, frequent: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start word in row, windows, group key, hash) of the runs in rows of word hashes; at most 2 ** 20 words."""
    g = grams(h, GRAM)
    windows = len(h) - length + 1
    if windows <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    order = g >> np.uint64(1) & ~_PLACE | np.arange(len(g), dtype=np.uint64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        order |= (frequent[at] == g).astype(np.uint64) << np.uint64(63)
    span, width = 1, length - GRAM + 1
    while span < width:  # the least of `width` neighbours, by doubling
        step = min(span, width - span)
        order = np.minimum(order[:-step], order[step:])
        span += step
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    valid = np.flatnonzero(rows[:windows] == rows[length - 1 :])
    chosen = order[valid]
    digest = window_hashes(h, length)
    alone = (chosen >> np.uint64(63)).astype(bool)
    new = np.ones(len(valid), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1] + 1) | alone[1:]
    at = np.flatnonzero(new)
    start, n = valid[at], np.diff(np.append(at, len(valid)))
    hashes = digest(start, n)
    key = np.where(alone[at], ~hashes, g[(chosen[at] & _PLACE).astype(np.int64)])
    return rows[start], start - first[rows[start]], n, key, hashes


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """d, t, start, n, key, hash of the first of equal runs of each batch; key is null for the later ones, which are repeats."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_prefixes(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for whole in batches:
            parts = []
            for b in slices(whole):
                w = Words(b.column("text"))
                d, t = b.column("d").to_numpy(), b.column("t").to_numpy()
                step = (1 << 20) - length + 1
                for s in range(0, max(1, len(w.hash) - length + 1), step):  # more than one step only in a very long text
                    e = min(s + step + length - 1, len(w.hash))
                    row, start, n, key, hashes = runs_of(w.hash[s:e], np.clip(w.first, s, e) - s, frequent, length)
                    start = start + np.clip(s - w.first[row], 0, None)
                    parts.append((key, hashes, d[row], start, n, t[row]))
            key, hashes, d, start, n, t = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 6
            order = np.lexsort((start, d, hashes, key))
            key, hashes, d, start, n, t = (x[order] for x in (key, hashes, d, start, n, t))
            later = np.zeros(len(key), bool)
            later[1:] = (key[1:] == key[:-1]) & (hashes[1:] == hashes[:-1])
            # Rows with the same doc_id and text are one occurrence: they aren't later than themselves.
            first = np.maximum.accumulate(np.where(later, 0, np.arange(len(key))))
            later &= (d != d[first]) | (start != start[first])
            yield pa.RecordBatch.from_arrays(
                [pa.array(d), pa.array(t), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(as_signed(key), mask=later), pa.array(as_signed(hashes), mask=later)],
                names=["d", "t", "start", "n", "key", "hash"],
            )

    return docs.select("d", "t", "text").mapInArrow(run, "d long, t int, start int, n int, key long, hash long")


def split_groups(runs: DataFrame) -> DataFrame:
    """d, t, start, n, key, kind: REPEAT for repeats; SMALL and LARGE for the different runs of groups with more than one, by the group's size. A table."""
    spread = F.coalesce("key", F.xxhash64("d", "start"))
    dealt = runs.repartition(spread).sortWithinPartitions("key", "hash", "d", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "t", "start", "n", "key"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        # What goes on from batch to batch: the last key and hash, and the earliest of that run; the last group's
        # different runs while they aren't too many; and the key of a group that was too large already.
        key_at = hash_at = earliest = large = None
        held = [np.zeros(0, t.to_pandas_dtype()) for t in types]

        def rows(columns: list, kind: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(columns, types, strict=True)], pa.array(kind.astype(np.int32))], names=[*names, "kind"])

        for b in batches:
            ready = b.column("key").is_null().to_numpy(zero_copy_only=False)
            if ready.any():
                done = b.filter(pa.array(ready))
                yield pa.RecordBatch.from_arrays([*[done.column(c) for c in names], pa.array(np.full(len(done), REPEAT, np.int32))], names=[*names, "kind"])
                b = b.filter(pa.array(~ready))
            if not len(b):
                continue
            key, hashes, d, t, start, n = (b.column(c).to_numpy() for c in ("key", "hash", "d", "t", "start", "n"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (hashes[1:] != hashes[:-1])
            new[0] = (key[0], hashes[0]) != (key_at, hash_at)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead_d, lead_start = np.where(lead < 0, earliest[0] if earliest else 0, d[lead]), np.where(lead < 0, earliest[1] if earliest else 0, start[lead])
            repeat = np.flatnonzero(~new & ((d != lead_d) | (start != lead_start)))
            yield rows([x[repeat] for x in (d, t, start, n, key)], np.full(len(repeat), REPEAT))
            at = np.flatnonzero(new)
            if len(at):
                earliest = (d[at[-1]], start[at[-1]])
            key_at, hash_at = key[-1], hashes[-1]
            each = [np.concatenate([x, y[at]]) for x, y in zip(held, (d, t, start, n, key), strict=True)]
            bounds = group_bounds(each[4])
            sizes = np.diff(bounds)
            kind = np.where(sizes > GROUP, LARGE, np.where(sizes > 1, SMALL, 0))
            if len(sizes):
                kind[each[4][bounds[:-1]] == large] = LARGE
                if kind[-1] == LARGE:
                    large = each[4][-1]
                else:  # the last group may go on
                    kind[-1] = 0
            last = bounds[-2] if len(sizes) and kind[-1] != LARGE else bounds[-1]
            of_row = np.repeat(kind, sizes)
            out = np.flatnonzero(of_row)
            yield rows([x[out] for x in each], of_row[out])
            held = [x[last:] for x in each]
        if len(held[0]) > 1:
            yield rows(held, np.full(len(held[0]), SMALL))

    return materialize(dealt.mapInArrow(run, "d long, t int, start int, n int, key long, kind int"), "runs")


class SuffixTree:
    """A compacted tree of the suffixes of word sequences (sequence i is h[first[i]:first[i + 1]]) that have `least` words or more.

    Leaves stand in suffix order: run and offset say where each starts. common[i] is the number of words that leaf i shares
    with the leaf before it; internal nodes are the intervals of leaves between smaller values, which are their depths.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray, least: int = 1):
        sizes = np.diff(first)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        begin = first[:-1] + np.arange(len(sizes))  # a terminator of its own ends each sequence
        place = np.arange(len(of)) - begin[of] if len(of) else np.zeros(0, np.int64)
        is_word = place < sizes[of]
        words, ids = np.unique(h, return_inverse=True)
        rank = np.empty(len(of), np.int64)
        rank[is_word], rank[~is_word] = ids, len(words) + np.arange(len(sizes))
        levels = [rank]  # level k numbers the stretches of 2 ** k words; a stretch past a terminator has a number of its own
        while 1 << len(levels) <= (int(sizes.max()) if len(sizes) else 0):
            m = 1 << len(levels) - 1
            follows = np.full(len(rank), -1)
            follows[:-m] = rank[m:]
            rank = np.unique((rank << 32) + follows + 1, return_inverse=True)[1]
            levels.append(rank)
        suffixes = np.flatnonzero(is_word & (sizes[of] - place >= least)) if len(of) else place
        m = 1 << len(levels) - 1
        order = np.lexsort((rank[np.minimum(suffixes + m, len(rank) - 1)], rank[suffixes])) if len(suffixes) else suffixes
        suffixes = suffixes[order]
        self.run, self.offset = of[suffixes], place[suffixes]
        self.common = np.zeros(len(suffixes), np.int64)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        for k in reversed(range(len(levels))):
            same = levels[k][a] == levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        self.common[1:] = b - suffixes[1:]
        self.before = np.where(self.offset > 0, levels[0][np.maximum(suffixes - 1, 0)], -1 - np.arange(len(suffixes)))

    def roots(self, depth: int) -> np.ndarray:
        """For each leaf the number of the shallowest node above it that is `depth` deep or more; a leaf without one has a number of its own."""
        return np.cumsum(self.common < depth) - 1

    def nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """(first leaf, leaf after the last, depth) of the internal nodes `depth` deep or more."""
        out, stack = [], []
        for i, c in enumerate([*self.common.tolist(), 0]):
            at = i - 1
            while stack and stack[-1][1] > c:
                at, deep = stack.pop()
                if deep >= depth:
                    out.append((at, i, deep))
            if c > 0 and (not stack or stack[-1][1] < c):
                stack.append((at, c))
        return out

    def maximal_repeats(self, depth: int) -> list[tuple[int, int, int]]:
        """The nodes whose leaves have different words before them, or stand at the start of a sequence: they can't be extended to either side."""
        return [(a, b, n) for a, b, n in self.nodes(depth) if len(np.unique(self.before[a:b])) > 1]


def tree_repeats(h: np.ndarray, first: np.ndarray, d: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of the windows of runs that are not the earliest leaf below their node of `length` words or more."""
    tree = SuffixTree(h, first, length)
    root, place = tree.roots(length), start[tree.run] + tree.offset
    order = np.lexsort((place, d[tree.run], root))
    root, place, of = root[order], place[order], d[tree.run][order]
    lead = group_bounds(root)[:-1][root]  # the earliest leaf of each node
    later = (of != of[lead]) | (place != place[lead])
    found = order[later]
    found = found[np.lexsort((tree.offset[found], tree.run[found]))]
    return tree.run[found], tree.offset[found]


def run_texts(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """key, d, t, start, text of needed runs."""
    per_text = needed.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n", "key")).alias("runs"))
    # All columns, though only three are used: the shuffle of docs is then the same as the last join's, and done once.
    joined = docs.join(per_text, ["d", "t"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                w = Words(b.column("text"))
                lists = b.column("runs")
                flat = lists.flatten()
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                row = np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy()))
                a = w.first[row] + start
                e = w.end[a + n + length - 2]
                raw = w.data.tobytes()
                run = pa.array([raw[x:y] for x, y in zip(w.start[a].tolist(), e.tolist(), strict=True)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([flat.field(2), b.column("d").take(pa.array(row)), b.column("t").take(pa.array(row)), pa.array(start.astype(np.int32)), run], names=["key", "d", "t", "start", "text"])

    return joined.mapInArrow(texts, "key long, d long, t int, start int, text string")


def lengthened(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """d, t, start, n of the repeats among the runs of groups that were too large: their prefix is now a whole window, so a group's windows are all equal."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                w = Words(b.column("text"))
                n = np.maximum(w.counts() - length + 1, 0)
                row = np.repeat(np.arange(len(b)), n)
                offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hashes = as_signed(window_hashes(w.hash, length)(w.first[row] + offset, np.ones(len(row), np.int64)))
                d, t, start = (b.column(c).to_numpy()[row] for c in ("d", "t", "start"))
                yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array((start + offset).astype(np.int32)), pa.array(np.ones(len(row), np.int32)), pa.array(hashes), pa.array(hashes)], names=["d", "t", "start", "n", "key", "hash"])

    each = run_texts(docs, needed, length).mapInArrow(windows, "d long, t int, start int, n int, key long, hash long")
    return split_groups(each).where(F.col("kind") == REPEAT).select("d", "t", "start", "n")


def grow_trees(docs: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """d, t, start, n of the repeats among needed runs, from suffix trees."""
    dealt = run_texts(docs, needed, length).repartition("key").sortWithinPartitions("key")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, ["key"]):
            key = held.column("key").to_numpy()
            begins = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            at = 0
            while at < len(begins) - 1:  # whole groups, about CHUNK runs at once
                upto = max(at + 1, int(np.searchsorted(begins, begins[at] + CHUNK, "right")) - 1)
                part = held.slice(begins[at], begins[upto] - begins[at]).combine_chunks()
                at = upto
                w = Words(part.column("text").combine_chunks())
                d, t, start = (part.column(c).to_numpy() for c in ("d", "t", "start"))
                run, offset = tree_repeats(w.hash, w.first, d, start.astype(np.int64), length)
                new = np.ones(len(run), bool)
                new[1:] = (run[1:] != run[:-1]) | (offset[1:] != offset[:-1] + 1)
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(run)))
                yield pa.RecordBatch.from_arrays([pa.array(d[run[first]]), pa.array(t[run[first]]), pa.array((start[run[first]] + offset[first]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["d", "t", "start", "n"])

    return dealt.mapInArrow(trees, "d long, t int, start int, n int")


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All rows of docs with kept_text string, n_words long, n_removed long; columns of docs with these names are replaced."""
    own = ("kept_text", "n_words", "n_removed")
    docs = docs.drop(*own)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.hash("text").alias("t"), "text", *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)])
    found = split_groups(find_runs(base, length))
    repeats = found.where(F.col("kind") == REPEAT).select("d", "t", "start", "n").union(grow_trees(base, found.where(F.col("kind") == SMALL), length))
    large = found.where(F.col("kind") == LARGE)
    if not large.isEmpty():
        repeats = repeats.union(lengthened(base, large, length))
    covered = repeats.groupBy("d", "t").agg(F.collect_list(F.struct("start", "n")).alias("repeats"))
    joined = base.join(covered, ["d", "t"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                w = Words(b.column("text"))
                lists = b.column("repeats")
                flat = lists.flatten()
                start, n = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                sizes = np.zeros(len(b), np.int64)
                sizes[:] = [0 if x is None else x for x in lists.value_lengths().to_pylist()]
                a = np.repeat(w.first[:-1], sizes) + start
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, a, 1)
                np.add.at(edge, a + n + length - 1, -1)
                kept = np.cumsum(edge[:-1]) == 0
                words = np.concatenate([[0], np.cumsum(kept)])[w.first]
                # Kept words with a space after each, less the last space of every text.
                left, right = w.start[kept], w.end[kept]
                span = right - left + 1
                to = np.concatenate([[0], np.cumsum(span)])
                out = w.data[np.minimum(np.repeat(left - to[:-1], span) + np.arange(to[-1]), max(len(w.data) - 1, 0))].copy()
                out[to[1:] - 1] = 0x20
                bounds = to[words]
                some = np.diff(words) > 0
                drop = bounds[1:][some] - 1
                out = np.delete(out, drop)
                bounds = bounds - np.concatenate([[0], np.cumsum(some)])
                text = pa.Array.from_buffers(pa.string(), len(b), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
                total = w.counts()
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("text"), *[b.column(f"o{i}") for i in range(len(others))], text, pa.array(total), pa.array(total - np.diff(words))], names=[*names, *own])

    names = ["d", "text", *[f"o{i}" for i in range(len(others))]]
    schema = T.StructType([T.StructField("d", T.LongType()), T.StructField("text", kinds["text"]), *[T.StructField(f"o{i}", kinds[c]) for i, c in enumerate(others)], T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = joined.select("d", "text", *[f"o{i}" for i in range(len(others))], "repeats").mapInArrow(run, schema)
    back = {"doc_id": F.when(F.col("d") != _LAST, F.col("d")).cast(kinds["doc_id"]), "text": F.col("text")} | {c: F.col(f"o{i}") for i, c in enumerate(others)}
    return out.select(*[back[c].alias(c) for c in docs.columns], *own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT r, doc_id, s, list_slice(ws, s, s + 19) AS k FROM (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w)),
rep AS (SELECT r, s FROM (SELECT *, min({'d': doc_id, 's': s}) OVER (PARTITION BY k) AS f FROM win) WHERE {'d': doc_id, 's': s} > f),
words AS (SELECT r, doc_id, j, ws[j] AS word FROM (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws))) AS j FROM w)),
marked AS (SELECT words.*, max(rep.s) OVER (PARTITION BY words.r ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM words LEFT JOIN rep ON rep.r = words.r AND rep.s = words.j),
sums AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN sums USING (r)
"""
