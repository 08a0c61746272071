"""SentencePiece encoding and decoding: the n best segmentations of whole texts.

A text's lattice has a node between characters and an edge for each piece of the model file; a segmentation is a path,
and its score the sum of its pieces' scores in the file. Two things keep the exact search cheap:

* Between two characters that stand next to each other in no piece every path passes through the node, so the lattice
  falls into units there (words, marks, unknown characters). Each distinct unit is solved once by a forward and a
  backward Viterbi pass over all units of a batch together, which gives its best path and the gap to its second best.
* A text's n best segmentations differ from the best one only in the n - 1 units of smallest gap: each other unit has n
  better ones before it. Over the lattice of these units a backward A-star search, guided by the forward Viterbi scores
  (exact, so no path is expanded in vain), gives the n best in order.

A very long text is segmented in stretches of about LONG letters, cut between units, since every path passes through such
a node; the n best of the whole are the n best sums over the stretches' own n best, so the result is exact and only one
stretch is worked on at a time. (A single unit, a run of letters in which all neighbours stand in a piece, isn't cut.)

As in the file's own settings, a text gets a space in front, spaces become U+2581, and a character without a piece is
spelled in byte pieces at a score of 10 below the lowest. Decoding joins the pieces and takes back all of that.

Defined results: a null or empty text has one segmentation, without pieces and of score 0. A text with fewer than n
segmentations gives them all. Equal scores are in an order fixed by the search, the same in every run. A text that itself holds U+2581 decodes it as a
space. Repeated rows are each encoded; an empty table gives no row. Columns of the input other than doc_id and text are
neither read nor returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BASE, _INVERSE, documents, mix, powers, slices

BEST = 3
SPACE = "▁"
#: Pieces at or below this score are marked unusable by the file.
UNUSABLE = -1e8
#: Units kept by a worker; at this bound it starts anew. It bounds memory, not what is encoded.
MOST_UNITS = 500_000
#: Letters that are segmented at once; longer texts go in stretches.
LONG = 2_000_000
#: Characters of new units that are solved together.
TOGETHER = 150_000
_NONE = -1e18


class Pieces:
    """A model file's pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = [(i, model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.byte = np.zeros(256, np.int64)
        self.bytes_of: dict[int, bytes] = {}
        self.pieces: dict[str, tuple[int, float]] = {}
        for i, piece, score in every:
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            else:
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                if score > UNUSABLE or len(piece) == 1:
                    self.pieces[piece] = (i, score)
        self.size = model.get_piece_size()
        self.unknown = min(s for _, s in self.pieces.values() if s > UNUSABLE) - 10
        # A letter's own piece is always usable, at worst like an unknown character.
        self.pieces = {p: (i, max(s, self.unknown)) for p, (i, s) in self.pieces.items()}
        self.longest = max(map(len, self.pieces))
        letters = sorted({c for p in self.pieces for c in p})
        self.letter = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        #: Whether two letters stand next to each other in any piece.
        self.joined = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for p in self.pieces:
            if len(p) > 1:
                x = self.letter[np.frombuffer(p.encode("utf-32-le"), np.uint32)]
                self.joined[x[:-1], x[1:]] = True
        # A hash table of the pieces with linear probing.
        self.table = np.zeros(1 << 20, np.uint64)
        self.table_id = np.full(1 << 20, -1, np.int32)
        self.table_score = np.full(1 << 20, _NONE)
        self.probes = 1
        for p, (i, score) in self.pieces.items():
            x = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            h = spans(prefix(x), np.array([0]), len(x))[0]
            at = int(h >> np.uint64(44))
            probe = 1
            while self.table[at]:
                at, probe = (at + 1) & ((1 << 20) - 1), probe + 1
            self.table[at], self.table_id[at], self.table_score[at] = h, i, score
            self.probes = max(self.probes, probe)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place in the table of each hash, or of an empty entry."""
        at = (h >> np.uint64(44)).astype(np.int64)
        out = np.where(self.table[at] == h, at, -1)
        for _ in range(self.probes - 1):
            at = (at + 1) & ((1 << 20) - 1)
            out = np.where((out < 0) & (self.table[at] == h), at, out)
        return out


def prefix(letters: np.ndarray) -> np.ndarray:
    """Running sums from which spans() takes the hash of any stretch of letters."""
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(mix(letters.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(letters)), out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix((sums[start + length] - sums[start]) * powers(_INVERSE, len(sums))[start] + np.uint64(1)) | np.uint64(1)


def a_star(edges: list[list[tuple[int, int, float]]], forward: list[float], n: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n best paths from the first node to the last: (score, [(begin, piece id), ...]).

    edges[e]: (begin, piece id, score) of the edges that end at node e; forward: the best score from the first node to
    each. The search goes backward from the last node; what remains of a path is known exactly.
    """
    last = len(edges) - 1
    agenda: list[tuple[float, int, int, float, tuple | None]] = [(-forward[last], 0, last, 0.0, None)]
    made, out = 1, []
    while agenda and len(out) < n:
        _, _, node, done, path = heapq.heappop(agenda)
        if node == 0:
            found = []
            while path:
                found.append(path[0])
                path = path[1]
            out.append((done, found))
            continue
        for begin, piece, score in edges[node]:
            if forward[begin] > _NONE / 2:
                heapq.heappush(agenda, (-(done + score + forward[begin]), made, begin, done + score, ((begin, piece), path)))
                made += 1
    return out


def lattice(units: list[str], pieces: Pieces) -> tuple[list[list[tuple[int, int, float]]], list[float]]:
    """Edges by end node and forward Viterbi scores of units one after another; a piece id of -1 is an unknown character."""
    edges: list[list[tuple[int, int, float]]] = [[]]
    forward = [0.0]
    at = 0
    get, longest = pieces.pieces.get, pieces.longest
    for u in units:
        for e in range(1, len(u) + 1):
            into = [(at + b, *found) for b in range(max(0, e - longest), e) if (found := get(u[b:e]))]
            if u[e - 1] not in pieces.pieces:
                into.append((at + e - 1, -1, pieces.unknown))
            edges.append(into)
            forward.append(max(forward[b] + s for b, _, s in into))
        at += len(u)
    return edges, forward


class Segmenter:
    """Segments texts by a model; what is known about units is kept from batch to batch."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)
        self.score = np.zeros(0)
        self.gap = np.zeros(0)

    def _spell(self, letter: str) -> np.ndarray:
        return self.pieces.byte[list(letter.encode("utf-8", "replace"))].astype(np.int32)

    def _solve(self, letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(best pieces, the letter each starts at, pieces a unit, best score, gap to the second best) of units, given longest first, by their letters."""
        p, n = self.pieces, len(first)
        total = int(size.sum())
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        cps = letters[np.repeat(first - base, size) + np.arange(total)]
        sums = prefix(cps)
        where = np.arange(total) - np.repeat(base, size)
        room = np.repeat(size, size) - where
        longest = min(p.longest, int(size[0]))
        score, piece = np.full((longest + 1, total), _NONE), np.full((longest + 1, total), -1, np.int32)
        for k in range(1, longest + 1):
            at = np.flatnonzero(room >= k)
            found = p.find(spans(sums, at, k))
            ok = found >= 0
            score[k, at[ok]], piece[k, at[ok]] = p.table_score[found[ok]], p.table_id[found[ok]]
        score[1, piece[1] < 0] = p.unknown
        node = base + np.arange(n)  # the first node of each unit; a unit has one more node than letters
        forward, backward = np.full(total + n, _NONE), np.full(total + n, _NONE)
        taken = np.zeros(total + n, np.int32)
        forward[node], backward[node + size] = 0, 0
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), "right")  # units of at least t letters
        for t in range(1, int(size[0]) + 1):
            a = active[t - 1]
            best, by = np.full(a, _NONE), np.zeros(a, np.int32)
            for k in range(1, min(t, longest) + 1):
                c = forward[node[:a] + t - k] + score[k, base[:a] + t - k]
                better = c > best
                best, by = np.where(better, c, best), np.where(better, k, by)
            forward[node[:a] + t], taken[node[:a] + t] = best, by
        for t in range(1, int(size[0]) + 1):  # t letters before the end
            a = active[t - 1]
            best = np.full(a, _NONE)
            for k in range(1, min(t, longest) + 1):
                best = np.maximum(best, score[k, base[:a] + size[:a] - t] + backward[node[:a] + size[:a] - t + k])
            backward[node[:a] + size[:a] - t] = best
        on_path = np.zeros(total, np.int32)  # length of the best path's piece that starts at a letter
        unit, at = np.arange(n), size.copy()
        while len(unit):
            k = taken[node[unit] + at]
            at = at - k
            on_path[base[unit] + at] = k
            unit, at = unit[at > 0], at[at > 0]
        starts = np.flatnonzero(on_path)
        second = np.full(total, _NONE)
        node_of = np.arange(total) + np.repeat(np.arange(n), size)
        for k in range(1, longest + 1):
            through = np.where((room >= k) & (on_path != k), forward[node_of] + score[k] + backward[np.minimum(node_of + k, total + n - 1)], _NONE)
            second = np.maximum(second, through)
        best = forward[node + size]
        gap = best - np.maximum.reduceat(second, base)
        return piece[on_path[starts], starts], cps[starts], np.add.reduceat((on_path > 0).astype(np.int64), base), best, np.where(gap < -_NONE / 4, gap, np.inf)

    def _add(self, h: np.ndarray, letters: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        order = np.argsort(-size, kind="stable")
        h, first, size = h[order], first[order], size[order]
        cuts = np.searchsorted(np.cumsum(size), np.arange(TOGETHER, int(size.sum()) + TOGETHER, TOGETHER))
        done = 0
        parts = []
        for cut in [*cuts.tolist(), len(h)]:
            upto = min(max(cut, done + 1), len(h))
            if upto > done:
                ids, at, counts, best, gap = self._solve(letters, first[done:upto], size[done:upto])
                unknown = np.flatnonzero(ids < 0)
                if len(unknown):
                    spelled = [self._spell(chr(c)) for c in at[unknown].tolist()]
                    owner = np.repeat(np.arange(upto - done), counts)[unknown]
                    split = np.split(ids, np.stack([unknown, unknown + 1], axis=1).ravel())
                    split[1::2] = spelled
                    ids = np.concatenate(split)
                    np.add.at(counts, owner, np.array([len(x) - 1 for x in spelled]))
                parts.append((ids, counts, best, gap))
                done = upto
        ids, counts, best, gap = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.codes.update(zip(h.tolist(), range(len(self.score), len(self.score) + len(h)), strict=True))
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])
        self.score, self.gap = np.concatenate([self.score, best]), np.concatenate([self.gap, gap])

    def nbest(self, texts: list[str | None], n: int) -> list[list[tuple[float, np.ndarray]]]:
        """(score, piece ids) of the n best segmentations of each text, best first."""
        whole = [(SPACE + t.replace(" ", SPACE)) if t else "" for t in texts]
        out = self._nbest([w if len(w) <= LONG else "" for w in whole], n)
        for i, w in enumerate(whole):
            if len(w) > LONG:
                out[i] = self._in_stretches(w, n)
        return out

    def _in_stretches(self, whole: str, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a long text: of the sums over its stretches the n best, one stretch after another."""
        letter, joined = self.pieces.letter, self.pieces.joined
        best: list[tuple[float, list[np.ndarray]]] = [(0.0, [])]
        at = 0
        while at < len(whole):
            end = min(at + LONG, len(whole))
            while end < len(whole) and joined[letter[ord(whole[end - 1])], letter[ord(whole[end])]]:
                end += 1
            found = self._nbest([whole[at:end]], n)[0]
            sums = sorted(((-a - b, i, j) for i, (a, _) in enumerate(best) for j, (b, _) in enumerate(found)))[:n]
            best = [(-s, [*best[i][1], found[j][1]]) for s, i, j in sums]
            at = end
        return [(s, np.concatenate(parts)) for s, parts in best]

    def _nbest(self, whole: list[str], n: int) -> list[list[tuple[float, np.ndarray]]]:
        joined = "".join(whole)
        if not joined:
            return [[(0.0, np.zeros(0, np.int32))] for _ in whole]
        letters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in whole])])
        kind = self.pieces.letter[letters]
        cut = np.ones(len(letters), bool)
        cut[1:] = ~self.pieces.joined[kind[:-1], kind[1:]]
        cut[bounds[:-1][bounds[:-1] < len(letters)]] = True
        first = np.flatnonzero(cut)
        size = np.diff(np.append(first, len(letters)))
        names, sample, code = np.unique(spans(prefix(letters), first, size), return_index=True, return_inverse=True)
        if len(self.score) > MOST_UNITS:
            self._clear()
        known = np.array([self.codes.get(x, -1) for x in names.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            self._add(names[new], letters, first[sample[new]], size[sample[new]])
            known[new] = [self.codes[x] for x in names[new].tolist()]
        unit = known[code]
        counts = self.ends[unit + 1] - self.ends[unit]
        ends = np.concatenate([[0], np.cumsum(counts)])
        flat = self.ids[np.repeat(self.ends[unit] - ends[:-1], counts) + np.arange(ends[-1])]
        of_text = np.searchsorted(first, bounds)
        scores, gaps = np.concatenate([[0.0], np.cumsum(self.score[unit])]), self.gap[unit]
        out = []
        for i in range(len(whole)):
            a, b = int(of_text[i]), int(of_text[i + 1])
            best, ids = float(scores[b] - scores[a]), flat[ends[a] : ends[b]]
            found = [(best, ids)]
            if n > 1 and b > a:
                mine = gaps[a:b]
                few = np.argpartition(mine, n - 2)[: n - 1] if len(mine) > n - 1 else np.arange(len(mine))
                few = np.sort(few[np.isfinite(mine[few])]) + a
                if len(few):
                    found = self._vary(joined, first, size, unit, few, best, ids, ends, int(ends[a]), n)
            out.append(found)
        return out

    def _vary(self, joined: str, first: np.ndarray, size: np.ndarray, unit: np.ndarray, few: np.ndarray, best: float, ids: np.ndarray, ends: np.ndarray, start: int, n: int) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations, which differ from the one given in the units `few` only."""
        few = few.tolist()
        units = [joined[first[u] : first[u] + size[u]] for u in few]
        found = a_star(*lattice(units, self.pieces), n)
        starts = np.concatenate([[0], np.cumsum([len(u) for u in units])]).tolist()
        out = []
        for score, path in found:
            parts, at, k = [], 0, 0
            new: list[list[int]] = [[] for _ in units]
            for begin, piece in path:
                while begin >= starts[k + 1]:
                    k += 1
                if piece >= 0:
                    new[k].append(piece)
                else:
                    new[k] += self._spell(units[k][begin - starts[k]]).tolist()
            for u, mine in zip(few, new, strict=True):
                parts += [ids[at : ends[u] - start], np.array(mine, np.int32)]
                at = int(ends[u + 1]) - start
            out.append((best + score - found[0][0], np.concatenate([*parts, ids[at:]])))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids."""
        return decode(ids, self.pieces)


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    raw = b"".join(map(pieces.bytes_of.__getitem__, ids.tolist()))
    return raw.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def encode(docs: DataFrame, path: str, n: int = BEST) -> DataFrame:
    """doc_id, rank (from 1), score, ids (binary: little-endian unsigned 32-bit), decoded: the n best segmentations of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = segmenter(path)
        for whole in batches:
            for b in slices(whole):
                found = made.nbest(b.column("text").to_pylist(), n)
                row = np.repeat(np.arange(len(b)), [len(x) for x in found])
                each = [x for of in found for x in of]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").take(pa.array(row)),
                        pa.array([r + 1 for of in found for r in range(len(of))], pa.int32()),
                        pa.array([s for s, _ in each], pa.float64()),
                        pa.array([ids.astype("<u4").tobytes() for _, ids in each], pa.binary()),
                        pa.array([made.decode(ids) for _, ids in each], pa.string()),
                    ],
                    names=["doc_id", "rank", "score", "ids", "decoded"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, rank int, score double, ids binary, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32, decoded_crc32 of the BEST best segmentations of every document."""
    import public_tokenizers

    found = encode(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("decoded", "utf-8")).alias("decoded_crc32"))
