"""Token ids of whole texts by the public vocabulary files, equal to those of the tokenizers library and cheaper.

WordEncoder (files that drop white space and case) cuts texts at spaces, has Arrow find the distinct chunks, and gives
only pieces not met before to the library's model. ByteEncoder (byte-level files) merges with tiktoken, whose ranks are
read from the same JSON file. Both hand a text over to the tokenizers library as a whole wherever the short way isn't
known to agree: on characters outside plain Latin letters, digits, common punctuation and ordinary white space, and
where the text may hold a special token. Tests compare both with the library.
"""

from __future__ import annotations

import gc
import json
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import single_thread, slices

#: Chunks and pieces kept by a worker; at this bound the least recently met go. It bounds memory, not what is encoded.
MOST_CHUNKS = 600_000
MOST_PIECES = 300_000
#: Characters that go the long way: beyond Latin Extended-B, controls, odd spaces, the dotted capital I, and a common start of special tokens.
ODD = r"[^\n\r\t -~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]|<\|"
#: The files' own patterns of pieces (fixed values).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_TAIL = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 itself, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(others)) for b in range(256)}


class _Encoder:
    def __init__(self, path: str):
        single_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        #: Texts that hold a special token's string go the long way too.
        self.odd = "|".join([ODD, *sorted(re.escape(t["content"]) for t in self.file["added_tokens"])])

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def ids(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat uint32 ids, offsets) of a string array; a null text has no ids."""
        text = text.fill_null("")
        odd = pc.match_substring_regex(text, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self.plain(text)
        out, offsets = self.plain(pc.if_else(pa.array(odd), "", text))
        parts, at, sizes = [], 0, np.diff(offsets)
        for i in np.flatnonzero(odd).tolist():
            found = self.whole(text[i].as_py())
            parts += [out[at : offsets[i]], found]
            at = offsets[i + 1]
            sizes[i] = len(found)
        return np.concatenate([*parts, out[at:]]), np.concatenate([[0], np.cumsum(sizes)])


class ByteEncoder(_Encoder):
    """For byte-level files without a normalizer."""

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        special = {t["content"] for t in self.file["added_tokens"]}
        back = {letter: b for b, letter in byte_letters().items()}
        ranks = {bytes(map(back.__getitem__, k)): v for k, v in self.file["model"]["vocab"].items() if k not in special}
        self.merge = tiktoken.Encoding("own", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(self.merge(t), np.uint32) for t in text.to_pylist()]
        offsets = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(x) for x in each], out=offsets[1:])
        return np.concatenate([np.zeros(0, np.uint32), *each]), offsets


class WordEncoder(_Encoder):
    """For files that put letters in lower case, drop white space and mark word ends."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.letters = byte_letters()
        self.codes: dict[str, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[c]:ends[c + 1] is chunk c
        self.met = np.zeros(0, np.int64)  # when each chunk was last met
        self.n = self.now = 0

    def _forget(self) -> None:
        """Keep the half of the chunks that were met last."""
        met = self.met[: self.n]
        kept = np.flatnonzero(met > np.partition(met, self.n // 2)[self.n // 2])
        sizes = self.ends[kept + 1] - self.ends[kept]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(self.ends[kept] - ends[:-1], sizes) + np.arange(ends[-1])]
        names = np.array(list(self.codes), object)[kept]  # a dict keeps the order in which codes were given
        self.codes = dict(zip(names.tolist(), range(len(kept)), strict=True))
        self.flat, self.ends, self.met, self.n = flat, ends, self.met[kept], len(kept)

    def _part(self, piece: str) -> tuple[int, ...]:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)  # no ASCII piece holds a space
        found = self.parts[piece] = tuple([t.id for t in self.model.tokenize(shown)])
        return found

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        get = self.parts.get
        word = chunk.rstrip(_TAIL)
        if word.isalpha():
            found = get(word) or self._part(word)
            if len(word) == len(chunk):
                return found
            tail = chunk[len(word) :]
            return found + (get(tail) or self._part(tail))
        out: tuple[int, ...] = ()
        for piece in self.pieces(chunk):
            out += get(piece) or self._part(piece)
        return out

    def _add(self, chunks: list[str]) -> None:
        gc.disable()  # else the collector walks the kept chunks again and again
        found = [self._chunk(c) for c in chunks]
        gc.enable()
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        top, more = int(self.ends[self.n]), int(sizes.sum())
        if self.n + len(found) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(found)), np.int64)])
        if top + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), more), np.uint32)])
        self.flat[top : top + more] = np.fromiter(chain.from_iterable(found), np.uint32, more)
        self.ends[self.n + 1 : self.n + 1 + len(found)] = top + np.cumsum(sizes)
        self.codes.update(zip(chunks, range(self.n, self.n + len(found)), strict=True))
        self.n += len(found)

    def _lookup(self, chunks: list[str]) -> np.ndarray:
        if self.n > MOST_CHUNKS:
            self._forget()
        if len(self.parts) > MOST_PIECES:
            self.parts.clear()
        found = np.fromiter(map(self.codes.get, chunks, repeat(-1)), np.int64, len(chunks))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            found[missing] = np.arange(self.n, self.n + len(missing))
            self._add([chunks[i] for i in missing.tolist()])
        self.now += 1
        if len(self.met) < self.n:
            self.met = np.concatenate([self.met, np.zeros(max(self.n, 1 << 16), np.int64)])
        self.met[found] = self.now
        return found

    def plain(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(pc.utf8_lower(text), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = lists.flatten().dictionary_encode()
        chunk = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        sizes = self.ends[chunk + 1] - self.ends[chunk]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = self.flat[np.repeat(self.ends[chunk] - ends[:-1], sizes) + np.arange(ends[-1])]
        return out, ends[bounds]


_encoders: dict[tuple[type, str], _Encoder] = {}


def encoder(kind: type[_Encoder], path: str) -> _Encoder:
    """This worker's encoder for a file; Spark reuses workers, and with them the chunks already met."""
    if (kind, path) not in _encoders:
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def text_slices(batch: pa.RecordBatch):
    return slices(batch, most=4_000_000)
