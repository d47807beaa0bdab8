"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Both vocabularies pre-tokenise by a pattern and merge inside each match only, so a text may be cut wherever a
match must end without changing its ids. Cuts: around white space as each pattern treats it, and between an ASCII
letter and one of . , ; : ! ? |. Pieces are kept by hash in a bounded table that outlives a task.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa

from .textbytes import EXACT, FOLDED, SpanHash, class_table, text_chunks

#: Pieces that a worker remembers; beyond that it starts anew.
MAX_PIECES = 2_500_000
_SPACE = ~class_table(b"\x20\x09\x0a\x0b\x0c\x0d")
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_AFTER = _PLAIN.copy()
_AFTER[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?|")] = True
# Letters up to U+00FF, which are normalised as they stand and make one match of either pattern.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
# The byte alphabet of byte-level BPE: bytes that print stand for themselves, the others follow from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _SHOWN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(_SHOWN))}


class CachedTokenizer:
    """kind "byte": byte-level BPE in which a space opens a piece. kind "word": white space dropped, case folded."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.size = 1 << 18
        self.keys = np.zeros(self.size, np.uint64)
        self.slots = np.full(self.size, -1, np.int32)
        self.count = 0
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, self.dtype)

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        space = _SPACE[data]
        cut = np.zeros(n + 1, bool)
        if n > 1:
            before, after = data[:-1], data[1:]
            inner = _LETTER[before] & _STOP[after]
            if self.kind == "word":
                inner |= space[:-1] != space[1:]
            else:
                blank = after == 0x20
                inner[:-1] |= blank[:-1] & _AFTER[data[2:]]
                inner |= space[1:] & ~blank & _PLAIN[before]
                inner |= space[:-1] & (before != 0x20) & _AFTER[after]
            cut[1:n] = inner
        cut[offsets] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        if self.kind == "word":
            keep = ~space[start]
            start, end = start[keep], end[keep]
        return start, end

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.size - 1)
        at = (h & mask).astype(np.int64)
        found = np.full(len(h), -1, np.int32)
        left = np.arange(len(h))
        while len(left):
            slot = self.slots[at[left]]
            hit = (slot >= 0) & (self.keys[at[left]] == h[left])
            found[left[hit]] = slot[hit]
            left = left[(slot >= 0) & ~hit]
            at[left] = (at[left] + 1) & (self.size - 1)
        return found

    def _put(self, h: np.ndarray, entry: np.ndarray) -> None:
        at = (h & np.uint64(self.size - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.slots[at[left]] < 0
            take = left[free]
            self.slots[at[take]] = entry[take]
            self.keys[at[take]] = h[take]
            won = self.slots[at[take]] == entry[take]
            left = np.concatenate([left[~free], take[~won]])
            at[left] = (at[left] + 1) & (self.size - 1)

    def _add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        n = len(h)
        if 2 * (self.count + n) > self.size:
            old = self.slots >= 0
            keys, slots = self.keys[old], self.slots[old]
            while 2 * (self.count + n) > self.size:
                self.size *= 4
            self.keys = np.zeros(self.size, np.uint64)
            self.slots = np.full(self.size, -1, np.int32)
            self._put(keys, slots)
        if self.count + n > len(self.start):
            grow = max(self.count + n, 2 * len(self.start))
            self.start, self.length = np.resize(self.start, grow), np.resize(self.length, grow)
        lengths = np.fromiter(map(len, ids), np.int32, n)
        flat = np.fromiter((x for row in ids for x in row), self.dtype, int(lengths.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.used + len(flat), 2 * len(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        self.length[self.count : self.count + n] = lengths
        self.start[self.count : self.count + n] = self.used + np.cumsum(lengths) - lengths
        self._put(h, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count += n
        self.used += len(flat)

    def _encode_pieces(self, strings: list[str]) -> list[list[int]]:
        """Ids of each piece: a plain word goes to the merges at once, the rest through the whole tokenizer."""
        plain, word, model = _WORD.fullmatch, self.kind == "word", self.tokenizer.model.tokenize
        ids: list = []
        other = []
        for i, s in enumerate(strings):
            if plain(s):
                if word:
                    s = s.lower()
                ids.append([t.id for t in model(s.encode().decode("latin-1").translate(_BYTE_CHARS))])
            else:
                other.append(i)
                ids.append(None)
        for k in range(0, len(other), 4096):
            some = other[k : k + 4096]
            found = self.tokenizer.encode_batch_fast([strings[i] for i in some], add_special_tokens=False)
            for i, e in zip(some, found, strict=True):
                ids[i] = e.ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and for each row where its ids begin (with the end)."""
        start, end = self.pieces(data, offsets)
        h = SpanHash(data, FOLDED if self.kind == "word" else EXACT)(start, end)
        found = self._find(h)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            if self.count + len(new) > MAX_PIECES:
                self.clear()
                missing = np.arange(len(h))
                new, first = np.unique(h, return_index=True)
            text = data.tobytes()
            some = missing[first]
            strings = [text[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)]
            self._add(new, self._encode_pieces(strings))
            found[missing] = self._find(h[missing])
        length = self.length[found].astype(np.int64)
        at = np.concatenate(([0], np.cumsum(length)))
        ids = self.pool[np.repeat(self.start[found] - at[:-1], length) + np.arange(at[-1])]
        return ids, at[np.searchsorted(start, offsets)]


_KEPT = "_sparkolyte_tokenizers"


def tokenizer(path: str, kind: str) -> CachedTokenizer:
    """This worker's tokenizer for a vocabulary file."""
    kept = sys.modules.setdefault(_KEPT, type(sys)(_KEPT)).__dict__
    if (path, kind) not in kept:
        kept[path, kind] = CachedTokenizer(path, kind)
    return kept[path, kind]


def encode_column(column: pa.Array, path: str, kind: str, end_id: int):
    """For each row its ids followed by end_id."""
    coder = tokenizer(path, kind)
    for _, _, data, offsets in text_chunks(column):
        ids, at = coder.encode(data, offsets)
        ids = np.insert(ids if end_id <= np.iinfo(ids.dtype).max else ids.astype(np.uint32), at[1:], end_id)
        at = at + np.arange(len(at))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield ids[a:b]
