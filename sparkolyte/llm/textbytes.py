"""Vectorised kernels over the UTF-8 buffer of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def fold_table(seed: int = 7, lower: bool = True) -> np.ndarray:
    """A random 64-bit value for each byte, A-Z sharing those of a-z when lower."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


FOLDED = fold_table()
EXACT = fold_table(lower=False)


def class_table(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    flags = np.ones(256, bool)
    flags[list(separators)] = False
    return flags


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            globals()[name] = np.multiply.accumulate(row)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit (splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, equal for equal spans wherever they lie."""

    def __init__(self, data: np.ndarray, values: np.ndarray = EXACT):
        self.power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * self.power[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their bytes and row offsets, up to limit bytes at once; nulls are empty texts."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; words never cross rows."""
    flags = is_word[data]
    n = len(flags)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = flags.copy()
    start[1:] &= ~flags[:-1] | edge[1:n]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


#: Words are runs of anything but white space.
WORD = class_table(b"\x20\x09\x0a\x0b\x0c\x0d")
