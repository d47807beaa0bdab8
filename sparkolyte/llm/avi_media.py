"""Media columns: AVI files of motion-JPEG frames, their index, intra frames, shots and clips.

Bytes are stored as 8-bit grey samples in frames of 64 columns and at most 32 rows, each a lossless JPEG (ITU-T
T.81 process 14, SOF3, predictor 1) under a Huffman table made for the file. A RIFF header, a movi list and an idx1
index hold the frames; an INFO chunk holds the lengths. Reading goes by the index, or by the movi list of a file
without one, decodes every frame by its own tables, and cuts shots where the histogram difference to the frame before
exceeds an adaptive threshold: mean + 2.5 deviations of the shot's earlier differences, 0.1 at least. Clips are the
shots with their times at the header's rate. All lossless scans of some files are decoded side by side, one sample of
each at a time. Files of other writers are read if their frames are lossless with predictor 1 or baseline (SOF0, SOF1;
of colour frames the luma, with the standard's tables where a frame has none).

Null and empty texts become one row of 64 zero samples. Bytes that are no AVI file, that end early or hold frames of
another kind give a row with `error` and nulls (read_avi raises ValueError). Rows that repeat are stored each for
itself; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WIDTH, HEIGHT, RATE = 64, 32, 25
UNIT = 64
#: Bytes of files read at once; a longer file is read alone. Scans decoded side by side.
READ_BYTES = 1 << 22
SCANS = 4096

# Zigzag order, and the tables of ITU-T T.81 annex K that frames without tables of their own go by, as
# numbers of codes of 1 to 16 bits and their symbols.
ZIGZAG = [x * 8 + y if t % 2 else y * 8 + x for t in range(15) for x in range(8) for y in [t - x] if 0 <= y < 8]
_AC_LUMA = bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a")
_AC_CHROMA = bytes.fromhex("000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a")
# The longest codes go to the symbols that are left, in order.
_rest = lambda first: [r << 4 | k for r in range(2, 16) for k in range(1, 11) if r << 4 | k not in first]
STANDARD = {
    (0, 0): ([0, 1, 5, 1, 1, 1, 1, 1, 1] + [0] * 7, list(range(12))),
    (0, 1): ([0, 3] + [1] * 9 + [0] * 5, list(range(12))),
    (1, 0): ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], [*_AC_LUMA, *_rest(_AC_LUMA)]),
    (1, 1): ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], [*_AC_CHROMA, *_rest(_AC_CHROMA)]),
}


def _codes(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> dict[int, tuple[int, int]]:
    """Canonical codes: symbol to (code, length); lengths[i] codes have i + 1 bits."""
    out, code, k = {}, 0, 0
    for i, n in enumerate(lengths):
        for _ in range(n):
            out[symbols[k]] = (code, i + 1)
            code += 1
            k += 1
        code <<= 1
    return out


def huffman_table(counts: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Lengths and symbols of a Huffman code; a further symbol of no count keeps the code of all ones free."""
    heap = [(c, -s, [s]) for s, c in enumerate(counts) if c] + [(0, 1, [-1])]
    heapq.heapify(heap)
    bits = dict.fromkeys(range(-1, len(counts)), 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            bits[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    order = sorted((b, s < 0, s) for s, b in bits.items() if b)
    lengths = [0] * 16
    for b, spare, _ in order:
        lengths[b - 1] += not spare
    return tuple(lengths), tuple(s for _, spare, s in order if not spare)


@lru_cache(4096)
def _encoder(lengths: tuple[int, ...], symbols: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each difference of -255 to 255."""
    codes = _codes(lengths, symbols)
    value, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        if s in codes:
            value[d + 255] = codes[s][0] << s | (d if d > 0 else d + (1 << s) - 1)
            size[d + 255] = codes[s][1] + s
    return value, size


_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def _packed(value: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The bits of each row, filled up with ones to whole bytes."""
    ends = np.cumsum(size, axis=1)
    words = (ends[:, -1] >> 6) + 1
    base = np.cumsum(words) - words
    at = (ends - size + (base << 6)[:, None]).ravel()
    value, size = value.ravel(), size.ravel()
    word, room = at >> 6, 64 - (at & 63) - size
    fits = room >= 0
    shift = np.abs(room).astype(np.uint64)
    here = np.where(fits, value << shift, value >> shift)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat(here, first)
    over = np.flatnonzero(~fits)
    out[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    data = out.astype(">u8").tobytes()
    rows = []
    for b, n in zip((base * 8).tolist(), ends[:, -1].tolist(), strict=True):
        row = data[b : b + (n + 7 >> 3)]
        rows.append(row[:-1] + bytes([row[-1] | (1 << (-n & 7)) - 1]))
    return rows


def jpeg_frames(samples: np.ndarray) -> list[bytes]:
    """Lossless JPEG files of frames (n, rows, columns), under one table made for them."""
    n, rows, columns = samples.shape
    x = samples.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    d = d.reshape(n, -1) + 255
    lengths, symbols = huffman_table(np.bincount(_CATEGORY[d.ravel()], minlength=9).tolist())
    value, size = _encoder(lengths, symbols)
    head = b"\xff\xd8\xff\xc4" + struct.pack(">H", 2 + 1 + 16 + len(symbols)) + bytes([0, *lengths, *symbols])
    head += b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, rows, columns, 1) + b"\x01\x11\x00"
    head += b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
    return [head + row.replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in _packed(value[d], size[d])]


@dataclass
class Jpeg:
    """A parsed frame. components: id to (columns of blocks, rows of blocks, quantiser); scan: (id, DC, AC table)."""

    process: int = -1
    rows: int = 0
    columns: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    tables: dict[tuple[int, int], tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)
    data: bytes = b""


def read_jpeg(file: bytes) -> Jpeg:
    """The frame's header, tables and first scan; ValueError for anything but lossless and baseline frames."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    out, at = Jpeg(), 2
    while True:
        if at + 4 > len(file) or file[at] != 0xFF:
            raise ValueError("a JPEG frame ends early")
        marker, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4])
        body = file[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise ValueError("a JPEG frame ends early")
        at += 2 + size
        try:
            if marker == 0xC4:
                k = 0
                while k < len(body):
                    lengths = tuple(body[k + 1 : k + 17])
                    symbols = tuple(body[k + 17 : k + 17 + sum(lengths)])
                    if len(lengths) < 16 or len(symbols) < sum(lengths):
                        raise ValueError("a Huffman table ends early")
                    out.tables[body[k] >> 4, body[k] & 15] = (lengths, symbols)
                    k += 17 + len(symbols)
            elif marker == 0xDB:
                k = 0
                while k < len(body):
                    wide = body[k] >> 4
                    out.quantisers[body[k] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1).astype(np.int64)
                    k += 1 + (128 if wide else 64)
            elif marker in (0xC0, 0xC1, 0xC3):
                bits, out.rows, out.columns, n = struct.unpack(">BHHB", body[:6])
                if bits != 8 or not out.rows or not out.columns:
                    raise ValueError("not a frame of 8-bit samples")
                out.process = marker
                for c in range(n):
                    name, factor, q = body[6 + 3 * c : 9 + 3 * c]
                    out.components[name] = (factor >> 4, factor & 15, q)
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("neither a lossless nor a baseline JPEG frame")
            elif marker == 0xDD:
                out.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                out.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
                end = file.rfind(b"\xff\xd9")
                if end < at or out.process < 0:
                    raise ValueError("a JPEG frame ends early")
                out.data = file[at:end]
                if out.process == 0xC3 and (len(out.scan) != 1 or body[3] != 1 or out.restart):
                    raise ValueError("a lossless frame of another kind than predictor 1")
                return out
        except (struct.error, IndexError) as e:
            raise ValueError("a JPEG frame ends early") from e


def _lookup(table: tuple[tuple[int, ...], tuple[int, ...]], width: int) -> np.ndarray:
    """By the next width bits: length of the code << 8 | symbol; 0 where no code begins so."""
    out = np.zeros(1 << width, np.int64)
    for s, (code, size) in _codes(*table).items():
        if code >> size:
            raise ValueError("a Huffman table with too many codes")
        out[code << (width - size) : (code + 1) << (width - size)] = size << 8 | s
    return out


def _depth(table: tuple[tuple[int, ...], tuple[int, ...]]) -> int:
    return max((i + 1 for i, n in enumerate(table[0]) if n), default=1)


def lossless_samples(frames: list[Jpeg]) -> list[np.ndarray | None]:
    """Samples (rows, columns) of lossless frames, None where a scan ends early; all scans go on side by side."""
    out: list[np.ndarray | None] = [None] * len(frames)
    tables: dict = {}
    for f in frames:
        tables.setdefault(f.tables.get((0, f.scan[0][1]), ((0,) * 16, ())), len(tables))
    width = max(map(_depth, tables), default=1)
    codes = np.concatenate([_lookup(t, width) for t in tables]) if tables else np.zeros(0, np.int64)
    if ((codes & 255) > 8).any():
        return out
    mask = np.uint32((1 << width) - 1)
    order = sorted(range(len(frames)), key=lambda i: -frames[i].rows * frames[i].columns)
    for k in range(0, len(order), SCANS):
        some = [frames[i] for i in order[k : k + SCANS]]
        scans = [f.data.replace(b"\xff\x00", b"\xff") for f in some]
        flat = np.frombuffer(b"".join(s + b"\0\0\0\0" for s in scans) + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = flat[:-3] << np.uint32(24) | flat[1:-2] << np.uint32(16) | flat[2:-1] << np.uint32(8) | flat[3:]
        size = np.array([len(s) for s in scans])
        begin = np.cumsum(size + 4) - size - 4
        bit, last = begin * 8, (begin + size) * 8
        table = np.array([tables[f.tables.get((0, f.scan[0][1]), ((0,) * 16, ()))] for f in some]) << width
        samples = np.array([f.rows * f.columns for f in some])
        difference = np.zeros((int(samples[0]), len(some)), np.int16)
        good = np.ones(len(some), bool)
        alive = len(some) - np.searchsorted(samples[::-1], np.arange(int(samples[0])), "right")
        for i, n in enumerate(alive.tolist()):
            at = bit[:n]
            seen = window[np.minimum(at >> 3, len(window) - 1)]
            skip = (at & 7).astype(np.uint32)
            found = codes[table[:n] + ((seen >> (np.uint32(32 - width) - skip)) & mask)]
            category = (found & 255).astype(np.uint32)
            length = (found >> 8).astype(np.uint32)
            low = ((seen << (skip + length)) >> np.uint32(1)) >> (np.uint32(31) - category)
            value = low.astype(np.int32)
            negative = (low << np.uint32(1)) >> category == 0
            value -= np.where(negative, (np.int32(1) << category.astype(np.int32)) - 1, 0)
            difference[i, :n] = value
            good[:n] &= found > 0
            bit[:n] = at + np.maximum(length + category, 1)
        good &= bit <= last
        for j, f in enumerate(some):
            if good[j]:
                d = difference[: samples[j], j].reshape(f.rows, f.columns).copy()
                d[0, 0] += 128
                d[:, 0] = np.cumsum(d[:, 0], dtype=np.int16)
                out[order[k + j]] = np.cumsum(d, axis=1, dtype=np.int16).astype(np.uint8)
    return out


_COSINE = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.125**0.5) for x in range(8)] for u in range(8)])


def baseline_luma(frame: Jpeg) -> np.ndarray:
    """The first component's samples (rows, columns) of a baseline frame."""
    names = list(frame.components)
    if not frame.scan or any(c not in frame.components for c, _, _ in frame.scan) or len(frame.scan) != len(names):
        raise ValueError("a baseline frame of several scans")
    wide = max(h for h, _, _ in frame.components.values())
    high = max(v for _, v, _ in frame.components.values())
    single = len(names) == 1
    across, down = (1, 1) if single else (wide, high)
    columns, rows = -(-frame.columns // (8 * across)), -(-frame.rows // (8 * down))
    look = {}
    for _, dc, ac in frame.scan:
        for key in ((0, dc), (1, ac)):
            look[key] = _lookup(frame.tables.get(key) or tuple(map(tuple, STANDARD[key[0], min(key[1], 1)])), 16).tolist()
    first = frame.scan[0][0]
    h0, v0, q0 = frame.components[first]
    h0, v0 = (1, 1) if single else (h0, v0)
    if not h0 or not v0 or q0 not in frame.quantisers:
        raise ValueError("a baseline frame without factors or quantisers")
    blocks = np.zeros((rows * v0, columns * h0, 64), np.int64)
    parts, k = [], 0
    while True:
        nxt = next((i for i in range(k, len(frame.data) - 1) if frame.data[i] == 0xFF and 0xD0 <= frame.data[i + 1] <= 0xD7), None)
        if nxt is None:
            parts.append(frame.data[k:])
            break
        parts.append(frame.data[k:nxt])
        k = nxt + 2
    units = rows * columns
    each = frame.restart or units
    for part, start in zip(parts, range(0, units, each), strict=False):
        data = part.replace(b"\xff\x00", b"\xff")
        bits, n, at = int.from_bytes(data + b"\0" * 8), 8 * len(data) + 64, 0
        before = dict.fromkeys(names, 0)

        def take(size: int) -> int:
            nonlocal at
            at += size
            if at > n - 64:
                raise ValueError("a JPEG scan ends early")
            return bits >> (n - at) & (1 << size) - 1

        def symbol(table: list[int]) -> int:
            nonlocal at
            found = table[bits >> (n - at - 16) & 0xFFFF] if at <= n - 64 else 0
            if not found:
                raise ValueError("a JPEG scan without a code")
            at += found >> 8
            return found & 255

        def number(size: int) -> int:
            value = take(size) if size else 0
            return value if not size or value >> (size - 1) else value - (1 << size) + 1

        for unit in range(start, min(units, start + each)):
            y, x = divmod(unit, columns)
            for name, dc, ac in frame.scan:
                h, v, _ = frame.components[name]
                for by in range(1 if single else v):
                    for bx in range(1 if single else h):
                        before[name] += number(symbol(look[0, dc]))
                        place = {0: before[name]}
                        k = 1
                        while k < 64:
                            found = symbol(look[1, ac])
                            run, size = found >> 4, found & 15
                            if not size:
                                if run < 15:
                                    break
                                k += 16
                                continue
                            k += run
                            if k > 63:
                                raise ValueError("a JPEG block of more than 64 values")
                            place[k] = number(size)
                            k += 1
                        if name == first:
                            block = blocks[y * v0 + by, x * h0 + bx]
                            for i, value in place.items():
                                block[i] = value
    natural = np.zeros_like(blocks)
    natural[..., ZIGZAG] = blocks * frame.quantisers[q0]
    square = natural.reshape(*blocks.shape[:2], 8, 8)
    pixels = np.einsum("vy,ijvu,ux->iyjx", _COSINE, square, _COSINE).reshape(rows * v0 * 8, columns * h0 * 8)
    size = -(-frame.rows * v0 // high) if not single else frame.rows, -(-frame.columns * h0 // wide) if not single else frame.columns
    return np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)[: size[0], : size[1]]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, n_bytes: int) -> bytes:
    """An AVI file of a payload whose length is a positive multiple of 64; n_bytes of it are the text's own."""
    lines = len(payload) // WIDTH
    rows = min(HEIGHT, lines)
    count = -(-lines // rows)
    samples = np.zeros((count, rows, WIDTH), np.uint8)
    samples.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    frames = jpeg_frames(samples)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, count, 0, 1, most, WIDTH, rows, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, count, most, 0, 0, 0, 0, WIDTH, rows)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, rows, 1, 8, b"MJPG", WIDTH * rows, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ISBJ", struct.pack("<QQ", len(payload), n_bytes)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    return _chunk(b"RIFF", b"AVI " + header + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    """Frame files of a video, payload length and own length where the file tells, microseconds of a frame."""

    frames: list[bytes]
    lengths: tuple[int, int] | None
    frame_us: int


def _in_movi(media: bytes, at: int, end: int) -> list[bytes]:
    """Frames of a movi list, in order."""
    out = []
    while at + 8 <= end:
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"LIST":
            out += _in_movi(media, at + 12, min(end, at + 8 + size))
        elif name[2:] in (b"dc", b"db"):
            if at + 8 + size > len(media):
                raise ValueError("an AVI file ends early")
            out.append(media[at + 8 : at + 8 + size])
        at += 8 + size + (size & 1)
    return out


def split_avi(media: bytes) -> Avi:
    """The frames of an AVI file by its idx1 index, or in the order of its movi list; ValueError for other bytes."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, movi, index, lengths, frame_us = 12, None, b"", None, 1_000_000 // RATE
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        kind = media[at + 8 : at + 12]
        if name == b"LIST" and kind == b"movi":
            movi = at + 8, min(len(media), at + 8 + size)
        elif name == b"LIST" and kind == b"hdrl" and media[at + 12 : at + 16] == b"avih" and at + 24 <= len(media):
            frame_us = int.from_bytes(media[at + 20 : at + 24], "little") or frame_us
        elif name == b"LIST" and kind == b"INFO" and media[at + 12 : at + 16] == b"ISBJ" and size == 28 and at + 36 <= len(media):
            lengths = struct.unpack("<QQ", media[at + 20 : at + 36])
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
            if len(index) < size:
                raise ValueError("an AVI file ends early")
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("an AVI file without frames")
    frames = []
    for k in range(0, len(index) - 15, 16):
        name, _, place, size = struct.unpack("<4sIII", index[k : k + 16])
        if name[2:] not in (b"dc", b"db"):
            continue
        # Places count from the movi list, in some files from the start of the file.
        start = next((s for s in (movi[0] + place, place) if media[s : s + 4] == name), None)
        if start is None or start + 8 + size > len(media):
            raise ValueError("an AVI index that leads nowhere")
        frames.append(media[start + 8 : start + 8 + size])
    frames = frames or _in_movi(media, movi[0] + 4, movi[1])
    if not frames:
        raise ValueError("an AVI file without frames")
    return Avi(frames, lengths, frame_us)


def decode_frames(files: list[bytes]) -> list[np.ndarray]:
    """Samples (rows, columns) of each JPEG file."""
    frames = [read_jpeg(f) for f in files]
    whole = iter(lossless_samples([f for f in frames if f.process == 0xC3]))
    out = [next(whole) if f.process == 0xC3 else baseline_luma(f) for f in frames]
    if any(x is None for x in out):
        raise ValueError("a JPEG scan ends early")
    return out


def read_avi(media: bytes) -> tuple[list[np.ndarray], int, int]:
    """Frames, payload length and the text's own length."""
    avi = split_avi(media)
    samples = decode_frames(avi.frames)
    held = sum(x.size for x in samples)
    payload, own = avi.lengths or (held, held)
    return samples, payload, own


def histograms(samples: list[np.ndarray]) -> np.ndarray:
    """Shares of 16 grey levels in each frame."""
    n, size = len(samples), np.array([x.size for x in samples])
    level = (np.concatenate([x.ravel() for x in samples]) >> 4).astype(np.int64) + 16 * np.repeat(np.arange(n), size)
    return np.bincount(level, minlength=16 * n).reshape(n, 16) / size[:, None]


def shots(hist: np.ndarray) -> list[int]:
    """First frames of the shots."""
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    starts, n, mean, square = [0], 0, 0.0, 0.0
    for t, d in enumerate(change.tolist(), 1):
        deviation = (square / n) ** 0.5 if n > 1 else 0.0
        if d > max(0.1, mean + 2.5 * deviation):
            starts.append(t)
            n, mean, square = 0, 0.0, 0.0
            continue
        n += 1
        step = d - mean
        mean += step / n
        square += step * (d - mean)
    return starts


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: dict[bytes, bytes] = {}
        media = []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            text = text or b""
            if text not in made:
                made[text] = write_avi(text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT)), len(text))
            media.append(made[text])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])


_CLIPS = pa.list_(
    pa.struct(
        [
            ("clip", pa.int32()),
            ("first_frame", pa.int64()),
            ("last_frame", pa.int64()),
            ("start_ms", pa.int64()),
            ("end_ms", pa.int64()),
        ]
    )
)
_READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, n_frames long, mean_histogram array<double>, "
    "clips array<struct<clip:int,first_frame:bigint,last_frame:bigint,start_ms:bigint,end_ms:bigint>>, error string"
)


def _features(media: bytes, avi: Avi, samples: list[np.ndarray]) -> tuple:
    data = b"".join(x.tobytes() for x in samples)
    size, own = avi.lengths or (len(data), len(data))
    if size > len(data) or own > size:
        raise ValueError("an AVI file of fewer samples than it says")
    payload = data[:size]
    hist = histograms(samples)
    first = shots(hist)
    last = [*(f - 1 for f in first[1:]), len(samples) - 1]
    clips = [
        {"clip": k, "first_frame": a, "last_frame": b, "start_ms": a * avi.frame_us // 1000, "end_ms": (b + 1) * avi.frame_us // 1000}
        for k, (a, b) in enumerate(zip(first, last, strict=True))
    ]
    return (
        own,
        size,
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-UNIT:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        len(samples),
        hist.mean(axis=0).tolist(),
        clips,
        None,
    )


def read_files(files: list[bytes | None]) -> list[tuple]:
    """Features of each AVI file, or nulls and what is wrong with it. Lossless frames of all files go side by side."""
    out: list[tuple] = [()] * len(files)
    parsed: dict[int, tuple[Avi, list[Jpeg]]] = {}

    def wrong(i: int, e: Exception) -> None:
        media = files[i]
        known = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
        out[i] = (None, None, None, None, *known, None, None, None, str(e))

    for i, media in enumerate(files):
        try:
            if media is None:
                raise ValueError("no file")
            avi = split_avi(media)
            parsed[i] = avi, [read_jpeg(f) for f in avi.frames]
        except ValueError as e:
            wrong(i, e)
    try:
        lossless = iter(lossless_samples([f for _, frames in parsed.values() for f in frames if f.process == 0xC3]))
    except ValueError:
        # A bad table stops the joint scan; each file is then read by itself.
        lossless = None
    for i, (avi, frames) in parsed.items():
        try:
            if lossless is None:
                samples = decode_frames(avi.frames)
            else:
                some = [next(lossless) if f.process == 0xC3 else f for f in frames]
                samples = [baseline_luma(x) if isinstance(x, Jpeg) else x for x in some]
            if any(x is None for x in samples):
                raise ValueError("a JPEG scan ends early")
            out[i] = _features(files[i], avi, samples)
        except ValueError as e:
            wrong(i, e)
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float64()), _CLIPS, pa.string()]
    names = [x.split()[0] for x in _READ.split(", ")]
    for batch in batches:
        files, rows, at = batch.column(1).to_pylist(), [], 0
        while at < len(files):
            end, held = at, 0
            while end < len(files) and (end == at or held < READ_BYTES):
                held += len(files[end] or b"")
                end += 1
            rows += read_files(files[at:end])
            at = end
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id and media (an AVI file) of each document (doc_id, text)."""
    shared.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _write, "doc_id long, media binary"
    )


def read_media(media: DataFrame) -> DataFrame:
    """Payload digests, frame histograms and clips of AVI files (doc_id, media), and the error of those that can't be read."""
    shared.prepare(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_read, _READ)


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per clip: doc_id, clip, first_frame, last_frame, start_ms, end_ms."""
    return read.select("doc_id", F.inline("clips"))
