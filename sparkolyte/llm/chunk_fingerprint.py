"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes marks boundaries; the mask is strict before the normal length and loose after
it, so lengths stay near the normal one and an edit moves only the boundaries beside it. A fingerprint is the set
of (32-bit digest, length) of a text's chunks, as base64 of six bytes each in ascending order. The likeness of one
fingerprint to another is the share of its length whose chunks the other has too.

Null text is empty. An empty text has the fingerprint "", like only to another empty one (1.0). The next document
is the next row in descending doc_id, rows that share an id by text, null ids last; after the last row comes the
first, so a lone row is followed by itself. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbytes import SpanHash, text_chunks

SHORTEST, NORMAL, LONGEST = 32, 128, 512
STRICT_BITS, LOOSE_BITS = 9, 5
_GEAR = np.random.default_rng(9).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The sum of gear[b] << age over the last 32 bytes at each place, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] += h[:-step].copy() << np.uint32(step)
    return h


def chunk_ends(strict: list[int], loose: list[int], start: int, end: int) -> list[int]:
    """Where the chunks of the text start..end end."""
    ends = []
    i = bisect_left(strict, start)
    j = bisect_left(loose, start)
    n, m = len(strict), len(loose)
    while start < end:
        low, mid, high = start + SHORTEST - 1, min(start + NORMAL, end), min(start + LONGEST, end)
        while i < n and strict[i] < low:
            i += 1
        if i < n and strict[i] < mid:
            start = strict[i] + 1
        else:
            if mid < high:
                j = bisect_left(loose, mid, j)
            start = loose[j] + 1 if mid < high and j < m and loose[j] < high else high
        ends.append(start)
    return ends


def fingerprints(texts: list[str]) -> list[set[int]]:
    """For each text its set of digest << 16 | length."""
    out: list[set[int]] = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.large_string())):
        h = gear(data)
        loose = np.flatnonzero(h >> np.uint32(32 - LOOSE_BITS) == 0)
        strict = loose[h[loose] >> np.uint32(32 - STRICT_BITS) == 0].tolist()
        loose = loose.tolist()
        at = offsets.tolist()
        ends, bounds = [], [0]
        for a, b in zip(at[:-1], at[1:], strict=True):
            ends += chunk_ends(strict, loose, a, b)
            bounds.append(len(ends))
        ends = np.array(ends, np.int64)
        # Texts lie side by side, so a chunk starts where the one before it ends.
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        digest = SpanHash(data)(starts, ends) >> np.uint64(32)
        keys = (digest << np.uint64(16) | (ends - starts).astype(np.uint64)).tolist()
        out += [set(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def encode(chunks: set[int]) -> str:
    return base64.b64encode(b"".join(k.to_bytes(6) for k in sorted(chunks))).decode()


def likeness(one: set[int], other: set[int]) -> float:
    if not one:
        return 0.0 if other else 1.0
    return sum(k & 0xFFFF for k in one & other) / sum(k & 0xFFFF for k in one)


def _finished(rows: list[tuple], texts: list[str], prints: list[set[int]]) -> list[tuple]:
    """rows: doc_id of each text; the text after each is texts[i + 1]."""
    edited = []
    for text, after in zip(texts[:-1], texts[1:], strict=True):
        k = len(text) // 3
        edited.append(text[: len(text) - k] + after[:k])
    changed = fingerprints(edited)
    return [
        (
            doc,
            len(text),
            hashlib.sha256(new.encode()).hexdigest(),
            encode(own),
            encode(other),
            likeness(own, other),
            likeness(own, after),
        )
        for doc, text, new, own, other, after in zip(rows, texts[:-1], edited, prints[:-1], changed, prints[1:], strict=True)
    ]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()

    def out(rows: list[tuple], role: str, text: str | None) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _TYPES, strict=True)]
        n = len(rows)
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array([part] * n, pa.int32()), pa.array([role] * n), pa.array([text] * n, pa.string())],
            [*_NAMES, "part", "role", "text"],
        )

    held: tuple | None = None
    for batch in batches:
        docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not docs:
            continue
        prints = fingerprints(texts)
        if held is None:
            yield out([(docs[0], *[None] * 6)], "head", texts[0])
        else:
            docs, texts, prints = [held[0], *docs], [held[1], *texts], [held[2], *prints]
        yield out(_finished(docs[:-1], texts, prints), "row", None)
        held = docs[-1], texts[-1], prints[-1]
    if held is not None:
        yield out([(held[0], *[None] * 6)], "tail", held[1])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += _finished([doc], [text, after], fingerprints([text, after]))
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text, and their likeness; see the module."""
    spark = shared.prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").asc()]
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, order[0])
        .sortWithinPartitions(*order)
    )
    rows = shared.materialize(ordered.mapInArrow(_stream, f"{_OUT}, part int, role string, text string"), "fingerprints")
    # Two rows per partition, so their numbers fit the driver whatever the input.
    heads = sorted(r[0] for r in rows.where("role = 'head'").select("part").collect())
    after = spark.createDataFrame(
        [(p, heads[(i + 1) % len(heads)]) for i, p in enumerate(heads)], "part int, next_part int"
    )
    tails = rows.where("role = 'tail'").select("doc_id", "text", "part").join(F.broadcast(after), "part")
    firsts = rows.where("role = 'head'").select(F.col("part").alias("next_part"), F.col("text").alias("after"))
    ends = tails.join(firsts, "next_part").select("doc_id", "text", "after").mapInArrow(_ends, _OUT)
    return rows.where("role = 'row'").select(*_NAMES).unionByName(ends)
