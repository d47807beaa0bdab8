"""Packing by lexical retrieval.

Documents become token ids with an end id. Whole windows are cut from the front of long documents; what remains is
packed shard by shard: a shard's inverted index holds the BM25 weights of all its documents' words. Each seed asks the
index with all its words for its unused neighbours, which fill its window in order of score (the earlier in the shard
of equal ones); the first that fits whole goes in, else the best one is cut to the space and its rest stays to be
packed. The last window of a shard is cut into sequences whose lengths are powers of two, so nothing is padded.

Documents reach their shards by content. Of the words in each of four ranges of document frequency, from those that
a quarter of the documents have down to the rarest, the least by hash is a key; documents are dealt out in the order
of these keys, so that those alike in words lie side by side, and a shard is SHARD_DOCS documents or SHARD_BYTES of
text in a row. Copies of one text, however many, are dealt on by doc_id. A neighbour in another shard is not seen; the
README gives the measured recall.

Document frequencies and the mean length cover all documents and are exact, but for words whose hashes of 48 bits are
equal, for the ranges as for the scores. A first pass fills a count-min sketch, which never falls short; a second one
counts the words that may lie in a range by it, and every task gets the count of each that does. The words below all
ranges are counted by a shuffle of the words alone, and a partition of the packing gets the counts of those that two
of its documents have; the others score nobody.

Null text is empty: one piece with the end id. Rows that repeat are documents of their own, a null doc_id too. An
empty table gives no rows. Sequence ids count from partition << 32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .cached_tokens import tokenizer
from .textbytes import FOLDED, WORD, SpanHash, mix, text_chunks

WINDOW = 1024
SHARD_DOCS = 1024
SHARD_BYTES = 1 << 23
#: Bytes of text in a partition of the packing, about; each is some shards long. Documents per partition, about, whose
#: keys the driver sees to set the partitions' bounds.
PART_BYTES, BOUND_SAMPLE = 1 << 26, 64
#: Rows and width of the sketch of document frequencies. The driver gets it and the words that lie in a range.
SKETCH_ROWS, SKETCH_BITS = 3, 18
SLICES = 8
#: Bits of a word's hash; the others of a key tell rows of a batch apart.
WORD_BITS = 48
NEIGHBOURS = 16
K1, B = 1.2, 0.75
#: Ranges of document frequency, as shares of all documents, that give a routing key each; rarer words and those of a
#: single document are the last.
RANGES = ((1 / 64, 1 / 4), (1 / 1024, 1 / 64), (1 / 4096, 1 / 1024))
#: Words that more documents of a shard have are scored by one matrix product, the others by their postings.
DENSE = 64
#: Bytes of text whose words are found at once, few enough to stay in a core's cache.
WORD_CHUNK = 1 << 17
#: Longest words, in bytes, that are hashed block by block.
BLOCK_BYTES = 64
#: Words that a counter holds back before it adds them to its sketch, and that one of exact counts does.
HELD_WORDS, COUNTED_WORDS = 1 << 18, 1 << 21
_IN_WORD = WORD.astype(np.uint8).tobytes()
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _words(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each; as find_words, without a table look-up per byte in NumPy."""
    flags = np.zeros(len(raw) + 2, bool)
    flags[1:-1] = np.frombuffer(raw.translate(_IN_WORD), bool)
    at = np.flatnonzero(flags[1:] != flags[:-1])
    start, end = at[::2], at[1::2]
    # Words of two rows that meet.
    cut = np.unique(offsets[1:-1])
    cut = cut[flags[cut] & flags[cut + 1]]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))


def _word_hashes(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, A-Z as a-z, eight bytes at once; words of more than BLOCK_BYTES by their rolling sums."""
    eight = np.ndarray(len(raw) + 1, "<u8", raw.lower() + bytes(8), strides=(1,))
    size = end - start
    h = mix((eight[start] & _FIRST[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < BLOCK_BYTES:
        block = eight[start[more] + k] & _FIRST[np.minimum(size[more] - k, 8)]
        h[more] = mix(h[more] ^ block * np.uint64(0xD6E8FEB86659FD93))
        k += 8
        more = more[size[more] > k]
    if len(more):
        h[more] = SpanHash(np.frombuffer(raw, np.uint8), FOLDED)(start[more], end[more])
    return h


def term_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, word hash (WORD_BITS) and count of each distinct word of each row, and the rows' word counts."""
    raw = data.tobytes()
    start, end, row = _words(raw, offsets)
    word = _word_hashes(raw, start, end) >> np.uint64(64 - WORD_BITS)
    key = np.sort(row.astype(np.uint64) << np.uint64(WORD_BITS) | word)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    lengths = np.bincount(row, minlength=len(offsets) - 1)
    return (key >> np.uint64(WORD_BITS)).astype(np.int64), key & np.uint64((1 << WORD_BITS) - 1), count, lengths


def _cells(word: np.ndarray) -> np.ndarray:
    """The sketch's cell of each word in each of its rows."""
    h = mix(word + np.uint64(1))
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return np.stack([(h >> np.uint64(SKETCH_BITS * r) & mask).astype(np.int64) for r in range(SKETCH_ROWS)])


class _Counter:
    """Sketch of document frequencies, documents and words of one partition."""

    def __init__(self):
        self.sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
        self.docs = self.words = self.n_held = 0
        self.held: list[np.ndarray] = []

    def add(self, word: np.ndarray, lengths: np.ndarray) -> None:
        self.held.append(word)
        self.n_held += len(word)
        self.docs += len(lengths)
        self.words += int(lengths.sum())
        if self.n_held >= HELD_WORDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            for r, cell in enumerate(_cells(np.concatenate(self.held))):
                self.sketch[r] += np.bincount(cell, minlength=1 << SKETCH_BITS)
        self.held, self.n_held = [], 0

    def columns(self) -> list[pa.Array]:
        self.flush()
        slices = self.sketch.astype("<i8").reshape(SLICES, -1)
        return [
            pa.array(np.arange(SLICES), pa.int32()),
            pa.array([s.tobytes() for s in slices], pa.binary()),
            pa.array([self.docs] + [0] * (SLICES - 1), pa.int64()),
            pa.array([self.words] + [0] * (SLICES - 1), pa.int64()),
        ]


_SLICE = "slice int, counts binary, docs long, words long"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = _Counter()
    for batch in batches:
        for _, _, data, offsets in text_chunks(batch.column(0), WORD_CHUNK):
            _, word, _, lengths = term_counts(data, offsets)
            found.add(word, lengths)
    yield pa.RecordBatch.from_arrays(found.columns(), ["slice", "counts", "docs", "words"])


def _add_slices(found: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_ROWS * (1 << SKETCH_BITS) // SLICES, np.int64)
    for blob in found.column("counts"):
        total += np.frombuffer(blob.as_buffer(), "<i8")
    return pa.table(
        {
            "slice": found.column("slice")[:1],
            "counts": pa.array([total.astype("<i8").tobytes()], pa.binary()),
            "docs": pa.array([sum(found.column("docs").to_pylist())], pa.int64()),
            "words": pa.array([sum(found.column("words").to_pylist())], pa.int64()),
        }
    )


def _ascending(word: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(word)
    return word[order], count[order]


class Statistics:
    """Document frequencies, number of documents and of words.

    Frequencies are exact for the words given, which ascend; others have the sketch's, which is never too low, but at
    most others; without a sketch 1.
    """

    def __init__(self, sketch: np.ndarray | None, docs: int, words: int, word=(), count=(), others: float = np.inf):
        self.sketch, self.docs, self.words = None if sketch is None else sketch.astype(np.float32), docs, words
        self.word, self.count, self.others = np.array(word, np.uint64), np.array(count, np.int64), others

    def estimate(self, word: np.ndarray) -> np.ndarray:
        if self.sketch is None:
            return np.ones(len(word))
        found = self.sketch[0][(cells := _cells(word))[0]]
        for r in range(1, SKETCH_ROWS):
            found = np.minimum(found, self.sketch[r][cells[r]])
        return np.minimum(found, self.others)

    def frequency(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return self.estimate(word)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        found = self.count[at].astype(float)
        other = np.flatnonzero(self.word[at] != word)
        found[other] = self.estimate(word[other])
        return found

    def knowing(self, word: np.ndarray, count: np.ndarray) -> Statistics:
        """These with the exact frequencies of more words, and no sketch."""
        word, count = _ascending(np.concatenate([self.word, word.astype(np.uint64)]), np.concatenate([self.count, count]))
        return Statistics(None, self.docs, self.words, word, count)

    def weights(self, row: np.ndarray, word: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """BM25 weight of each word of each row."""
        df = self.frequency(word)
        idf = np.maximum(np.log(1 + (self.docs - df + 0.5) / (df + 0.5)), 0)
        norm = K1 * (1 - B + B * lengths[row] / max(1.0, self.words / max(1, self.docs)))
        return (idf * count * (K1 + 1) / (count + norm)).astype(np.float32)


def _counts(sketched: Statistics, least: float):
    """Words that more than least documents may have, with the number of a task's documents that do; words repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            word, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            for at in range(0, len(word), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[part].astype(np.int64)) for x in (word, count)], ["word", "n"])

        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0), WORD_CHUNK):
                _, word, _, _ = term_counts(data, offsets)
                held.append(word[sketched.estimate(word) > least])
            if sum(map(len, held)) >= COUNTED_WORDS:
                yield from flush()
        if held:
            yield from flush()

    return run


def corpus_statistics(docs: DataFrame) -> Statistics:
    """Statistics of all documents, with the exact frequencies of the words that lie in a range.

    Partitions' slices of the sketch, SLICES rows of a fixed size each, are added up in tasks. The words in a range are
    at most the distinct words of a mean document times one by the least share, whatever the number of documents.
    """
    parts = docs.select("text").mapInArrow(_frequencies, _SLICE)
    rows = sorted(parts.groupBy("slice").applyInArrow(_add_slices, _SLICE).collect())
    sketch = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS))
    if rows:
        sketch = np.concatenate([np.frombuffer(r.counts, "<i8") for r in rows]).reshape(SKETCH_ROWS, -1)
    number, words = sum(r.docs for r in rows), sum(r.words for r in rows)
    least = max(1.0, RANGES[-1][0] * number)
    counted = docs.select("text").mapInArrow(_counts(Statistics(sketch, number, words), least), "word long, n long")
    found = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") > least).toArrow()
    word, count = _ascending(*(found.column(c).to_numpy() for c in ("word", "n")))
    return Statistics(sketch, number, words, word, count, int(least))


def _least(h: np.ndarray, row: np.ndarray, rows: int, largest: np.uint64) -> np.ndarray:
    """The least value of each row; row ascends."""
    out = np.full(rows, largest)
    if len(h):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = np.minimum.reduceat(h, first)
    return out


_KEYS = ["k0", "k1", "k2", "k3"]
_ROUTED = f"doc_id long, text string, {', '.join(f'{k} long' for k in _KEYS)}, copy long, size long, rare array<long>"


def _route(statistics: Statistics):
    """doc_id and text with a key for each range of frequency, a hash of the whole text, its size in bytes and its words
    below all ranges, but for such as no other document has by the sketch. A text without words in a range has the
    largest key.
    """
    names = [c.split()[0] for c in _ROUTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = np.uint64((1 << 63) - 1)
        for batch in batches:
            keys: list[list[np.ndarray]] = [[] for _ in range(len(RANGES) + 3)]
            rare, held = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
            for _, _, data, offsets in text_chunks(batch.column(1), WORD_CHUNK):
                row, word, _, lengths = term_counts(data, offsets)
                keys[-2].append(SpanHash(data)(offsets[:-1], offsets[1:]) >> np.uint64(1))
                keys[-1].append(np.diff(offsets).astype(np.uint64))
                df = statistics.frequency(word)
                h = mix(word ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(1)
                ranges = [(df > low * statistics.docs) & (df <= high * statistics.docs) & (df >= 2) for low, high in RANGES]
                rest = (df < 2) | (df <= RANGES[-1][0] * statistics.docs)
                for out, inside in zip(keys[:-2], [*ranges, rest], strict=True):
                    out.append(_least(np.where(inside, h, largest), row, len(lengths), largest))
                repeated = rest & (df >= 2)
                rare.append(word[repeated])
                held.append(np.bincount(row[repeated], minlength=len(lengths)))
            found = [pa.array(np.concatenate(k).astype(np.int64) if k else np.zeros(0, np.int64)) for k in keys]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum(np.concatenate(held)), pa.int32()), pa.array(np.concatenate(rare).astype(np.int64))
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *found, lists], names)

    return run


class Shard:
    """Documents of one shard with their inverted index."""

    def __init__(self, statistics: Statistics):
        self.statistics = statistics
        self.bytes = 0
        self.doc: list = []
        self.ids: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.terms: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []

    def add(self, row: np.ndarray, word: np.ndarray, count: np.ndarray, lengths: np.ndarray) -> None:
        self.rows.append(row + len(self.doc))
        self.terms.append(word)
        self.weights.append(self.statistics.weights(row, word, count, lengths))

    def index(self) -> None:
        row, weight = np.concatenate(self.rows), np.concatenate(self.weights)
        _, term = np.unique(np.concatenate(self.terms), return_inverse=True)
        n, held = len(self.doc), np.bincount(term)
        # Words that many documents have: all their products at once.
        dense = held > DENSE
        column = np.cumsum(dense) - 1
        here = dense[term]
        matrix = np.zeros((int(dense.sum()), n), np.float32)
        matrix[column[term[here]], row[here]] = weight[here]
        self.common = (matrix > 0).T.astype(np.float32) @ matrix
        # The others by postings; a word of one document scores nobody else.
        few = ~here & (held[term] > 1)
        row, term, weight = row[few], term[few], weight[few]
        self.query_at = np.searchsorted(row, np.arange(n + 1))
        self.query = term
        order = np.argsort(term, kind="stable")
        self.posted, self.weight = row[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(len(held) + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document for all words of the seed."""
        words = self.query[self.query_at[seed] : self.query_at[seed + 1]]
        start, size = self.at[words], self.at[words + 1] - self.at[words]
        places = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        rare = np.bincount(self.posted[places], self.weight[places], minlength=len(self.doc))
        return self.common[seed] + rare.astype(np.float32)

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, length)."""
        if not self.doc:
            return
        self.index()
        size = np.array([len(i) for i in self.ids])
        start = size // WINDOW * WINDOW
        for d in np.flatnonzero(start).tolist():
            for a in range(0, int(start[d]), WINDOW):
                yield [(d, a, WINDOW)]
        left = size - start
        queue = np.argsort(-left, kind="stable").tolist()
        window: list[tuple[int, int, int]] = []
        for seed in queue:
            if not left[seed]:
                continue
            window = [(seed, int(start[seed]), int(left[seed]))]
            space = WINDOW - int(left[seed])
            left[seed] = 0
            score, best = self.scores(seed) if space else None, []
            while space and (left > 0).any():
                best = [d for d in best if left[d] > 0]
                if not best:
                    # The next ones by score, once those asked for are used up.
                    best = nearest(score, left)
                d = next((d for d in best if left[d] <= space), best[0])
                n = min(space, int(left[d]))
                window.append((d, int(start[d]), n))
                start[d] += n
                left[d] -= n
                space -= n
            if space:
                break
            yield window
            window = []
        if window:
            yield from powers_of_two(window)


def nearest(score: np.ndarray, left: np.ndarray) -> list[int]:
    """The NEIGHBOURS best of the documents of which something is left, the earlier first of equal ones."""
    open_ = np.flatnonzero(left > 0)
    s = score[open_]
    if len(s) > NEIGHBOURS:
        least = np.partition(s, len(s) - NEIGHBOURS)[len(s) - NEIGHBOURS]
        open_, s = open_[s >= least], s[s >= least]
    return open_[np.lexsort((open_, -s))][:NEIGHBOURS].tolist()


def powers_of_two(window: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a window that isn't full, cut into sequences whose lengths are powers of two."""
    rest = sum(n for _, _, n in window)
    pieces = window[::-1]
    while rest:
        space = size = 1 << (rest.bit_length() - 1)
        out = []
        while space:
            d, a, n = pieces.pop()
            out.append((d, a, min(n, space)))
            if n > space:
                pieces.append((d, a + space, n - space))
            space -= min(n, space)
        rest -= size
        yield out


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_TYPES = [pa.int64()] * 6 + [pa.binary()]
_NAMES = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def _pack(path: str, kind: str, end_id: int, statistics: Statistics, shard_docs: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        coder = tokenizer(path, kind)
        known = statistics
        shard = Shard(known)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal sequence, shard
            rows: list[tuple] = []
            for pieces in shard.pack():
                offset = 0
                for d, a, n in pieces:
                    ids = shard.ids[d]
                    rows.append((shard.doc[d], a, n, len(ids), sequence, offset, ids[a : a + n].astype("<u4").tobytes()))
                    offset += n
                sequence += 1
                if len(rows) >= 512:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)
            shard = Shard(known)

        for batch in batches:
            told = batch.column(2)
            if told.null_count < len(told):
                # Counts stand before all documents of a partition.
                known = known.knowing(told.flatten().to_numpy(), batch.column(3).flatten().to_numpy())
                shard = Shard(known)
                batch = batch.filter(told.is_null())
            docs = batch.column(0).to_pylist()
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                ids, at = coder.encode(data, offsets)
                row, word, count, lengths = term_counts(data, offsets)
                upto = np.searchsorted(row, np.arange(hi - lo + 1))
                done = 0
                while done < hi - lo:
                    # As many of these documents as the shard still takes.
                    room = offsets[done] + max(0, shard_bytes - shard.bytes)
                    end = max(done + 1, min(int(np.searchsorted(offsets, room, "right")) - 1, done + shard_docs - len(shard.doc)))
                    end = min(end, hi - lo)
                    part = slice(upto[done], upto[end])
                    shard.add(row[part] - done, word[part], count[part], lengths[done:end])
                    for a, b in zip(at[done:end].tolist(), at[done + 1 : end + 1].tolist(), strict=True):
                        shard.ids.append(np.append(ids[a:b], np.uint32(end_id) if end_id > np.iinfo(ids.dtype).max else ids.dtype.type(end_id)))
                    shard.doc += docs[lo + done : lo + end]
                    shard.bytes += int(offsets[end] - offsets[done])
                    done = end
                    if len(shard.doc) >= shard_docs or shard.bytes >= shard_bytes:
                        yield from flush()
        yield from flush()

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def pack(
    docs: DataFrame, vocabulary: str, kind: str = "byte", end_id: int = 0, shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Pieces of docs (doc_id, text) with their ids, as little-endian unsigned 32-bit integers, and their places."""
    spark = shared.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    statistics = corpus_statistics(docs)
    routed = shared.materialize(docs.mapInArrow(_route(statistics), _ROUTED), "routed")
    order = [*_KEYS, "copy", "doc_id"]
    total = routed.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total.bytes or 0) // PART_BYTES + 1)
    bounds = _bounds(routed, order, parts, total.n)
    dealt = routed.withColumn("part", _part(bounds)(*order))
    # Keys are never negative, so a partition's counts come first.
    first = {c: F.lit(-1).cast("long") for c in order[:-1]}
    placed = dealt.drop("size", "rare").unionByName(_rare_counts(dealt).withColumns(first), allowMissingColumns=True)
    placed = placed.repartitionById(parts, F.col("part"))
    placed = placed.sortWithinPartitions(*order).select("doc_id", "text", "words", "counts")
    exact = statistics.knowing(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return placed.mapInArrow(_pack(vocabulary, kind, end_id, exact, shard_docs, shard_bytes), SCHEMA)


def _rare_counts(dealt: DataFrame) -> DataFrame:
    """Per part the words below all ranges that two of its documents have, and how many of all documents have each."""
    pairs = dealt.select("part", F.explode("rare").alias("word")).repartition("word")
    held = pairs.groupBy("word", "part").agg(F.count(F.lit(1)).alias("n"))
    several = F.collect_list(F.when(F.col("n") > 1, F.col("part"))).alias("parts")
    known = held.groupBy("word").agg(F.sum("n").alias("n"), several).select(F.explode("parts").alias("part"), "word", "n")
    told = known.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return told.select("part", F.col("known.word").alias("words"), F.col("known.n").alias("counts"))


def _packed_keys(columns: list[np.ndarray]) -> np.ndarray:
    """Whole numbers of several columns as byte strings that compare as the rows do."""
    rows = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def _bounds(routed: DataFrame, order: list[str], parts: int, docs: int) -> np.ndarray:
    """Keys that cut the documents, in order, into parts of like size in bytes, from a sample of BOUND_SAMPLE a part."""
    share = int(min(1.0, BOUND_SAMPLE * parts / max(1, docs)) * (1 << 30))
    picked = routed.where(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(1 << 30)) < share)
    rows = picked.select(*order[:-1], F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "size").toArrow()
    if not len(rows):
        return np.zeros(0, f"S{8 * len(order)}")
    keys = _packed_keys([rows.column(c).to_numpy() for c in order])
    # An empty text still costs something.
    size = rows.column("size").to_numpy() + 64
    by = np.argsort(keys)
    upto = np.cumsum(size[by])
    return keys[by][np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)]


def _part(bounds: np.ndarray):
    def run(*columns):
        import pandas as pd

        keys = _packed_keys([c.fillna(0).to_numpy() for c in columns])
        return pd.Series(np.searchsorted(bounds, keys, "right").astype(np.int32))

    return F.pandas_udf(run, "int")
