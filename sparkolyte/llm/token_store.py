"""Token ids in shard files with a minimal perfect hash index.

Shards hold raw little-endian ids of whole documents in ascending order of doc_id (rows that share one: by text;
null first). The index maps the key (doc_id, number among rows of that id) to part, block and offset. Keys are
dealt to index buckets by hash; each bucket holds a minimal perfect hash of the cascading bit-array kind (Limasset
et al. 2017) and, per slot, a 32-bit fingerprint that rejects keys never stored. get() reads the keys' buckets and
their blocks alone, by partition and pushed-down filters, and cuts the ids out by the index; read() does so for a table
of keys of any size. Parts and buckets are rows of Parquet files that Spark commits, so a lost executor costs a task.
Ids are stored in 16 bits, or in 32 for a vocabulary of over 65,536. Null text is an empty document: the end id alone.
An empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .cached_tokens import encode_column, tokenizer
from .textbytes import mix

BLOCK_IDS = 1 << 19
#: Keys in an index bucket, on average.
BUCKET_KEYS = 1 << 15
#: Buckets in an index file, and bytes of its row groups, that a filter by bucket skips.
INDEX_FILE, INDEX_GROUP = 64, 1 << 20
GAMMA = 2.0
LEVELS = 24
_SHARD = "block int, start long, payload binary, keys array<long>, ords array<int>, lens array<long>, part int"
_INDEX = "bucket int, hashes binary, fingerprints binary, places binary"
_PLACES = "key long, ord int, part int, block int, at long, n long"


def key_hash(key: np.ndarray, null: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    h = key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h += ord_.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + null.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return mix(h + np.uint64(0x27D4EB2F165667C5))


class MinimalPerfectHash:
    """Cascading bit arrays: a key's slot is the rank of the bit that it alone set."""

    def __init__(self, keys: np.ndarray | None = None, blob: bytes | None = None):
        self.levels: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint64)
        if blob is not None:
            head = np.frombuffer(blob, "<u4", 2)
            sizes = np.frombuffer(blob, "<u4", head[0], 8)
            at = 8 + 4 * int(head[0])
            for size in sizes.tolist():
                self.levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, (size + 7) // 8, at), count=size).astype(bool))
                at += (size + 7) // 8
            self.rest = np.frombuffer(blob, "<u8", head[1], at)
        else:
            for level in range(LEVELS):
                if not len(keys):
                    break
                size = max(64, int(GAMMA * len(keys)))
                place = self._place(keys, level, size)
                hits = np.bincount(place, minlength=size)
                self.levels.append(hits == 1)
                keys = keys[hits[place] != 1]
            self.rest = np.sort(keys)
        self.ranks = []
        base = 0
        for bits in self.levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())
        self.base = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key; any value may come for keys that were never stored, -1 included."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            place = self._place(keys[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = self.ranks[level][place[hit]]
            left = left[~hit]
        if len(self.rest) and len(left):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            hit = self.rest[at] == keys[left]
            out[left[hit]] = self.base + at[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), len(self.rest)], "<u4").tobytes()
        sizes = np.array([len(b) for b in self.levels], "<u4").tobytes()
        return head + sizes + b"".join(np.packbits(b).tobytes() for b in self.levels) + self.rest.astype("<u8").tobytes()


def _encode_shards(path: str, kind: str, end_id: int, dtype: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
        rows: list[tuple] = []
        last, ord_ = object(), 0

        def flush() -> pa.RecordBatch:
            nonlocal block, start, held
            one = [
                block,
                start,
                b"".join(r[2].tobytes() for r in rows),
                [r[0] for r in rows],
                [r[1] for r in rows],
                [len(r[2]) for r in rows],
                part,
            ]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int32()]
            names = ["block", "start", "payload", "keys", "ords", "lens", "part"]
            block, start, held = block + 1, start + held, 0
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds, strict=True)], names)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encode_column(batch.column(1), path, kind, end_id), strict=True):
                ord_ = ord_ + 1 if key == last else 0
                last = key
                rows.append((key, ord_, ids.astype(dtype)))
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield flush()
        if rows:
            yield flush()

    return encode


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0x94D049BB133111EB)) % np.uint64(buckets)).astype(np.int32)


def _entries(buckets: int):
    """An index entry for each document of each block: its bucket and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, keys, ords, lens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(keys)
                entries = pa.table(
                    {
                        "key": pa.array(keys, pa.int64()),
                        "ord": pa.array(ords, pa.int32()),
                        "part": pa.array(np.full(n, part), pa.int32()),
                        "block": pa.array(np.full(n, block), pa.int32()),
                        "at": pa.array(np.cumsum(lens) - lens, pa.int64()),
                        "n": pa.array(lens, pa.int64()),
                    }
                )
                yield from entries.append_column("bucket", pa.array(_bucket(_hashed(entries), buckets))).to_batches()

    return run


def _asked(buckets: int):
    """Keys with their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if len(table):
                yield from table.append_column("bucket", pa.array(_bucket(_hashed(table), buckets))).to_batches()

    return run


def _hashed(table: pa.Table) -> np.ndarray:
    key = table.column("key").combine_chunks()
    null = np.asarray(key.is_null())
    return key_hash(np.asarray(key.fill_null(0)), null, np.asarray(table.column("ord").combine_chunks()))


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


def _build_bucket(found: pa.Table) -> pa.Table:
    h = _hashed(found)
    hashes = MinimalPerfectHash(h)
    slot = hashes.slots(h)
    order = np.argsort(slot)
    columns = {c: np.asarray(found.column(c).combine_chunks())[order] for c in ("part", "block", "at", "n")}
    return pa.table(
        {
            "bucket": found.column("bucket")[:1],
            "hashes": pa.array([hashes.to_bytes()], pa.binary()),
            "fingerprints": pa.array([_fingerprint(h)[order].tobytes()], pa.binary()),
            "places": pa.array(
                [np.stack([columns[c].astype("<i8") for c in ("part", "block", "at", "n")]).tobytes()], pa.binary()
            ),
        }
    )


def _look_up(asked: pa.Table, index: pa.Table) -> pa.Table:
    h = _hashed(asked) if len(asked) else np.zeros(0, np.uint64)
    places = np.zeros((4, len(h)), np.int64)
    ok = np.zeros(len(h), bool)
    if len(index) and len(h):
        slot = MinimalPerfectHash(blob=index.column("hashes")[0].as_py()).slots(h)
        kept = np.frombuffer(index.column("fingerprints")[0].as_py(), "<u4")
        ok = (slot >= 0) & (kept[np.clip(slot, 0, len(kept) - 1)] == _fingerprint(h))
        all_places = np.frombuffer(index.column("places")[0].as_py(), "<i8").reshape(4, -1)
        places = all_places[:, np.clip(slot, 0, len(kept) - 1)]
    return pa.table(
        {
            "key": asked.column("key").combine_chunks().filter(pa.array(ok)),
            "ord": asked.column("ord").combine_chunks().filter(pa.array(ok)),
            "part": pa.array(places[0][ok], pa.int32()),
            "block": pa.array(places[1][ok], pa.int32()),
            "at": pa.array(places[2][ok], pa.int64()),
            "n": pa.array(places[3][ok], pa.int64()),
        }
    )


def _slices(dtype: str):
    """Each asked document's ids, cut out of its block by the index's offset and length."""
    width = np.dtype(dtype).itemsize

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.array([a["at"] for a in asked], np.int64)
                ids = [np.frombuffer(payload, dtype, a["n"], a["at"] * width).astype("<u4").tobytes() for a in asked]
                columns = [
                    pa.array([a["key"] for a in asked], pa.int64()),
                    pa.array([a["ord"] for a in asked], pa.int32()),
                    pa.array(start + at, pa.int64()),
                    pa.array([a["n"] for a in asked], pa.int64()),
                    pa.array(ids, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["key", "ord", "start", "n_tokens", "ids"])

    return read


@dataclass
class TokenStore:
    """Shard and index files under a path."""

    spark: SparkSession
    path: str
    dtype: str
    buckets: int
    totals: list[tuple[int, int]] | None = None

    @property
    def shards(self) -> DataFrame:
        """Blocks of ids, partitioned by part; within a file in the order of blocks."""
        return self.spark.read.schema(_SHARD).parquet(f"{self.path}/shards")

    @property
    def index(self) -> DataFrame:
        """A row per bucket, in files by ranges of buckets."""
        return self.spark.read.schema(_INDEX).parquet(f"{self.path}/index")

    def locate(self, keys: DataFrame, index: DataFrame | None = None) -> DataFrame:
        """keys (key long, ord int) to (key, ord, part, block, at, n) through the index; unknown keys give no row."""
        asked = keys.select(F.col("key").cast("long"), F.col("ord").cast("int")).mapInArrow(
            _asked(self.buckets), "key long, ord int, bucket int"
        )
        index = self.index if index is None else index
        return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(_look_up, _PLACES)

    def _cut(self, places: DataFrame, shards: DataFrame) -> DataFrame:
        # Of one block at a time, whose documents are BLOCK_IDS and one at most.
        asked = places.groupBy("part", "block").agg(F.collect_list(F.struct("key", "ord", "at", "n")).alias("asked"))
        found = shards.select("part", "block", "start", "payload").join(asked, ["part", "block"])
        found = found.join(self._before(), "part").select((F.col("start") + F.col("before")).alias("start"), "payload", "asked")
        return found.mapInArrow(_slices(self.dtype), "key long, ord int, start long, n_tokens long, ids binary")

    def _before(self) -> DataFrame:
        """part, before: the ids in all parts before. A row per part: their number is that of the write's partitions."""
        if self.totals is None:
            sums = self.shards.groupBy("part").agg(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
            before, self.totals = 0, []
            for part, n in sorted(tuple(r) for r in sums.collect()):
                self.totals.append((part, before))
                before += n
        return self.spark.createDataFrame(self.totals, "part int, before long")

    def read(self, keys: DataFrame) -> DataFrame:
        """key, ord, start (ids of all documents before), n_tokens and ids (little-endian, 32 bits) of stored keys."""
        return self._cut(self.locate(keys), self.shards)

    def get(self, keys: list[tuple[int | None, int]]) -> DataFrame:
        """read() for a list of (key, ord): only the buckets and blocks of these keys are read."""
        asked = self.spark.createDataFrame(keys, "key long, ord int")
        table = pa.table({"key": pa.array([k for k, _ in keys], pa.int64()), "ord": pa.array([o for _, o in keys], pa.int32())})
        buckets = sorted(set(_bucket(_hashed(table), self.buckets).tolist())) if keys else []
        # As many rows as keys were given.
        rows = self.locate(asked, self.index.where(F.col("bucket").isin(buckets))).collect()
        blocks: dict[int, set[int]] = {}
        for r in rows:
            blocks.setdefault(r.part, set()).add(r.block)
        wanted = F.lit(False)
        for part, some in sorted(blocks.items()):
            wanted = wanted | (F.col("part") == part) & F.col("block").isin(sorted(some))
        return self._cut(self.spark.createDataFrame(rows, _PLACES), self.shards.where(wanted))


def write_store(docs: DataFrame, path: str, vocabulary: str, kind: str, end_id: int, dtype: str | None = None) -> TokenStore:
    """Encode docs (doc_id, text) and write shards and index. dtype: "<u2" or "<u4", by the vocabulary's size if None."""
    spark = shared.prepare(docs.sparkSession)
    needed = "<u2" if max(tokenizer(vocabulary, kind).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    if dtype not in (None, "<u2", "<u4") or (dtype == "<u2" and needed == "<u4"):
        raise ValueError(f"ids of this vocabulary don't fit {dtype!r}")
    dtype = dtype or needed
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    shards = ordered.mapInArrow(_encode_shards(vocabulary, kind, end_id, dtype), _SHARD)
    shards.write.partitionBy("part").option("compression", "zstd").parquet(f"{path}/shards")
    kept = spark.read.schema(_SHARD).parquet(f"{path}/shards")
    documents = kept.agg(F.sum(F.size("keys"))).first()[0] or 0
    buckets = documents // BUCKET_KEYS + 1
    entries = kept.select("part", "block", "keys", "ords", "lens").mapInArrow(_entries(buckets), f"{_PLACES}, bucket int")
    index = entries.groupBy("bucket").applyInArrow(_build_bucket, _INDEX)
    # A row per bucket: sorted, so that a file holds a range of them.
    index.repartitionByRange(-(-buckets // INDEX_FILE), "bucket").sortWithinPartitions("bucket").write.option(
        "parquet.block.size", str(INDEX_GROUP)
    ).parquet(f"{path}/index")
    return TokenStore(spark, path, dtype, buckets)


def read_documents(docs: DataFrame, store: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, found through the index and read from the payload."""
    keys = (
        docs.groupBy(F.col("doc_id").cast("long").alias("key"))
        .agg(F.count(F.lit(1)).cast("int").alias("n"))
        .select("key", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ord"))
    )
    return store.read(keys).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
