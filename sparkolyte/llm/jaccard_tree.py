"""N-gram Jaccard self-join by signature trees.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Equal sets form one class. Classes
whose MinHash bands meet are put into one cluster, so that a cluster can be joined on its own; 72 bands of four
values miss a pair at similarity 0.75 with a chance of about 1e-12. Inside a cluster a tree is built over token
bitmaps: a node holds the OR of its documents' bitmaps, their size range and their largest count of bitmap
collisions. Both sides of the tree are descended together; a pair of nodes is dropped if its largest possible
overlap is too small, its sizes can't match, or all its documents are already linked with each other. What
remains is compared exactly, set against set.

A cluster is dealt into parts of about PART_DOCS documents and PART_SHINGLES shingles. Where it needs several, a part
holds documents of the same pivot, the most central one of those that share a band with them, and that pivot too, so
families of copies are linked nearly whole. What is left to find joins documents of different components. A shingle
that one component alone has in its cluster can't be common to such a pair, so with those shingles put first, then
the rarer ones, a linked pair shares one of the first n - ceil(3n / 4) + 1 of both sets. Documents meet by these
shingles, the private ones left out, so documents that share no more than a common passage are sent nowhere; and only
among documents of about their size, since others can't be linked with them.

Nulls and texts without words have an empty set and no link. Rows that repeat a doc_id count as that document.
A null doc_id keeps its n_shingles; its component_id is the least doc_id of its component, or null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbytes import FOLDED, WORD, SpanHash, find_words, mix, text_chunks

SHINGLE = 5
BANDS, ROWS = 72, 4
#: Documents and shingles that are compared at once, on average.
PART_DOCS = 512
PART_SHINGLES = 1 << 21
#: Bands that pivots are chosen by.
STAR_BANDS = 16
LEAF = 8
_rng = np.random.default_rng(5)
_PLACE = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS + 1), dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    starts, ends, row = find_words(data, offsets, WORD)
    word = SpanHash(data, FOLDED)(starts, ends)
    count = np.bincount(row, minlength=len(offsets) - 1)
    at = np.concatenate(([0], np.cumsum(count)))
    n = max(0, len(word) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h += word[j : n + j] * _PLACE[j]
    h = mix(h)
    out = []
    for k, c in enumerate(count.tolist()):
        a = at[k]
        if c >= SHINGLE:
            out.append(np.unique(h[a : a + c - SHINGLE + 1]))
        elif c:
            out.append(mix((word[a : a + c] * _PLACE[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(s: np.ndarray) -> np.ndarray:
    low = np.full(len(_PERMUTE), np.iinfo(np.uint64).max)
    for a in range(0, len(s), 256):
        np.minimum(low, np.multiply.outer(_PERMUTE, s[a : a + 256]).min(axis=1), out=low)
    low = low.reshape(BANDS, ROWS)
    return mix((mix(low) * (_BAND[:, :ROWS] | np.uint64(1))).sum(axis=1) + _BAND[:, ROWS])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, keys = [], [], [], []
        seen: dict[tuple[int, int], bytes] = {}
        for _, _, data, offsets in text_chunks(batch.column(1)):
            for s in shingle_sets(data, offsets):
                place = np.arange(1, 2 * len(s) + 1, 2).astype(np.uint64)
                f = int(mix((s * place).sum(keepdims=True))[0]), int(mix((mix(s) * place).sum(keepdims=True))[0])
                if len(s) and f not in seen:
                    seen[f] = band_keys(s).tobytes()
                n.append(len(s))
                one.append(f[0])
                two.append(f[1])
                keys.append(seen.get(f))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(n, pa.int64()),
                pa.array(np.array(one, np.uint64).view(np.int64)),
                pa.array(np.array(two, np.uint64).view(np.int64)),
                pa.array(keys, pa.binary()),
            ],
            ["doc_id", "n_shingles", "fp1", "fp2", "keys"],
        )


class _Sets:
    """Union-find over positions."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _band_buckets(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.asarray(batch.column(0))
            if not len(doc):
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            docs = np.repeat(doc, BANDS)
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            # A key's further documents here are joined to its first one at once, so a frequent key stays small.
            first = docs[new][np.cumsum(new) - 1]
            pairs = np.unique(np.stack([docs[~new], first[~new]], axis=1), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            keys, docs = keys[new], docs[new]
            bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            ids, ks, ds = [], [], []
            for b in range(buckets):
                if bounds[b] < bounds[b + 1]:
                    pick = order[bounds[b] : bounds[b + 1]]
                    ids.append(b)
                    ks.append(keys[pick].tobytes())
                    ds.append(docs[pick].tobytes())
            if len(pairs):
                ids.append(-1 - int(mix(np.array([doc[0]], np.int64).view(np.uint64))[0] % np.uint64(buckets)))
                ks.append(pairs[:, 0].tobytes())
                ds.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int32()), pa.array(ks, pa.binary()), pa.array(ds, pa.binary())], ["bucket", "a", "b"]
            )

    return emit


def _band_edges(found: pa.Table) -> pa.Table:
    """Edges that span what the keys of one bucket join."""
    a = np.frombuffer(b"".join(found.column("a").to_pylist()), np.uint64)
    b = np.frombuffer(b"".join(found.column("b").to_pylist()), np.int64)
    if found.column("bucket")[0].as_py() < 0:
        u, v = a.view(np.int64), b
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], a[1:] != a[:-1]))
        v = b[new][np.cumsum(new) - 1]
        u, v = b[~new], v[~new]
    if len(u):
        u, v = np.unique(np.stack([u, v], axis=1), axis=0).T
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        groups = _Sets(list(range(len(ids))))
        half = len(u)
        keep = [groups.union(x, y) for x, y in zip(at[:half].tolist(), at[half:].tolist(), strict=True)]
        u, v = u[keep], v[keep]
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 4 * len(a) < 3 * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= 75 * (len(a) + len(b) - both)


class SignatureTree:
    """Nodes over documents in order: OR of bitmaps, size range, largest count of collisions."""

    def __init__(self, sets: list[np.ndarray]):
        size = np.array([len(s) for s in sets], np.int64)
        width = 1 << int(np.clip(np.ceil(np.log2(4 * size.max())), 8, 15))
        first = np.array([s[0] for s in sets], np.uint64)
        self.order = np.lexsort((first, (np.log(size) / np.log(4 / 3)).astype(int)))
        self.sets = [sets[i] for i in self.order]
        bits = np.zeros((len(sets), width), bool)
        for k, s in enumerate(self.sets):
            bits[k, (s % np.uint64(width)).astype(np.int64)] = True
        maps = np.packbits(bits, axis=1).view(np.uint64)
        size = size[self.order]
        lost = size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, lost = self.levels[-1]
            cut = np.arange(0, len(maps), LEAF)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, cut, axis=0),
                    np.minimum.reduceat(low, cut),
                    np.maximum.reduceat(high, cut),
                    np.maximum.reduceat(lost, cut),
                )
            )

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether documents under nodes a and b can reach the similarity: sizes, then the largest overlap."""
        maps, low, high, lost = self.levels[level]
        ok = (4 * high[a] >= 3 * low[b]) & (4 * high[b] >= 3 * low[a])
        for i in range(0, len(a), 1 << 13):
            x, y = a[i : i + (1 << 13)], b[i : i + (1 << 13)]
            both = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(lost[x], lost[y])
            ok[i : i + (1 << 13)] &= 7 * both >= 3 * (low[x] + low[y])
        return ok

    def links(self, labels: list[int]) -> list[tuple[int, int]]:
        """Pairs of positions that join what the labels leave apart, as the exact comparison finds them."""
        groups, order, found = _Sets([labels[i] for i in self.order]), self.order.tolist(), []

        def compare(x: int, y: int) -> None:
            if groups.find(x) != groups.find(y) and linked(self.sets[x], self.sets[y]):
                groups.union(x, y)
                found.append((order[x], order[y]))

        for x in range(len(order) - 1):
            compare(x, x + 1)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    compare(x, y)
                continue
            n = len(self.levels[level - 1][0])
            i, j = np.meshgrid(np.arange(LEAF), np.arange(LEAF), indexing="ij")
            x = (a[:, None] * LEAF + i.ravel()).ravel()
            y = (b[:, None] * LEAF + j.ravel()).ravel()
            keep = (x < n) & (y < n) & ((x < y) if level == 1 else (x <= y))
            x, y = x[keep], y[keep]
            # A node whose documents are all linked has that group's number, another one a number of its own.
            root = np.array([groups.find(k) for k in range(len(order))])
            cut = np.arange(0, len(order), LEAF ** (level - 1))
            low, high = np.minimum.reduceat(root, cut), np.maximum.reduceat(root, cut)
            apart = (low[x] != low[y]) | (low[x] != high[x]) | (low[y] != high[y])
            x, y = x[apart], y[apart]
            ok = self.possible(level - 1, x, y)
            x, y = x[ok], y[ok]
            step = 4096 if level > 1 else 256
            stack += [(level - 1, x[k : k + step], y[k : k + step]) for k in range(0, len(x), step)][::-1]
        return found


def _join_part(part: pa.Table) -> pa.Table:
    doc, labels, sets = [], [], []
    ids, label = part.column("doc_id").to_pylist(), part.column("label").to_pylist()
    at = 0
    for chunk in part.column("text").chunks:
        for lo, hi, data, offsets in text_chunks(chunk):
            for k, s in zip(range(at + lo, at + hi), shingle_sets(data, offsets), strict=True):
                if len(s):
                    doc.append(ids[k])
                    labels.append(label[k])
                    sets.append(s)
        at += len(chunk)
    pairs = SignatureTree(sets).links(labels) if len(set(labels)) > 1 else []
    return pa.table({"u": pa.array([doc[a] for a, _ in pairs], pa.int64()), "v": pa.array([doc[b] for _, b in pairs], pa.int64())})


def _parts_to_links(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows: doc_id, label and the columns of a part. Joins texts and compares each part in a task."""
    part = [c for c in rows.columns if c not in ("doc_id", "label")]
    return (
        texts.join(rows.hint("merge"), "doc_id")
        .select("doc_id", "label", "text", *part)
        .groupBy(*part)
        .applyInArrow(_join_part, "u long, v long")
    )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per shingle of each text (doc_id, cluster, label, text); row tells apart the texts of one doc_id."""
    for batch in batches:
        keys = [batch.column(k) for k in range(3)]
        for lo, _, data, offsets in text_chunks(batch.column(3)):
            sets = shingle_sets(data, offsets)
            n = np.array([len(s) for s in sets])
            pick = pa.array(np.repeat(np.arange(lo, lo + len(sets)), n))
            row = [int(mix(s.sum(keepdims=True))[0]) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(k.take(pick) for k in keys),
                    pa.array(np.repeat(np.array(row, np.uint64).view(np.int64), n)),
                    pa.array(np.repeat(n, n), pa.int64()),
                    pa.array(np.concatenate(sets).view(np.int64)),
                ],
                ["doc_id", "cluster", "label", "row", "n", "token"],
            )


def _pivots(members: DataFrame) -> DataFrame:
    """doc_id, cluster, pivot: of the documents that share one of STAR_BANDS bands with it, the most central one.

    Central is what shares bands with many. The middle of a family of copies is the pivot of nearly all of it.
    """
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("keys", 8 * b + 1, 8)) for b in range(STAR_BANDS)])
    rows = members.select("doc_id", "cluster", F.explode(bands).alias("key"))
    groups = rows.groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    central = shared.spread(rows, groups, ["cluster", "key"], "doc_id").groupBy("doc_id", "cluster").agg(F.sum("held").alias("central"))
    central = shared.materialize(central, "central")
    top = rows.join(central, ["doc_id", "cluster"]).groupBy("cluster", "key").agg(F.max(F.struct("central", "doc_id")).alias("top"))
    found = shared.spread(rows, top, ["cluster", "key"], "doc_id").groupBy("doc_id", "cluster").agg(F.max("top").alias("top"))
    return found.select("doc_id", "cluster", F.col("top.doc_id").alias("pivot"))


def star_parts(members: DataFrame, part_docs: int, part_shingles: int) -> DataFrame:
    """members (doc_id, cluster, n, keys, parts) in parts (doc_id, label, cluster, hot, part).

    A cluster that needs one part is one. Otherwise documents of one pivot lie in one part, or in several if they are
    too many, and the pivot with them in each.
    """
    whole = members.where("parts = 1").select(
        "doc_id", F.col("doc_id").alias("label"), "cluster", F.lit(None).cast("long").alias("hot"), F.lit(0).cast("long").alias("part")
    )
    several = members.where("parts > 1")
    led = shared.materialize(
        several.join(_pivots(several).drop("cluster"), "doc_id", "left").select(
            "doc_id", "cluster", "n", "parts", F.coalesce("pivot", "doc_id").alias("pivot")
        ),
        "pivots",
    )
    load = F.greatest(F.count(F.lit(1)) / F.lit(part_docs), F.sum("n") / F.lit(part_shingles))
    hot = led.groupBy("cluster", "pivot").agg(F.ceil(load).alias("blocks")).where("blocks > 1")
    hot = shared.spread(led, hot, ["cluster", "pivot"], "doc_id", "left")
    dealt = hot.select(
        "doc_id",
        "cluster",
        "pivot",
        F.when(F.col("blocks") > 1, F.col("pivot")).alias("hot"),
        F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("doc_id"), "blocks")).otherwise(F.pmod(F.xxhash64("pivot"), "parts")).alias("part"),
    )
    with_pivots = dealt.select("doc_id", "cluster", "hot", "part").unionByName(
        dealt.select(F.col("pivot").alias("doc_id"), "cluster", "hot", "part")
    )
    return whole.unionByName(with_pivots.distinct().withColumn("label", F.col("doc_id")))


def first_shingles(texts: DataFrame, members: DataFrame) -> DataFrame:
    """doc_id, cluster, band, label, n and token: the shingles by which documents of different labels have to meet.

    Of each text, in each of its two bands of sizes, the first n - ceil(3n / 4) + 1 shingles, those first that only one
    label of the cluster's band has, then the rarer ones; those of one label left out. Two linked texts of different
    labels have one of these in common in a band that is both's.
    """
    rows = texts.join(members.select("doc_id", "cluster", "label").hint("merge"), "doc_id")
    tokens = rows.select("doc_id", "cluster", "label", "text").mapInArrow(
        _tokens, "doc_id long, cluster long, label long, row long, n long, token long"
    )
    tokens = shared.materialize(tokens, "shingles")
    # Linked sets differ in size by a third at most, so their size classes are the same or neighbours and share a band.
    size = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    tokens = tokens.withColumn("band", F.explode(F.array(size, size + 1)))
    met = (
        tokens.groupBy("cluster", "band", "token")
        .agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("cluster", "band", "token", "df")
    )
    met = shared.spread(tokens, met, ["cluster", "band", "token"], "doc_id")
    keys = ["doc_id", "cluster", "band", "label", "row", "n"]
    listed = met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("met"))
    # Private shingles come first, so those that are met get what is left of the prefix.
    left = F.size("met") - F.floor((3 * F.col("n") + 3) / 4) + 1
    first = F.slice("met", F.lit(1), F.greatest(left, F.lit(0)).cast("int"))
    return listed.select("doc_id", "cluster", "band", "label", "n", F.explode(first).alias("t")).select(
        "doc_id", "cluster", "band", "label", "n", F.col("t.token").alias("token")
    )


def _blocks(docs: DataFrame, load: Column, keys: list[str]) -> DataFrame:
    """keys, main (the label of most documents), blocks and chunks, and the rows that dealing docs so takes."""
    size = docs.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k"), load.alias("load"))
    found = size.groupBy(*keys).agg(F.max(F.struct("k", "label", "load")).alias("main"), F.sum("load").alias("all"), F.sum("k").alias("k"))
    found = found.select(
        *keys,
        F.col("main.label").alias("main"),
        F.ceil("all").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("all") - F.col("main.load"))).alias("chunks"),
        "k",
        (F.col("k") - F.col("main.k")).alias("others"),
    )
    rows = F.col("k") * F.col("chunks") + F.col("others") * F.col("blocks")
    return found.select(*keys, "main", "blocks", "chunks", rows.alias("rows"))


def meeting_parts(first: DataFrame, part_docs: int, part_shingles: int) -> DataFrame:
    """first_shingles' documents in parts (doc_id, label, cluster, band, often, part, other): all that share one meet.

    There are two ways, of which a cluster's size band takes the one that sends fewer rows. Shingles that a part's load
    of documents have at most are put into parts together. Or documents are dealt into blocks, and every one but those
    of the largest component goes to all blocks too, in chunks of a part's load, since a link that is still to be found
    has one of them at least. Documents of shingles that more than a part's load have go the second way in any case.
    """
    load = F.greatest(F.count(F.lit(1)) / F.lit(part_docs), F.sum("n") / F.lit(part_shingles))
    keys = ["cluster", "band"]
    groups = (
        first.groupBy(*keys, "token")
        .agg(load.alias("load"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select(*keys, "token", "load")
    )
    groups = shared.materialize(groups, "shingle_groups")
    met = shared.materialize(shared.spread(first, groups, [*keys, "token"], "doc_id"), "met")
    docs = met.groupBy("doc_id", "label", *keys).agg(F.max("n").alias("n"), F.max("load").alias("top"), F.count(F.lit(1)).alias("tokens"))
    docs = shared.materialize(docs, "met_documents")
    # Documents side by side in a part at least as often as they would be in blocks take the blocks.
    asked = docs.groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    ways = _blocks(docs, load, keys).join(asked, keys).select(*keys, (F.col("rows") <= F.col("tokens")).alias("all"))
    ways = shared.materialize(ways, "ways")
    bins = groups.where("load <= 1").groupBy(*keys).agg(F.ceil(F.sum("load")).alias("bins")).join(ways.where("not all"), keys)
    rare = shared.spread(met.where("load <= 1"), bins, keys, "doc_id").select(
        "doc_id", "label", *keys, F.lit(False).alias("often"), F.pmod(F.xxhash64("token"), "bins").alias("part"), F.lit(0).cast("long").alias("other")
    )
    often = shared.spread(docs, ways, keys, "doc_id").where("all or top > 1")
    often = shared.materialize(often.select("doc_id", "label", *keys, "n"), "often")
    often = shared.spread(often, _blocks(often, load, keys), keys, "doc_id")
    own, chunk = F.pmod(F.xxhash64("doc_id"), "blocks"), F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    named = ["doc_id", "label", *keys, F.lit(True).alias("often")]
    dealt = often.select(*named, own.alias("part"), F.explode(upto("chunks")).alias("other"))
    sent = often.where("label != main").select(*named, F.explode(upto("blocks")).alias("part"), chunk.alias("other"))
    return rare.unionByName(dealt).unionByName(sent).distinct()


def _links(texts: DataFrame, members: DataFrame, part_docs: int, part_shingles: int) -> DataFrame:
    """Pairs (u, v) that span all links inside the clusters. members: doc_id, cluster, n, keys."""
    load = F.greatest(F.count(F.lit(1)) / F.lit(part_docs), F.sum("n") / F.lit(part_shingles))
    size = members.groupBy("cluster").agg(F.ceil(load).alias("parts")).where("parts > 1")
    members = shared.spread(members, size, ["cluster"], "doc_id", "left").select(
        "doc_id", "cluster", "n", "keys", F.coalesce("parts", F.lit(1).cast("long")).alias("parts")
    )
    members = shared.materialize(members, "members")
    links = shared.materialize(_parts_to_links(texts, star_parts(members, part_docs, part_shingles)), "links")
    # A cluster of one part is done.
    label = shared.components(links).select(F.col("u").alias("doc_id"), F.col("root").alias("label"))
    open_ = members.where("parts > 1").select("doc_id", "cluster").join(label, "doc_id", "left")
    open_ = open_.withColumn("label", F.coalesce("label", "doc_id"))
    first = shared.materialize(first_shingles(texts, open_), "first_shingles")
    met = shared.materialize(meeting_parts(first, part_docs, part_shingles), "meeting_parts")
    return links.unionByName(shared.materialize(_parts_to_links(texts, met), "last_links"))


def near_duplicates(docs: DataFrame, part_docs: int = PART_DOCS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text)."""
    spark = shared.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = shared.materialize(
        docs.mapInArrow(_describe, "doc_id long, n_shingles long, fp1 long, fp2 long, keys binary"), "sets"
    )
    full = described.where("n_shingles > 0")
    fingerprint = ["fp1", "fp2", "n_shingles"]
    classes = full.groupBy(*fingerprint).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = shared.materialize(classes, "classes")
    # By doc_id too, so that copies of one text don't meet in one task.
    reps = full.join(classes.select(*fingerprint, F.col("rep").alias("doc_id")), ["doc_id", *fingerprint], "left_semi")
    reps = reps.select("doc_id", "n_shingles", "keys")
    buckets = max(1, classes.count() * BANDS // 2_000_000 + 1) * 4
    edges = (
        reps.select("doc_id", "keys")
        .mapInArrow(_band_buckets(buckets), "bucket int, a binary, b binary")
        .groupBy("bucket")
        .applyInArrow(_band_edges, "u long, v long")
    )
    near = shared.components(edges)
    near = near.unionByName(near.select(F.col("root").alias("u"), "root").distinct()).select(
        F.col("u").alias("doc_id"), F.col("root").alias("cluster")
    )
    # Of the texts that share a doc_id the longest tells the bands and the size; all are compared.
    near = near.join(reps, "doc_id").groupBy("doc_id", "cluster").agg(F.max(F.struct("n_shingles", "keys")).alias("w"))
    near = near.select("doc_id", "cluster", F.col("w.n_shingles").alias("n"), "w.keys")
    near = shared.materialize(near, "clusters")
    # Texts move once, and only those of clusters move again.
    texts = shared.materialize(docs.join(near.select("doc_id").hint("merge"), "doc_id", "left_semi"), "texts")
    links = _links(texts, near, part_docs, part_shingles)
    # Rows that share a doc_id are one document, so their classes are linked through it.
    several = full.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp1").alias("a"), F.max("fp1").alias("b")).where("a != b")
    held = full.join(several.select("doc_id"), "doc_id", "left_semi").select("doc_id", *fingerprint).distinct()
    shared_ids = held.join(classes, fingerprint).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    root = shared.components(links.unionByName(shared_ids))
    copied = classes.where("copies > 1")
    copied = copied.join(root, copied["rep"] == root["u"], "left").select(*fingerprint, F.coalesce("root", "rep").alias("of_class"))
    found = shared.spread(described.drop("keys"), copied, fingerprint, "doc_id", "left")
    found = found.join(root.withColumnRenamed("u", "doc_id"), "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("of_class", "root", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; of rows that share an id, one."""
    found = near_duplicates(docs).groupBy("doc_id").agg(F.min("component_id").alias("_component"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    named = rows.where("_id is not null").join(found, F.expr("_id = doc_id")).where("_id = _component")
    kept = named.select("_row", "_id").dropDuplicates(["_id"]).select("_row.*")
    return kept.unionByName(rows.where("_id is null").select("_row.*"))
