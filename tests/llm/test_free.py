"""The other operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkolyte.llm import avi_media as V
from sparkolyte.llm import bm25_pack as B
from sparkolyte.llm import chunk_fingerprint as C
from sparkolyte.llm import jaccard_tree as J
from sparkolyte.llm import licence_automaton as A
from sparkolyte.llm import quality_mil as Q
from sparkolyte.llm import queries, shared
from sparkolyte.llm import token_store as S

from .fixtures import documents, empty, texts

SF = "/root/testdata/sf0.001"


def ids_of(name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- classifier


def test_classifier_on_held_out_documents(spark):
    rows = queries.op2_quality_mil(spark, "/root/testdata/sf0.01")
    labels = shared.table(spark, "/root/testdata/sf0.01", "labels")
    got = rows.join(labels, "doc_id").where("held_out").collect()
    one, zero = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in got]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows.collect())
    docs = shared.table(spark, "/root/testdata/sf0.01", "documents")
    long = {r.doc_id for r in docs.where("size(split(text, ' ')) > 1000").select("doc_id").collect()}
    of_long = [r.predicted == r.quality for r in got if r.doc_id in long]
    assert len(of_long) > 5 and np.mean(of_long) > 0.85


def plain_score(model, text):
    """The score of one text, passage by passage in plain Python."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    scores, hidden = [], []
    cuts = list(range(0, len(words), Q.PASSAGE_WORDS)) or [0]
    at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text.encode())]
    for n, k in enumerate(cuts):
        some = words[k : k + Q.PASSAGE_WORDS]
        begin = 0 if n == 0 else at[k]
        end = at[cuts[n + 1]] if n + 1 < len(cuts) else len(text.encode())
        raw = text.encode()[begin:end]
        shares = [sum(Q._CLASSES[b] == c for b in raw) / max(1, len(raw)) for c in range(8)]
        lengths = [len(w) for w in some]
        stats = [len(some) / Q.PASSAGE_WORDS, len(set(some)) / max(1, len(some))]
        stats += [(np.mean(lengths) if some else 0) / 10, (np.std(lengths) if some else 0) / 10, np.mean([x == 1 for x in lengths]) if some else 0, float(shares[1] > 0.3)]
        bag = np.zeros(Q.HASHED)
        for w in some:
            data = np.frombuffer(w, np.uint8)
            bag[int(Q.SpanHash(data, Q.EXACT)(np.array([0]), np.array([len(w)]))[0]) >> 57] += 1
        x = np.array([4 * s for s in shares] + stats + (bag / max(1, np.linalg.norm(bag))).tolist())
        w = model.weights
        h = np.tanh(x @ w["encode"] + w["encode0"])
        scores.append(float((np.tanh(h @ w["tanh"]) / (1 + np.exp(-(h @ w["gate"])))) @ w["attend"]))
        hidden.append(h)
    a = np.exp(np.array(scores) - max(scores))
    z = (a / a.sum()) @ np.array(hidden)
    return 1 / (1 + np.exp(-(z @ model.weights["out"] + model.weights["out0"][0])))


def test_scores_by_brute_force(spark):
    docs = documents(spark)
    model = Q.train(docs, spark.createDataFrame([(i, i // 3 % 2) for i in range(0, 150, 3)], "doc_id long, quality int"))
    for r in Q.score(docs.where("doc_id < 60"), model).join(docs, "doc_id").collect():
        if r.doc_id != docs.first().doc_id and r.text is not None and "\x1c" not in r.text:
            same = [x.text for x in docs.where(F.col("doc_id") == r.doc_id).collect()]
            assert any(abs(r.score - plain_score(model, t or "")) < 1e-3 for t in same), r.doc_id


def test_sample_is_bounded_in_documents_and_passages(spark, monkeypatch):
    rows = [(i % 50, f"{'good' if i % 2 else 'bad'} " * (40 + 200 * (i % 3))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    held = []
    fit = Q.fit
    monkeypatch.setattr(Q, "fit", lambda bags, y, share: held.append(sum(map(len, bags))) or fit(bags, y, share))
    Q.train(docs, labels)
    Q.train(docs, labels, passages_at_most=60)
    Q.train(docs, labels, sample=5)
    assert held[0] > 100 and 40 < held[1] <= 60 and held[2] <= 70


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(n, Q.WIDTH)) for n in (1, 3, 2, 5)]
    y, w = np.array([0, 1, 1, 0.0]), np.array([1, 2, 1, 0.5])
    model = Q.fit(bags, y, 0.5)
    model.weights = {k: v.astype(float) for k, v in model.weights.items()}
    x, owner = np.concatenate(bags), np.repeat(np.arange(4), [len(b) for b in bags])

    def loss():
        p = model.forward(x, owner, 4)["p"]
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    for k, g in model.gradients(x, owner, y, w).items():
        at = tuple(0 for _ in g.shape)
        kept = model.weights[k][at]
        model.weights[k][at] = kept + 1e-5
        up = loss()
        model.weights[k][at] = kept - 1e-5
        down = loss()
        model.weights[k][at] = kept
        assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_classifier_edge_cases(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(0, 1), (3, 1), (None, 0), (6, None)], "doc_id long, quality int")
    assert Q.train(docs, none).constant == 0.5 and Q.train(docs, one).constant == 1.0
    assert Counter(r.doc_id for r in Q.score(docs, Q.Model(0.7)).collect()) == Counter(r.doc_id for r in docs.collect())
    two = spark.createDataFrame([(i, i % 2) for i in range(0, 90, 3)], "doc_id long, quality int")
    model = Q.train(docs, two)
    scored = defaultdict(set)
    for r in Q.score(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect():
        scored[r.text].add(r.score)
    assert Q.accepted(docs, model).columns == docs.columns
    assert Q.score(empty(spark), model).count() == 0 and Q.accepted(empty(spark), model).count() == 0


# ---- token store


def test_store_round_trip(spark):
    docs = documents(spark)
    encode = ids_of("word_bpe_49k.json", 1)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for doc, text in rows:
        ids = encode(text)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    store = S.write_store(docs, shared.scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)
    got = [tuple(r) for r in S.read_documents(docs, store).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    unknown = spark.createDataFrame([(10**9 + i, 0) for i in range(500)], "key long, ord int")
    assert store.locate(unknown).count() == 0


def test_keyed_access_reads_buckets_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_KEYS", 8)
    monkeypatch.setattr(S, "INDEX_FILE", 2)
    docs = documents(spark)
    encode = ids_of("word_bpe_49k.json", 1)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, seen, start = {}, Counter(), 0
    for doc, text in rows:
        want[doc, seen[doc]] = (start, encode(text))
        seen[doc] += 1
        start += len(want[doc, seen[doc] - 1][1])
    store = S.write_store(docs, shared.scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)
    assert store.buckets > 4
    keys = [(None, 0), rows[7][0:1] + (0,), (rows[30][0], 0), (10**12, 0), (rows[30][0], 99)]
    found = store.get(keys)
    got = {(r.key, r.ord): (r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found.collect()}
    assert got == {k: want[k] for k in keys if k in want}
    # Other parts' files and other buckets' aren't listed for the scan.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [", 1)[1][:200]
    assert store.get([]).count() == 0 and store.get([(10**12, 0)]).count() == 0


def test_wide_ids_and_narrow_ones(spark, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    for dtype, end in (("<u4", 1), (None, 69_999), ("<u4", 69_999)):
        store = S.write_store(docs, shared.scratch_path(spark, "t"), path, "word", end, dtype)
        got = {r.key: np.frombuffer(r.ids, "<u4").tolist() for r in store.get([(1, 0), (2, 0)]).collect()}
        assert store.dtype == "<u4" and got[2] == [end] and got[1] == ids_of("word_bpe_49k.json", end)("some words")
    for dtype in ("<u2", "<i8"):
        with pytest.raises(ValueError):
            S.write_store(docs, shared.scratch_path(spark, "t"), path, "word", 69_999, dtype)


def test_store_of_nothing(spark):
    store = S.write_store(empty(spark), shared.scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "word", 1)
    assert S.read_documents(empty(spark), store).count() == 0


def test_perfect_hash_is_minimal():
    keys = S.key_hash(np.arange(5000), np.zeros(5000, bool), np.zeros(5000, int))
    h = S.MinimalPerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    again = S.MinimalPerfectHash(blob=h.to_bytes())
    assert np.array_equal(again.slots(keys), h.slots(keys))


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_give_the_whole_texts_ids(name, kind):
    import pyarrow as pa

    from sparkolyte.llm.cached_tokens import encode_column

    odd = ["a  b", "a\n\n b", "x \n", "  lead", "it's, don't! we'll.", "tab\t x", "<|endoftext|> hi<|startoftext|>", "é,  z 　 q", "", "1234 56,7.8", "a\r\n b\x0b c", "!!  ??\n\n\n", "x\n é", "  x", "éa, b"]
    some = [*[t or "" for t in texts(1)], *odd]
    encode = ids_of(name, 7)
    for got, t in zip(encode_column(pa.array(some), public_tokenizers.path(name), kind, 7), some, strict=True):
        assert got.tolist() == encode(t), t[:80]


# ---- Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_id = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            up[find(i)] = find(by_id.setdefault(doc, i))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if sets[i] and doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def near_copies(n=150):
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, len(w)))] = f"x{rng.integers(0, 99)}"
        rows.append((10_000 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("part", [J.PART_DOCS, 16])
def test_components_by_brute_force(spark, part):
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(near_copies(), "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in J.near_duplicates(docs, part).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows), key=str)


def with_passage(n, own=60):
    """Documents of n, half of each a passage that all share, none linked; with the last two a copy is near."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"o{i}x{j}" for j in range(own))) for i in range(n)]
    return [*rows, (n, rows[-1][1] + " tail"), (n + 1, "head " + rows[-2][1])]


@pytest.mark.parametrize("n", [60, 120])
def test_a_shared_passage_sends_nothing_twice(spark, n):
    docs = spark.createDataFrame(with_passage(n), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.near_duplicates(docs, 8).collect()}
    assert got == {**{i: i for i in range(n)}, n: n - 1, n + 1: n - 2}
    members = docs.select("doc_id", F.lit(0).cast("long").alias("cluster"), F.col("doc_id").alias("label"))
    first = J.first_shingles(docs, members)
    # Only the four documents of the two linked pairs go on to meet others.
    assert {r.doc_id for r in first.select("doc_id").collect()} <= {n - 2, n - 1, n, n + 1}
    assert J.meeting_parts(first, 8, 10**6).count() <= 4 * 15


def test_parts_are_bounded(spark):
    rows = with_passage(200)
    keys = {d: J.band_keys(J.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0]).tobytes() for d, t in rows}
    members = spark.createDataFrame([(d, 0, 112, bytearray(keys[d]), 13) for d, _ in rows], "doc_id long, cluster long, n long, keys binary, parts long")
    dealt = J.star_parts(members, 16, 10**6)
    assert {r.doc_id for r in dealt.collect()} == {d for d, _ in rows} and dealt.count() <= 3 * len(rows)
    assert max(r["count"] for r in dealt.groupBy("cluster", "hot", "part").count().collect()) <= 64
    # A shingle that all documents need: those outside the largest component meet everyone, chunk by chunk.
    for labels in (200, 20, 2):
        first = spark.createDataFrame([(d, 0, 3, d % labels, 100, 7) for d, _ in rows], "doc_id long, cluster long, band int, label long, n long, token long")
        parts = defaultdict(set)
        for r in J.meeting_parts(first, 16, 10**6).collect():
            parts[r.often, r.part, r.other].add(r.doc_id)
        assert max(map(len, parts.values())) <= 3 * 16
        together = {(a, b) for p in parts.values() for a in p for b in p if a < b}
        assert together >= {(a, b) for a, _ in rows for b, _ in rows if a < b and a % labels != b % labels}


def test_long_documents_meet_once(spark):
    """Two documents with thousands of shingles to meet by lie in one part, not in one for each; sizes apart never meet."""
    first = [(d, 0, 30, d, 20_000, t) for d in (1, 2) for t in range(5000)] + [(3, 0, 31, 3, 40_000, t) for t in range(5000)]
    df = spark.createDataFrame(first, "doc_id long, cluster long, band int, label long, n long, token long")
    assert sorted(r.doc_id for r in J.meeting_parts(df, 512, 1 << 21).collect()) == [1, 2]
    short = [(i, " ".join(f"w{j}" for j in range(i * 40, i * 40 + 40))) for i in range(40)]
    docs = spark.createDataFrame([*short, (99, " ".join(t for _, t in short))], "doc_id long, text string")
    members = docs.select("doc_id", F.lit(0).cast("long").alias("cluster"), F.col("doc_id").alias("label"))
    assert J.first_shingles(docs, members).count() == 0
    # Many pairs, each by a few shingles of their own: parts of shingles are fewer rows than blocks.
    many = [(d, 0, 9, d, 40, d // 2 * 3 + k) for d in range(400) for k in range(3)]
    met = J.meeting_parts(spark.createDataFrame(many, df.schema), 16, 10**6).collect()
    assert len(met) <= 1200 and not any(r.often for r in met)
    parts = defaultdict(set)
    for r in met:
        parts[r.part, r.other].add(r.doc_id)
    assert all(any({d, d + 1} <= p for p in parts.values()) for d in range(0, 400, 2)) and max(map(len, parts.values())) <= 48


def star(n):
    """A document and n copies with edits of their own, linked with it and not with each other."""
    base = [f"b{i}" for i in range(240)]
    rows = [(500, " ".join(base))]
    for i in range(n):
        w = list(base)
        for k in range(5):
            w[(i * 7 + 48 * k) % 240] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("n", [60, 120])
def test_stars_are_linked_by_their_middle(spark, n):
    rows = star(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in J.near_duplicates(docs, 8).collect()} == {0}
    keys = {d: J.band_keys(J.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]).tobytes() for d, t in rows}
    members = spark.createDataFrame([(d, 0, 236, bytearray(keys[d]), -(-n // 8)) for d, _ in rows], "doc_id long, cluster long, n long, keys binary, parts long")
    dealt = J.star_parts(members, 8, 10**6)
    # Growing in proportion: once each, and the middle once a part.
    assert dealt.count() <= 1.5 * n
    assert max(r["count"] for r in dealt.groupBy("cluster", "hot", "part").count().collect()) <= 32


def test_families_close_to_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for family in range(6):
        for i in range(20):
            words = [f"c{j}" for j in range(100)] + [f"f{family}y{j}" for j in range(22 + family)]
            for _ in range(int(rng.integers(0, 3))):
                words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 999)}"
            rows.append((family * 100 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in J.near_duplicates(docs, 10).collect()]
    assert sorted(got) == sorted(brute_components(rows))


def test_tree_finds_every_link():
    sets = [np.unique(np.random.default_rng(s // 3).integers(0, 1 << 60, 40 + s // 3).astype(np.uint64)) for s in range(90)]
    pairs = J.SignatureTree(sets).links(list(range(90)))
    assert len(pairs) == 60


def test_keep_one(spark):
    docs = documents(spark)
    kept = J.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    want = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()]) if d == c}
    assert kept.columns == docs.columns
    assert set(ids) - {None} == want - {None} and len(ids) == len(set(ids))
    assert J.keep_one(empty(spark)).count() == 0 and J.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("bucket", [shared.BUCKET_EDGES, 40])
@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_connected_components(spark, monkeypatch, kind, bucket):
    monkeypatch.setattr(shared, "BUCKET_EDGES", bucket)
    monkeypatch.setattr(shared, "SMALL_ROWS", 100 if bucket == 40 else shared.SMALL_ROWS)
    rng = np.random.default_rng(12)
    edges = {
        "chain": [(i, i + 1) for i in range(200)],
        "star": [(500, i) for i in range(300)] + [(7, 900)],
        "random": [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)],
        "none": [(3, 3), (None, 4), (5, None)],
    }[kind]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    want = {x: find(x) for x in up if find(x) != x}
    df = spark.createDataFrame(edges + edges[:5], "u long, v long")
    assert {r.u: r.root for r in shared.components(df).collect()} == want


# ---- media


def pad(t):
    return t + b"\0" * (-len(t) % 64 or (0 if t else 64))


@pytest.mark.parametrize("payload", [b"", b"a", b"x" * 64, bytes(range(256)) * 40, b"\xff" * 9000, bytes(np.random.default_rng(1).integers(0, 256, 70_000, dtype=np.uint8))])
def test_media_round_trip(payload):
    media = V.write_avi(pad(payload), len(payload))
    frames, size, own = V.read_avi(media)
    assert b"".join(f.tobytes() for f in frames)[:size] == pad(payload) and own == len(payload)
    assert struct.unpack("<I", media[4:8])[0] == len(media) - 8


def test_frames_are_entropy_coded():
    text = " ".join(t or "" for t in texts(2)).encode()
    assert len(V.write_avi(pad(text), len(text))) < 1.02 * len(text)
    assert len(V.write_avi(b"a" * 64_000, 64_000)) < 20_000


def plain_decode(frame):
    """A lossless frame bit by bit."""
    (table,) = frame.tables.values()
    codes = {(size, code): s for s, (code, size) in V._codes(*table).items()}
    bits = "".join(f"{b:08b}" for b in frame.data.replace(b"\xff\x00", b"\xff"))
    at, out = 0, []
    for i in range(frame.rows * frame.columns):
        size = code = 0
        while (size, code) not in codes:
            size, code, at = size + 1, code << 1 | int(bits[at]), at + 1
        s = codes[size, code]
        v = int(bits[at : at + s] or "0", 2)
        at += s
        d = v if not s or v >> (s - 1) else v - (1 << s) + 1
        out.append(d + (out[i - 1] if i % frame.columns else out[i - frame.columns] if i else 128))
    return np.array(out).reshape(frame.rows, frame.columns)


def test_lossless_frames_by_brute_force():
    rng = np.random.default_rng(0)
    sizes = [(2, 4, 64), (1, 16, 64), (3, 5, 7), (1, 1, 1)]
    files = [f for shape in sizes for f in V.jpeg_frames(rng.integers(0, 256, shape, dtype=np.uint8) >> int(rng.integers(0, 7)))]
    parsed = [V.read_jpeg(f) for f in files]
    for got, frame in zip(V.lossless_samples(parsed), parsed, strict=True):
        assert np.array_equal(got, plain_decode(frame))


def baseline_file(planes, factors, tables):
    """A baseline JPEG of planes whose sizes are whole units, quantised by 2; the standard's tables, in the file or left out."""
    dct = lambda b: V._COSINE @ (b.astype(float) - 128) @ V._COSINE.T
    codes = {k: V._codes(*t) for k, t in V.STANDARD.items()}
    bits = []

    def put(value, size):
        bits.extend(int(x) for x in f"{value:0{size}b}" if size)

    def number(v):
        n = abs(v).bit_length()
        put(v if v >= 0 else v + (1 << n) - 1, n)

    before = [0] * len(planes)
    down, across = planes[0].shape[0] // 8 // factors[0][1], planes[0].shape[1] // 8 // factors[0][0]
    for y in range(down):
        for x in range(across):
            for c, (plane, (h, v)) in enumerate(zip(planes, factors, strict=True)):
                for by in range(v):
                    for bx in range(h):
                        r, q = (y * v + by) * 8, (x * h + bx) * 8
                        z = np.rint(dct(plane[r : r + 8, q : q + 8]) / 2).astype(int).ravel()[V.ZIGZAG].tolist()
                        t = min(c, 1)
                        d, before[c] = z[0] - before[c], z[0]
                        put(*codes[0, t][abs(d).bit_length()])
                        number(d)
                        run = 0
                        for i in range(1, 64):
                            if not any(z[i:]):
                                put(*codes[1, t][0])
                                break
                            if not z[i]:
                                run += 1
                                continue
                            while run > 15:
                                put(*codes[1, t][0xF0])
                                run -= 16
                            put(*codes[1, t][run << 4 | abs(z[i]).bit_length()])
                            number(z[i])
                            run = 0
    bits += [1] * (-len(bits) % 8)
    data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + part(0xE0, b"AVI1") + part(0xDB, b"\0" + bytes([2] * 64))
    if tables:
        out += b"".join(part(0xC4, bytes([k[0] << 4 | k[1], *t[0], *t[1]])) for k, t in V.STANDARD.items())
    frame = struct.pack(">BHHB", 8, *planes[0].shape, len(planes)) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(factors))
    scan = bytes([len(planes)]) + b"".join(bytes([c + 1, 17 * min(c, 1)]) for c in range(len(planes))) + b"\0\x3f\0"
    return out + part(0xC0, frame) + part(0xDA, scan) + data + b"\xff\xd9"


@pytest.mark.parametrize("tables", [True, False])
@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_baseline_frames_of_other_writers(factors, tables):
    rng = np.random.default_rng(3)
    smooth = lambda r, c: np.clip(np.add.outer(np.arange(r) * 3, np.arange(c) * 2) + rng.integers(0, 40, (r, c)), 0, 255)
    planes = [smooth(32, 48), *[smooth(32 // factors[0][1], 48 // factors[0][0]) for _ in factors[1:]]]
    file = baseline_file(planes, factors, tables)
    got = V.baseline_luma(V.read_jpeg(file))
    assert got.shape == (32, 48) and np.abs(got.astype(int) - planes[0]).max() <= 6
    chunk = lambda n, b: n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) & 1)
    movi = chunk(b"LIST", b"movi" + chunk(b"01wb", b"sound") + chunk(b"LIST", b"rec " + chunk(b"00dc", file)) + chunk(b"00dc", file))
    avih = chunk(b"LIST", b"hdrl" + chunk(b"avih", struct.pack("<14I", 100_000, *[0] * 13)))
    (row,) = V.read_files([chunk(b"RIFF", b"AVI " + avih + movi)])
    assert row[-1] is None and row[6] == 2 and row[8][0]["end_ms"] == 200 and row[1] == 2 * 32 * 48


def test_broken_files_give_rows(spark):
    good = V.write_avi(b"ab" * 2000, 3990)
    no_index = good[: good.index(b"idx1")]
    broken = [good[:k] for k in (0, 3, 20, 300, 700, len(good) // 2)] + [b"no file", b"RIFF\0\0\0\0AVI ", None]
    flipped = good.replace(b"\xff\xc3", b"\xff\xc2", 1)
    files = [good, no_index, flipped, *broken]
    docs = spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")
    got = {r.doc_id: r for r in V.read_media(docs).collect()}
    assert got[0].error is None and got[0].n_bytes == 3990 and got[1].payload_sha256 == got[0].payload_sha256
    assert all(got[i].error and got[i].n_bytes is None and got[i].clips is None for i in range(2, len(files)))
    for f in [f for f in files[2:] if f is not None]:
        with pytest.raises(ValueError):
            V.read_avi(f)
    rng = np.random.default_rng(0)
    for _ in range(200):
        f = bytearray(good)
        for at in rng.integers(0, len(f), 3):
            f[at] = int(rng.integers(0, 256))
        assert len(V.read_files([bytes(f)])) == 1


def test_shots_are_cut():
    dark, light = np.zeros((10, 16)), np.zeros((10, 16))
    dark[:, 0], light[:, 15] = 1, 1
    assert V.shots(np.concatenate([dark, light])) == [0, 10]


def brute_feature(payload):
    """Frames by rows of 64, grey histograms, shots and the query's feature string."""
    rows = min(V.HEIGHT, len(payload) // 64)
    step = rows * 64
    frames = [payload[i : i + step].ljust(step, b"\0") for i in range(0, len(payload), step)]
    hist = [[sum(b >> 4 == g for b in f) / step for g in range(16)] for f in frames]
    starts, seen = [0], []
    for t in range(1, len(hist)):
        d = sum(abs(a - b) for a, b in zip(hist[t], hist[t - 1], strict=True)) / 2
        spread = float(np.std(seen)) if len(seen) > 1 else 0.0
        if d > max(0.1, (float(np.mean(seen)) if seen else 0.0) + 2.5 * spread):
            starts, seen = [*starts, t], []
        else:
            seen.append(d)
    ends = [*(s - 1 for s in starts[1:]), len(frames) - 1]
    mean = [sum(h[g] for h in hist) / len(hist) for g in range(16)]
    return f"frames={len(frames)};clips=" + ",".join(f"{a}-{b}" for a, b in zip(starts, ends, strict=True)), mean


def test_media_query(spark):
    got = {r.doc_id: r for r in queries.op6_avi_media(spark, SF).collect()}
    for r in shared.table(spark, SF, "documents").collect():
        p = pad((r.text or "").encode())
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        head, mean = brute_feature(p)
        assert g.feature.rsplit(";", 1)[0] == head
        assert np.allclose([int(x) / 1000 for x in g.feature.rsplit(";", 1)[1].split(",")], mean, atol=6e-4)
    docs = documents(spark)
    read = V.read_media(V.store_media(docs))
    assert read.count() == docs.count() and V.clip_rows(read).count() >= docs.count()
    assert V.read_media(V.store_media(empty(spark))).count() == 0


# ---- packing


def test_every_id_is_packed_once(spark):
    docs = documents(spark)
    encode = ids_of("byte_bpe_50k.json", 0)
    rows = B.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_docs=16).collect()
    sequences = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    want = Counter((r.doc_id, tuple(encode(r.text))) for r in docs.collect())
    for (doc, ids), n in want.items():
        got = sorted(pieces[doc, len(ids)])
        flat = b"".join(i for _, i in got)
        assert len(flat) == 4 * len(ids) * n
        if n == 1:
            assert np.frombuffer(flat, "<u4").tolist() == list(ids)
    assert B.pack(empty(spark), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def brute_sequences(texts, sizes):
    """Windows by exact frequencies, the formula of BM25 word by word, and the greedy rule."""
    bags = [Counter(re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))) for t in texts]
    df = Counter(w for b in bags for w in b)
    n, mean = len(texts), max(1.0, sum(sum(b.values()) for b in bags) / len(texts))

    def score(seed, d):
        length, total = sum(bags[d].values()), 0.0
        for w in bags[seed]:
            if tf := bags[d][w]:
                idf = max(0.0, np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)))
                total += idf * tf * (B.K1 + 1) / (tf + B.K1 * (1 - B.B + B.B * length / mean))
        return total

    left, out = [s % B.WINDOW for s in sizes], []
    for seed in sorted(range(n), key=lambda d: (-left[d], d)):
        if not left[seed]:
            continue
        window, space, left[seed] = [seed], B.WINDOW - left[seed], 0
        by = sorted(range(n), key=lambda d: (-round(score(seed, d), 4), d))
        asked = []
        while space and any(left):
            asked = [d for d in asked if left[d]] or [d for d in by if left[d]][: B.NEIGHBOURS]
            d = next((d for d in asked if left[d] <= space), asked[0])
            take = min(space, left[d])
            left[d] -= take
            space -= take
            window.append(d)
        out.append(window)
    return out


@pytest.mark.parametrize("dense", [0, 3, 10**6])
def test_windows_by_brute_force(monkeypatch, dense):
    monkeypatch.setattr(B, "DENSE", dense)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'abc'[i % 3]}{int(x)}" for x in rng.zipf(1.4, int(rng.integers(20, 90))) % 200) for i in range(70)]
    texts += [texts[0], texts[0], texts[5] + " more", "", "one"]
    joined = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = B.term_counts(joined, offsets)
    exact = Counter(found[1].tolist())
    statistics = B.Statistics(np.zeros((3, 1 << B.SKETCH_BITS)), len(texts), int(found[3].sum()))
    monkeypatch.setattr(statistics, "frequency", lambda w: np.array([exact[x] for x in w.tolist()], np.float32))
    shard = B.Shard(statistics)
    shard.add(*found)
    shard.doc = list(range(len(texts)))
    sizes = [len(t.split()) * 9 + 1 for t in texts]
    shard.ids = [np.zeros(k, np.uint16) for k in sizes]
    got = [[d for d, _, _ in w] for w in shard.pack()]
    want = brute_sequences(texts, sizes)
    whole = [w for w in got if len(w) > 1][: len(want) - 1]
    assert whole == [w for w in want if len(w) > 1][: len(whole)] and len(whole) > 10


def test_sketch_never_falls_short(spark):
    docs = documents(spark)
    statistics = B.corpus_statistics(docs)
    exact = Counter(w for r in docs.collect() for w in set(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())))
    for w, n in list(exact.items())[:500]:
        data = np.frombuffer(w, np.uint8)
        h = B.term_counts(data, np.array([0, len(data)]))[1]
        assert n <= statistics.frequency(h)[0] <= n + 5
    assert statistics.docs == docs.count()


def test_routing_counts_all_documents(spark, monkeypatch):
    """The ranges that route stand on every document's words, in a table of more than 20,000."""
    route, seen = B._route, []
    monkeypatch.setattr(B, "_route", lambda statistics: seen.append(statistics) or route(statistics))
    text = F.concat(F.lit("every m"), F.col("id") % 40, F.when(F.col("id") % 1000 == 7, " seldom").otherwise(""))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows = B.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    (statistics,) = seen
    assert (statistics.docs, statistics.words) == (30_000, 60_030)
    for w, n in (("every", 30_000), ("m3", 750), ("seldom", 30)):
        assert statistics.frequency(B.term_counts(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1]) == [n]
    assert rows.select("doc_id").distinct().count() == 30_000


def test_word_hashes_by_brute_force():
    """Words and their hashes over rows that meet inside words, of all lengths round 8 and 64 bytes."""
    rng = np.random.default_rng(12)
    words = ["a" * n for n in range(1, 150)] + ["a" * n + "b" for n in range(149)] + ["Ab", "aB\0", "é" * 40, "É" * 40, "\0"]
    for _ in range(20):
        texts = ["".join(str(rng.choice(words)) + str(rng.choice(["", " ", "\n", "\x0b "])) for _ in range(rng.integers(0, 40))) for _ in range(9)]
        bags = [Counter(re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower())) for t in texts]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        row, word, count, lengths = B.term_counts(data, offsets)
        assert lengths.tolist() == [sum(b.values()) for b in bags]
        for i, b in enumerate(bags):
            own = {w: int(B.term_counts(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1][0]) for w in b}
            assert dict(zip(word[row == i].tolist(), count[row == i].tolist(), strict=True)) == {own[w]: n for w, n in b.items()}
            assert len(set(own.values())) == len(b)


def test_copies_meet_in_a_shard(spark):
    """Pairs of near copies, far apart in the input, over shards a twentieth of it."""
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 120) % 3000) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, t + f" tail{i}") for i, t in enumerate(base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    together = defaultdict(set)
    for r in B.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_docs=15).collect():
        together[r.sequence_id >> 32].add(r.doc_id)
        together[r.doc_id].add(r.sequence_id)
    near = sum(any(abs(a - b) < 20 for a in together[i] for b in together[1000 + i]) for i in range(150))
    assert near > 100


# ---- fingerprints


def test_fingerprints_by_brute_force(spark):
    docs = documents(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in C.fingerprint_pairs(docs).collect())
    want = Counter()
    for (doc, text), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(text) // 3
        new = text[: len(text) - k] + after[:k]
        want[doc, len(text), hashlib.sha256(new.encode()).hexdigest(), C.encode(C.fingerprints([text])[0])] += 1
    assert got == want
    assert C.fingerprint_pairs(empty(spark)).count() == 0


def test_likeness():
    t = [x for x in texts(3) if x and len(x) > 400]
    own = C.fingerprints(t)
    edited = C.fingerprints([x[: len(x) * 2 // 3] + y[: len(x) // 3] for x, y in zip(t, t[1:] + t[:1], strict=True)])
    moved = C.fingerprints(["put before " + x for x in t])
    assert np.mean([C.likeness(a, b) for a, b in zip(own, edited, strict=True)]) > 0.45
    assert np.mean([C.likeness(a, b) for a, b in zip(own, moved, strict=True)]) > 0.7
    assert C.likeness(own[0], own[0]) == 1 and C.likeness(set(), set()) == 1 and C.likeness(set(), own[0]) == 0


# ---- licences


def brute_places(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for phrase, label in A.PHRASES:
        p = phrase.encode().split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_places_by_brute_force(spark):
    extra = ["under the MIT License under the mit license", "cc by nc cc by nc by nc", "Apache License, Version 2.0", "xunder the mit license", "é the mit license under the under the mit license version 2"]
    docs = documents(spark).select("text").union(spark.createDataFrame([(t,) for t in extra], "text string"))
    docs = docs.withColumn("doc_id", F.monotonically_increasing_id()).cache()
    want = {r.doc_id: brute_places(r.text) for r in docs.collect()}
    for r in A.scan_licences(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert A.scan_licences(empty(spark)).count() == 0


def test_templates_are_chained(spark):
    text, label = A.TEMPLATES[0]
    w = text.split()
    broken = " ".join(["Intro", *w[:12], "something", "else", *w[12:], "end"])
    rows = [(1, broken), (2, " ".join(w[:6])), (3, "plain words of no licence"), (4, f"{text} x y {text} z {broken}"), (5, "// SPDX-License-Identifier: BSD-3-Clause\n")]
    got = {r.doc_id: r for r in A.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == label and got[1].n_base == 0 and got[1].spans[0].first == 1 and got[1].score == 1
    assert got[2].labels == "" and 0 < got[2].score < 0.6 and got[3].score == 0
    assert [s.first for s in got[4].spans] == [0, len(w) + 2, 2 * len(w) + 4]
    assert got[5].labels == "bsd-3" and got[5].base_labels == "" and got[5].n_base == 0 and got[5].score == 1


@pytest.mark.parametrize("share,found", [(1.0, True), (0.75, True), (0.3, False)])
def test_parts_of_every_paragraph(share, found):
    """A paragraph's first or last words, edited here and there, among words of no licence."""
    scanner, rng = A.Scanner(), np.random.default_rng(5)
    for text, label in A.TEMPLATES:
        w = text.split()
        n = max(A.LONG, round(share * len(w)))
        some = list(w[:n] if rng.random() < 0.5 else w[-n:])
        if found and n > 30:
            some[n // 2] = "changed"
        doc = " ".join(["zq"] * 5 + some + ["qz"] * 5).upper().encode()
        ((_, n_base, _, _, _, labels, score, spans),) = scanner.scan(np.frombuffer(doc, np.uint8), np.array([0, len(doc)]))
        if found:
            assert label in labels.split(",") and score >= 0.6 and any(s["label"] == label for s in spans), (label, text)
        elif len(w) > 20:
            # No paragraph but one that has the same words is given.
            assert all(any(" ".join(some) in t for t, x in A.TEMPLATES if x == y) or score >= 0.6 for y in filter(None, labels.split(",")))


def brute_chain(found):
    """The most words that a chain covers, by trying all chains."""

    def best(last, left):
        most = 0
        for k, (a, b, p, q) in enumerate(left):
            if last is None:
                most = max(most, q - p + best((b, q), left[k + 1 :]))
            else:
                twice = max(0, last[0] - a, last[1] - p)
                if a - last[0] <= A.GAP and twice < q - p and last[0] < b and last[1] < q:
                    most = max(most, q - p - twice + best((b, q), left[k + 1 :]))
        return most

    return best(None, found)


def test_chains_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(300):
        found, at = [], 0
        for _ in range(int(rng.integers(1, 8))):
            at += int(rng.integers(1, 14))
            size, p = int(rng.integers(5, 12)), int(rng.integers(0, 40))
            found.append((at, at + size, p, p + size))
        found.sort(key=lambda m: m[1])
        gain, chain = A.best_chain(found)
        assert gain == brute_chain(found)
        assert all(x[1] <= y[0] or x[1] <= y[1] for x, y in zip(chain, chain[1:], strict=False))


def test_matching_statistics_by_brute_force():
    scanner = A.Scanner()
    rng = np.random.default_rng(0)
    vocabulary = len(scanner.hashes)
    flat = [s for s in scanner.sequences]
    number = {w: i for i, w in enumerate(sorted({w for s in flat for w in s}))}
    coded = [[number[w] for w in s] for s in flat]
    subs = {tuple(s[i:j]) for s in coded for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    code = []
    for _ in range(60):
        s = coded[int(rng.integers(len(coded)))]
        a = int(rng.integers(len(s)))
        code += s[a : a + int(rng.integers(1, 9))]
        if rng.random() < 0.3:
            code.append(-1)
    code = np.array(code)
    assert code.max() < vocabulary
    _, longest = scanner.statistics(code, np.zeros(len(code), int))
    for i in range(len(code)):
        run = i
        while run >= 0 and code[run] >= 0:
            run -= 1
        end = i
        while end + 1 < len(code) and code[end + 1] >= 0:
            end += 1
        if code[i] < 0 or end - run < scanner.shortest:
            continue
        best = max((n for n in range(1, i - run + 1) if tuple(code[i - n + 1 : i + 1].tolist()) in subs), default=0)
        assert longest[i] == best
