"""Texts longer than the kernels' chunks, fingerprints by brute force, and the pipeline stage by stage."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from sparkolyte.llm import avi_media as V
from sparkolyte.llm import bm25_pack as B
from sparkolyte.llm import chunk_fingerprint as C
from sparkolyte.llm import jaccard_tree as J
from sparkolyte.llm import licence_automaton as A
from sparkolyte.llm import line_dedup as L
from sparkolyte.llm import quality_mil as Q
from sparkolyte.llm import shared
from sparkolyte.llm.cached_tokens import encode_column
from sparkolyte.llm.textbytes import CHUNK_BYTES, text_chunks

from .fixtures import texts, words
from .test_free import brute_components, brute_places, crc, ids_of, plain_score, shingles
from .test_native import brute_runs


@pytest.fixture(scope="module")
def long():
    """Over a chunk's bytes, with letters of several bytes and a phrase at the very end."""
    import random

    rng = random.Random(5)
    some = [words(rng, 40) + (" é漢" if i % 9 == 0 else "") for i in range(6200)]
    text = "\n".join(some) + " under the mit license"
    assert len(text.encode()) > CHUNK_BYTES
    return text


def around(long):
    return ["before it", long, "", "after it", long + " x"]


def test_tokens_of_long_texts(long):
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        got = list(encode_column(pa.array(around(long)), public_tokenizers.path(name), kind, 3))
        assert got[1].tolist() == [*t.encode(long, add_special_tokens=False).ids, 3]
        assert len(got) == 5 and got[2].tolist() == [3]


def test_sets_scores_places_and_media_of_long_texts(long):
    column = pa.array(around(long))
    sets = [s for _, _, d, o in text_chunks(column) for s in J.shingle_sets(d, o)]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in around(long)]
    assert J.linked(sets[1], sets[4]) and not J.linked(sets[0], sets[1])
    rng = np.random.default_rng(0)
    model = Q.fit([rng.normal(size=(3, Q.WIDTH)) for _ in range(8)], np.array([0, 1] * 4, float), 0.5)
    score = np.concatenate([model.score(*Q.passages(d, o), len(o) - 1) for _, _, d, o in text_chunks(column)])
    assert score[1] == pytest.approx(plain_score(model, long), abs=1e-3) and score[3] == pytest.approx(plain_score(model, "after it"), abs=1e-3)
    found = [r for _, _, d, o in text_chunks(column) for r in A.Scanner().scan(d, o)]
    assert [tuple(r[:5]) for r in found] == [brute_places(t) for t in around(long)] and found[1][1] == 1
    payload = long.encode() + b"\0" * (-len(long.encode()) % 64)
    frames, size, own = V.read_avi(V.write_avi(payload, len(long.encode())))
    assert b"".join(f.tobytes() for f in frames)[:size] == payload and own == len(long.encode())


def brute_fingerprint(text):
    """Chunks by a running gear hash, byte by byte; lengths alone, the digests are the module's."""
    data = text.encode()
    g = C._GEAR.tolist()
    ends, start = [], 0
    while start < len(data):
        h, end = 0, min(start + C.LONGEST, len(data))
        for i in range(start, end):
            h = (h << 1) + g[data[i]] & 0xFFFFFFFF
            bits = C.STRICT_BITS if i - start + 1 <= C.NORMAL else C.LOOSE_BITS
            if i - start + 1 >= C.SHORTEST and h >> (32 - bits) == 0:
                end = i + 1
                break
        ends.append(end)
        start = end
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def test_fingerprints_by_brute_force(spark, long):
    some = [t or "" for t in texts(6)] + [long[:60_000]]
    got = C.fingerprints(around(long) + some)
    digests = {}
    for own, text in zip(got, around(long) + some, strict=True):
        chunks = brute_fingerprint(text)
        assert sorted(k & 0xFFFF for k in own) == sorted(len(c) for c in set(chunks))
        # One digest for each chunk's bytes, and no other.
        for c in set(chunks):
            (one,) = C.fingerprints([c.decode("utf-8", "surrogateescape")]) if len(brute_fingerprint_of_bytes(c)) == 1 and is_text(c) else ({None},)
            if one != {None}:
                assert one <= own
                digests[c] = one
    assert len({frozenset(v) for v in digests.values()}) == len(digests) > 50
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(some)], "doc_id long, text string")
    for r in C.fingerprint_pairs(docs).collect():
        text, after = some[r.doc_id], some[r.doc_id - 1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]

        def share(one, other):
            a, b = set(brute_fingerprint(one)), set(brute_fingerprint(other))
            return sum(len(c) for c in a & b) / sum(map(len, a)) if a else float(not b)

        assert r.near_edited == pytest.approx(share(text, edited)) and r.near_next == pytest.approx(share(text, after))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()


def is_text(c):
    try:
        c.decode()
        return True
    except UnicodeDecodeError:
        return False


def brute_fingerprint_of_bytes(c):
    return brute_fingerprint(c.decode()) if is_text(c) else []


# ---- the pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double, slot long, _row int, k0 long, part int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), i, 0.5, 1, i, 2, 3) for i, t in enumerate(texts(8, 90))]
    rows += [rows[30], (500, rows[31][1], "en", "s1", 1, 1, 0.0, 1, 1, 1, 1), (None, "no id here at all", None, "s1", 3, 1, 0.0, 1, 1, 1, 1)]
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(str(root / "documents.parquet"))
    labels = [(i, int(i % 5 != 0), 0) for i in range(0, 100, 2)] + [(4, 1, None), (None, 1, 0), (6, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def test_stages_by_brute_force(spark, folder):
    docs = shared.table(spark, folder, "documents")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        held[name] = docs
        docs = shared.materialize(stage(spark, docs, folder), name.replace(" ", "_"))
        assert docs.columns == columns, name
        assert [f.dataType for f in docs.schema] == [f.dataType for f in held[name].schema]
    stages = [*held.values(), docs]
    before, kept, cut, single, mixed = ([(r.doc_id, r.text) for r in d.collect()] for d in stages)
    # What the classifier keeps it keeps whole; rows of one text go or stay together.
    assert not Counter(kept) - Counter(before) and 0 < len(kept) <= len(before)
    assert {t for _, t in kept}.isdisjoint({t for _, t in (Counter(before) - Counter(kept))})
    want = brute_runs(kept)
    # A text becomes empty only by the cut, and then goes; those that were empty stay.
    left = Counter((d, want[d, t]) for d, t in kept if not (want[d, t] == "" and t != ""))
    assert Counter(cut) == left
    least = {}
    for doc, _, root in brute_components(cut):
        if doc is not None:
            least[doc] = min(root, least.get(doc, root))
    assert Counter(d for d, _ in single) == Counter({d: 1 for d in least if least[d] == d}) + Counter({None: sum(d is None for d, _ in cut)})
    assert set(mixed) == set(single)
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[-1][1](spark, stages[-1], folder).collect():
        pieces[r.doc_id].append(r)
    encode = ids_of("byte_bpe_50k.json", 0)
    times = Counter(mixed)
    for doc in {d for d, _ in single}:
        ids = Counter()
        for (d, t), n in times.items():
            if d == doc:
                ids.update({crc(encode(t)): n * len(encode(t))})
        assert sum(r.length for r in pieces[doc]) == sum(ids.values())
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_equal_runs_are_cut_alike_wherever_they_lie(spark):
    run = [f"shared {i}" for i in range(9)]
    rows = [(d, "\n".join([f"own {d}", *run[d % 4 :], f"end {d}"])) for d in range(12)]
    got = {r.doc_id: r.text for r in L.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: t for (d, _), t in brute_runs(rows).items()}
    assert re.fullmatch(r"own 4\nend 4", got[4])


def test_large_shards_are_cut_in_bytes(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (400 if i % 5 else 4000)) for i in range(60)], "doc_id long, text string").coalesce(1)
    rows = B.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=20_000).collect()
    sizes = {r.doc_id: r.doc_tokens for r in rows}
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == sizes and len(got) == 60
