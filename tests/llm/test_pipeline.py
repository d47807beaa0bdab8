"""The pipeline's stages on small tables, and on tables with nothing in them."""

from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F
from sparkolyte.llm import bm25_pack, shared

from .fixtures import empty

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = shared.table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    labels = {r.doc_id: r.quality for r in shared.table(spark, SF, "labels").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = shared.materialize(stage(spark, docs, SF), name.replace(" ", "_"))
        assert found.columns == columns, name
        assert {r.doc_id for r in found.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = found
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.collect()}
            assert all(d in kept for d, q in labels.items() if q == 1)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in docs.collect()} <= set(before)


def test_packing_routes_by_all_documents(spark, monkeypatch):
    route, seen = bm25_pack._route, []
    monkeypatch.setattr(bm25_pack, "_route", lambda statistics: seen.append(statistics) or route(statistics))
    docs = spark.range(25_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("every m"), F.col("id") % 40).alias("text"))
    corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert [(s.docs, s.words) for s in seen] == [(25_000, 50_000)]


def test_packing_knows_exact_frequencies(spark, monkeypatch):
    """In a vocabulary beyond the sketch: words in a range, and those below that two documents of a partition have."""
    route, seen = bm25_pack._route, []
    monkeypatch.setattr(bm25_pack, "_route", lambda statistics: seen.append(statistics) or route(statistics))
    told, dealt = getattr(bm25_pack, "_rare_counts", None), []
    monkeypatch.setattr(bm25_pack, "_rare_counts", lambda d: dealt.append(d) or told(d), raising=False)
    own = F.expr("array_join(transform(sequence(1, 60), i -> concat('u', id * 100 + i)), ' ')")
    text = F.concat(F.lit("a"), F.col("id") % 6000, F.lit(" b"), F.col("id") % 4000, F.lit(" "), own)
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    corpus_pipeline.STAGES[-1][1](spark, docs, SF)

    def hashes(words):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        return bm25_pack.term_counts(data, np.concatenate(([0], np.cumsum([len(w) for w in words]))))[1]

    pairs, threes = hashes([f"a{i}" for i in range(6000)]), hashes([f"b{i}" for i in range(4000)])
    # The last range begins at 12,000 / 4096, between the two.
    assert set(seen[0].frequency(threes).tolist()) == {3}
    assert set(seen[0].frequency(pairs).tolist()) == {2}
    part = {r.doc_id: r.part for r in dealt[0].select("doc_id", "part").collect()}
    want = {(part[i], w, 2) for i, w in enumerate(pairs.tolist()) if part[i] == part[i + 6000]}
    found = [(r.part, w, n) for r in told(dealt[0]).collect() for w, n in zip(r.words, r.counts, strict=True)]
    assert len(found) == len(want) > 100 and set(found) == want


def test_a_partition_packs_by_the_counts_it_is_told(monkeypatch):
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    shard, used = bm25_pack.Shard, []
    monkeypatch.setattr(bm25_pack, "Shard", lambda statistics: used.append(statistics) or shard(statistics))
    word = [int(bm25_pack.term_counts(np.frombuffer(w, np.uint8), np.array([0, 1]))[1][0]) for w in (b"a", b"b", b"c")]
    known = bm25_pack.Statistics(None, 90_000, 200_000, word[:1], [50])
    lists = pa.list_(pa.int64())
    columns = [
        pa.array([None, None, 1, 2, 3], pa.int64()),
        pa.array([None, None, "a b c", "b", "c"]),
        pa.array([word[1:2], word[2:], None, None, None], lists),
        pa.array([[7], [3], None, None, None], lists),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "words", "counts"])
    run = bm25_pack._pack(public_tokenizers.path("byte_bpe_50k.json"), "byte", 0, known, 2, 1 << 20)
    found = pa.Table.from_batches(run(iter([batch])))
    assert sorted(set(found.column("doc_id").to_pylist())) == [1, 2, 3]
    # Every shard that held documents, and both rows of counts.
    assert all(s.frequency(np.array(word, np.uint64)).tolist() == [50, 7, 3] for s in used[1:]) and len(used) > 2


def test_nothing_in_nothing_out(spark, tmp_path):
    none = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
