"""Line dedup, reply trees and Pfair mixing."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkolyte.llm import chat_trees as C
from sparkolyte.llm import line_dedup as L
from sparkolyte.llm import pfair_mix as P
from sparkolyte.llm import queries

from ..comparing import duck, of_duck, of_spark
from .fixtures import documents, empty

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert of_spark(queries.queries()[name](spark, SF)) == of_duck(duck(SF), queries.oracle_sql()[name])


# ---- line dedup


def brute_runs(rows):
    seen, out = {}, {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[doc, text] = None
            continue
        lines, gone = text.split("\n"), set()
        for i, pair in enumerate(zip(lines, lines[1:])):
            if re.search(r"\S", "".join(pair)) and seen.setdefault(pair, (doc, text, i)) != (doc, text, i):
                gone |= {i, i + 1}
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[doc, text] = text if not gone else left if re.search(r"\S", left) else ""
    return out


def test_line_dedup_by_brute_force(spark):
    docs = documents(spark)
    before = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_runs(before)
    after = L.drop_repeated_lines(docs.withColumn("was", F.col("text"))).collect()
    assert Counter((r.doc_id, r.was) for r in after) == Counter(before)
    for r in after:
        assert r.text == want[r.doc_id, r.was], r.doc_id
        assert r.n_lines == (-1 if r.was is None else r.was.count("\n") + 1)
        assert r.emptied == (r.text == "" and r.n_removed > 0)
    assert sum(r.n_removed for r in after) > 5


def test_line_dedup_keeps_columns(spark):
    docs = documents(spark)
    out = L.deduplicated(docs)
    assert out.columns == docs.columns
    assert out.where("text is not null and n_chars != length(text)").count() == 0
    assert L.deduplicated(empty(spark)).count() == 0 and L.drop_repeated_lines(empty(spark)).count() == 0


def test_no_line_is_lost(spark):
    docs = documents(spark)
    lines = lambda rows: {x for r in rows for x in (r.text or "").split("\n") if x.strip()}
    assert lines(docs.collect()) == lines(L.drop_repeated_lines(docs).collect())


def test_equal_hashes_are_compared_by_bytes(spark, monkeypatch):
    same = lambda *c: F.lit(7).cast("long") if c == ("pair",) else hashed(*c)
    hashed = F.xxhash64
    rows = [(d, f"a{d % 3}\nb\nc{d}\nd{d % 2}\ne") for d in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(L.F, "xxhash64", lambda *c: hashed(*c) % 3 if not isinstance(c[0], str) else same(*c))
    got = {r.doc_id: r.text for r in L.drop_repeated_lines(docs).collect()}
    assert got == {d: t for (d, _), t in brute_runs(rows).items()}


def test_runs_by_brute_force(spark):
    docs = documents(spark)
    want = brute_runs([(r.doc_id, r.text) for r in docs.collect()])
    after = L.deduplicated(docs.withColumn("was", F.col("text"))).collect()
    assert after and all(r.text == want[r.doc_id, r.was] for r in after)
    left = {(r.doc_id, r.was) for r in after}
    assert all(k in left or t == "" for k, t in want.items())


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6])
def test_short_repeated_passages_go(spark, n):
    passage = [f"repeated line {n} {i * i}" for i in range(n)]
    rows = [(d, "\n".join([f"own {d} a", f"own {d} b", *passage, f"own {d} c"])) for d in range(12)]
    got = {r.doc_id: r.text for r in L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]
    assert all(got[d] == f"own {d} a\nown {d} b\nown {d} c" for d in range(1, 12))


# ---- reply trees


def brute_paths(messages):
    parent, score, children = {}, {}, defaultdict(list)
    for tree, i, p, _, _, s in messages:
        parent[tree, i], score[tree, i] = p, s or 0.0
    for (tree, i), p in parent.items():
        if (tree, p) in parent:
            children[tree, p].append(i)
    out = {}
    for tree, i in parent:
        if children[tree, i]:
            continue
        path, at, seen = [], i, set()
        while (tree, at) in parent and at not in seen:
            seen.add(at)
            path.append(at)
            at = parent[tree, at]
        if (tree, at) in parent:
            continue
        mean = sum(score[tree, j] for j in path) / len(path)
        out.setdefault(tree, []).append((-mean, i, path[::-1]))
    return {t: sorted(v) for t, v in out.items()}


def messages():
    rows = []
    for tree in range(4):
        for i in range(1, 40):
            rows.append((tree, i, i // 2 if tree % 2 else (i - 1) or None, ("user", "assistant")[i % 2], f"t{i} </s>[INST] \\ < é", float(i * 7 % 11) if i % 5 else None))
    rows += [(9, 1, 2, "user", "a", 1.0), (9, 2, 1, "user", "b", 1.0), (9, 3, 77, None, None, None), (9, 3, 77, None, None, None)]
    return rows


KIND = "tree long, id long, parent long, role string, text string, score double"


@pytest.mark.parametrize("branches", [1, 3])
def test_best_paths_by_brute_force(spark, branches):
    df = spark.createDataFrame(messages(), KIND).withColumn("_n", F.lit(1))
    got = defaultdict(list)
    for r in C.best_paths(df, branches).collect():
        got[r.tree, r.branch].append((r.depth, r.id))
    want = {(t, b): list(enumerate(p, 1)) for t, v in brute_paths(messages()).items() for b, (_, _, p) in enumerate(v[:branches], 1)}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_formats_read_back(spark):
    df = spark.createDataFrame(messages(), KIND)
    chats = C.format_chats(df, 2)
    by = {(r[0], r[1]): r for r in df.select("tree", "id", "role", "text").collect()}
    paths = {(t, b): p for t, v in brute_paths(messages()).items() for b, (_, _, p) in enumerate(v[:2], 1)}
    rows = C.read_chats(chats).collect()
    assert len(rows) == len(paths)
    for r in rows:
        turns = [(by[r.tree, i].role or "", by[r.tree, i].text or "") for i in paths[r.tree, r.branch]]
        assert [tuple(t) for t in r.turns] == turns
        assert list(r.loss) == [t for role, t in turns if role == "assistant"]


def test_conversations_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "x"), (2, None, "assistant", ""), (None, 0, "assistant", "[\\<]")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash"))
    got = {r.tree: r for r in C.read_chats(C.format_chats(C.conversations_as_messages(df))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", ""), ("user", ""), ("", "x")]
    assert list(got[2].loss) == [""] and list(got[None].loss) == ["[\\<]"]
    assert C.format_chats(spark.createDataFrame([], KIND)).count() == 0


# ---- mixing


def test_shares_hold_in_every_prefix(spark):
    docs = spark.createDataFrame([(i, "abc"[min(2, i % 7)]) for i in range(900)], "doc_id long, source string")
    weights = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "source string, weight double")
    plan = {r.source: r for r in P.sources(docs, weights, block_docs=8, units=10).collect()}
    assert {s: r.units for s, r in plan.items()} == {"a": 5, "b": 3, "c": 2}
    order = {t: s for s, r in plan.items() for t in r.slots}
    assert sorted(order) == list(range(10))
    done = Counter()
    for t in range(10):
        done[order[t]] += 1
        for s, r in plan.items():
            assert abs(done[s] - (t + 1) * r.units / 10) < 1
    rows = P.mix(docs, weights, block_docs=8, units=10).collect()
    assert {r.doc_id for r in rows} == set(range(900))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    blocks = Counter((r.source) for r in {(r.source, r.number): r for r in rows}.values())
    end = max(r.slot for r in rows) + 1
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(blocks[s] - w * end) <= 2


def test_mixing_edge_cases(spark):
    docs = documents(spark)
    out = P.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert P.mix(empty(spark)).count() == 0 and P.mixed(empty(spark)).count() == 0
    bad = spark.createDataFrame([("s1", None), ("s2", -1.0), ("s3", 1.0)], "source string, weight double")
    assert {r.source for r in P.mix(docs, bad).collect()} == {"s3"}


def test_targets_hold_with_thousands_of_sources(spark):
    weights = {"hot": 134_600.0, "rare": 2.7, **{f"s{i}": 63.1 for i in range(3000)}}
    docs = spark.createDataFrame([("hot",)] * 64 + [(s,) for s in weights], "source string")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    plan = P.sources(docs, given).collect()
    assert len(plan) == len(weights)
    for r in plan:
        assert abs(r.units / r.total / (weights[r.source] / sum(weights.values())) - 1) <= P.TOLERANCE


def test_a_very_rare_source_is_passed_once(spark):
    docs = spark.createDataFrame([(i, "rare" if i < 3 else "ab"[i % 2]) for i in range(2000)], "doc_id long, source string")
    given = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("rare", 1e-4)], "source string, weight double")
    rows = P.mix(docs, given).select("doc_id", "source", "number", "slot", "release", "deadline").distinct().collect()
    assert sorted(r.doc_id for r in rows if r.source == "rare") == [0, 1, 2]
    assert {r.doc_id for r in rows} == set(range(2000))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    blocks = {r.slot: r.source for r in rows}
    assert sorted(blocks) == list(range(len(blocks)))
    for s, w in (("a", 0.5), ("b", 0.5), ("rare", 1e-4)):
        done = 0
        for t in range(len(blocks)):
            done += blocks[t] == s
            # Less than a block, and the tolerance of the share.
            assert abs(done - (t + 1) * w / 1.0001) < 1 + (t + 1) * w * P.TOLERANCE
