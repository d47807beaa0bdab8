"""Quality classifier by attention over passages.

A text is cut into passages of PASSAGE_WORDS words. Each is encoded as byte-class shares, word statistics and hashed
words, then by a learned layer. Gated attention (Ilse et al. 2018) weighs the passages; its weights and the
classifier on the weighted passage are learned together from document labels alone. Scoring uses every passage of
every text.

The model is fitted on the driver from at most SAMPLE labelled documents of each class, drawn by a hash, with all
their passages; where these come to more than SAMPLE_PASSAGES, later documents of the draw are left out that don't fit.
Examples are weighted back to the classes' shares among all labels. Inputs of a score are texts alone. Null and empty
texts are one passage without words. Labels that are null are left out, and of several labels of one document the mean
counts, 1 from one half on; of rows that share a labelled doc_id the text with the least hash is learned from. Without
labels of both classes the score is the share of label 1 (0.5 without any). Rows that repeat are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .textbytes import EXACT, WORD, SpanHash, find_words, text_chunks

PASSAGE_WORDS = 64
HASHED = 128
#: Labelled documents of each class, and passages of all, that the model is fitted on at most.
SAMPLE = 1500
SAMPLE_PASSAGES = 250_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 14, 64, 0.01, 1e-4
THRESHOLD = 0.3
_CLASSES = np.full(256, 5, np.int64)
_CLASSES[97:123] = 0
_CLASSES[65:91] = 1
_CLASSES[48:58] = 2
_CLASSES[list(b" \t\n\x0b\x0c\r")] = 3
_CLASSES[0x80:] = 4
_CLASSES[list(b".,")] = 6
_CLASSES[10] = 7
_KINDS = 8
_STATS = 6
WIDTH = _KINDS + _STATS + HASHED


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32) and the row of each; every row has a passage at least."""
    start, end, row = find_words(data, offsets, WORD)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    number = np.maximum(1, -(-count // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(number)))
    n = int(base[-1])
    first = np.concatenate(([0], np.cumsum(count)))
    within = np.arange(len(row)) - first[row]
    passage = base[row] + within // PASSAGE_WORDS
    owner = np.repeat(np.arange(rows), number)
    # Bytes belong to the passage of the last word that began before them, in its own row.
    heads = offsets[owner].copy()
    later = np.flatnonzero(within % PASSAGE_WORDS == 0)
    later = later[within[later] > 0]
    heads[passage[later]] = start[later]
    place = np.repeat(np.arange(n), np.diff(np.append(heads, len(data))))
    kinds = np.bincount(place * _KINDS + _CLASSES[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(np.float32)
    size = np.maximum(1, kinds.sum(axis=1))
    words = np.bincount(passage, minlength=n).astype(np.float32)
    some = np.maximum(1, words)
    length = (end - start).astype(np.float32)
    h = SpanHash(data, EXACT)(start, end)
    term = (h >> np.uint64(64 - 7)).astype(np.int64)
    bag = np.bincount(passage * HASHED + term, minlength=n * HASHED).reshape(n, HASHED).astype(np.float32)
    order = np.lexsort((h, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order][fresh], minlength=n)
    mean = np.bincount(passage, length, minlength=n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(passage, length**2, minlength=n) / some - mean**2))
    single = np.bincount(passage, length == 1, minlength=n) / some
    shares = kinds / size[:, None]
    stats = np.stack(
        [words / PASSAGE_WORDS, distinct / some, mean / 10, spread / 10, single, (shares[:, 1] > 0.3).astype(np.float32)], axis=1
    )
    bag /= np.maximum(1, np.sqrt((bag**2).sum(axis=1, keepdims=True)))
    return np.concatenate([shares * 4, stats, bag], axis=1).astype(np.float32), owner


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Encoder, gated attention and classifier; without weights a constant score."""

    constant: float
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, owner: np.ndarray, rows: int) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        a = (t * s) @ w["attend"]
        top = np.full(rows, -np.inf)
        np.maximum.at(top, owner, a)
        e = np.exp(a - top[owner])
        a = e / np.bincount(owner, e, minlength=rows)[owner]
        z = np.zeros((rows, h.shape[1]))
        np.add.at(z, owner, h * a[:, None])
        p = _sigmoid(z @ w["out"] + w["out0"][0])
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": p}

    def score(self, x: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
        if self.weights is None:
            return np.full(rows, self.constant)
        return np.clip(self.forward(x, owner, rows)["p"], 0, 1)

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, owner, len(y))
        d = (f["p"] - y) * weight / weight.sum()
        g = {"out": f["z"].T @ d, "out0": np.array([d.sum()])}
        dz = d[:, None] * w["out"]
        inner = (f["h"] * dz[owner]).sum(axis=1)
        da = f["a"] * (inner - np.bincount(owner, f["a"] * inner, minlength=len(y))[owner])
        gated = f["t"] * f["s"]
        g["attend"] = gated.T @ da
        dg = da[:, None] * w["attend"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        g["tanh"], g["gate"] = f["h"].T @ dt, f["h"].T @ ds
        dh = f["a"][:, None] * dz[owner] + dt @ w["tanh"].T + ds @ w["gate"].T
        dh *= 1 - f["h"] ** 2
        g["encode"], g["encode0"] = x.T @ dh, dh.sum(axis=0)
        return g


def fit(bags: list[np.ndarray], y: np.ndarray, share: float, seed: int = 2) -> Model:
    """Adam over batches of documents; share is that of label 1 among all labels."""
    if len(set(y.tolist())) < 2:
        return Model(share)
    rng = np.random.default_rng(seed)
    scale = lambda a, b: rng.normal(0, a**-0.5, (a, b))
    model = Model(
        share,
        {
            "encode": scale(WIDTH, HIDDEN),
            "encode0": np.zeros(HIDDEN),
            "tanh": scale(HIDDEN, ATTENTION),
            "gate": scale(HIDDEN, ATTENTION),
            "attend": rng.normal(0, 0.1, ATTENTION),
            "out": rng.normal(0, 0.1, HIDDEN),
            "out0": np.zeros(1),
        },
    )
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            x = np.concatenate([bags[i] for i in pick]).astype(float)
            owner = np.repeat(np.arange(len(pick)), [len(bags[i]) for i in pick])
            step += 1
            for k, g in model.gradients(x, owner, y[pick], weight[pick]).items():
                g = g + DECAY * model.weights[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                unbiased = first[k] / (1 - 0.9**step), second[k] / (1 - 0.999**step)
                model.weights[k] -= RATE * unbiased[0] / (np.sqrt(unbiased[1]) + 1e-8)
    model.weights = {k: v.astype(np.float32) for k, v in model.weights.items()}
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, _, data, offsets in text_chunks(batch.column(3)):
            x, owner = passages(data, offsets)
            first = np.searchsorted(owner, np.arange(len(offsets)))
            out += [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["doc_id", "y", "draw", "bag"])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, data, offsets in text_chunks(batch.column(1)):
                x, owner = passages(data, offsets)
                out.append(model.score(x, owner, len(offsets) - 1))
            p = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(float))], ["doc_id", "score"])

    return run


def train(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, passages_at_most: int = SAMPLE_PASSAGES
) -> Model:
    """Fit on a bounded sample of docs (doc_id, text) with labels (doc_id, label)."""
    shared.prepare(docs.sparkSession)
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return Model(0.5)
    known = known.withColumn("draw", F.xxhash64("doc_id", F.lit(17)))
    picked = known.where("y = 0").orderBy("draw", "doc_id").limit(sample)
    picked = picked.unionByName(known.where("y = 1").orderBy("draw", "doc_id").limit(sample))
    # At most 2 * sample ids, and a text of each.
    one = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y", "draw")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    )
    bags = shared.materialize(one.mapInArrow(_bags, "doc_id long, y int, draw long, bag binary"), "bags")
    width = 2 * WIDTH
    sizes = bags.select("doc_id", "draw", F.expr(f"length(bag) div {width}").alias("n")).collect()
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: (r.draw, r.doc_id)):
        if held + r.n <= passages_at_most:
            chosen.append(r.doc_id)
            held += r.n
    if len(chosen) < len(sizes):
        bags = bags.where(F.col("doc_id").isin(chosen))
    rows = sorted(bags.collect(), key=lambda r: r.doc_id)
    if not rows:
        return Model(float(share))
    found = [np.frombuffer(r.bag, np.float16).reshape(-1, WIDTH) for r in rows]
    return fit(found, np.array([r.y for r in rows], float), float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of each document (doc_id, text)."""
    shared.prepare(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(model), "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _score_text(model: Model):
    """A scalar function from text to score, for filters that keep all columns."""

    def run(column):
        out = []
        for _, _, data, offsets in text_chunks(pa.array(column, pa.large_string(), from_pandas=True)):
            x, owner = passages(data, offsets)
            out.append(model.score(x, owner, len(offsets) - 1))
        import pandas as pd

        return pd.Series(np.concatenate(out).astype(float) if out else [], dtype=float)

    return F.pandas_udf(run, "double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier doesn't reject."""
    shared.prepare(docs.sparkSession)
    return docs.where(_score_text(model)(F.col("text")) >= THRESHOLD)
