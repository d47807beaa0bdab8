"""Licence scan by matching statistics against a generalised suffix automaton of licence words.

Documents are streamed through the automaton word by word; at each word it knows the longest run of words ending
there that any template has. Runs that reach a phrase's state are its places. Templates are the paragraphs of the
licences in licence_texts, so any part of a licence that holds one is found. Long matches are chained, in order in the
document and in the template, into spans, each place where a paragraph stands giving one; where the covered share of
the paragraph reaches COVER its licence's label is given. SPDX identifiers are phrases that give labels too. The
automaton's transitions are tables, so that all runs of a batch advance together.

Null and empty texts have no words, no labels and score 0. The score is the largest covered share of any paragraph,
1 for a whole phrase. Rows that repeat a doc_id are scanned each for itself; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .licence_texts import SPDX, TEXTS
from .textbytes import FOLDED, SpanHash, find_words, text_chunks


def words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z]+", text.lower())


# Phrases that are looked for whole, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Phrases of the method's own, which count as no places, and paragraphs with their labels.
IDENTIFIERS = tuple((" ".join(words_of(f"SPDX-License-Identifier: {name}")), label) for name, label in SPDX)
TEMPLATES = tuple((" ".join(words_of(p)), label) for label, paragraphs in TEXTS for p in paragraphs)
#: Words of a match that counts for a span, and the share of a paragraph that gives its label.
LONG = 5
COVER = 0.6
#: Words that may lie between two chained matches.
GAP = 24

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x41:0x5B] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


class SuffixAutomaton:
    """All substrings of several word sequences, with failure transitions as tables."""

    def __init__(self, sequences: list[list[int]], vocabulary: int):
        go: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        ends: list[set[tuple[int, int]]] = [set()]

        def state(transitions: dict[int, int], suffix: int, size: int) -> int:
            go.append(transitions)
            link.append(suffix)
            length.append(size)
            ends.append(set())
            return len(go) - 1

        def split(p: int, c: int, q: int) -> int:
            copy = state(dict(go[q]), link[q], length[p] + 1)
            while p >= 0 and go[p].get(c) == q:
                go[p][c] = copy
                p = link[p]
            link[q] = copy
            return copy

        for number, words in enumerate(sequences):
            last = 0
            for at, c in enumerate(words):
                if c in go[last]:
                    q = go[last][c]
                    last = q if length[q] == length[last] + 1 else split(last, c, q)
                else:
                    new = state({}, 0, length[last] + 1)
                    p = last
                    while p >= 0 and c not in go[p]:
                        go[p][c] = new
                        p = link[p]
                    if p >= 0:
                        q = go[p][c]
                        link[new] = q if length[q] == length[p] + 1 else split(p, c, q)
                    last = new
                ends[last].add((number, at + 1))
        order = sorted(range(len(go)), key=length.__getitem__)
        for s in reversed(order[1:]):
            if link[s] >= 0:
                ends[link[s]] |= ends[s]
        n = len(go)
        kind = np.int16 if n < 1 << 15 else np.int32
        self.next = np.zeros((n, vocabulary), kind)
        self.direct = np.zeros((n, vocabulary), bool)
        self.fall = np.zeros((n, vocabulary), kind)
        for s in order:
            if s:
                up = link[s]
                self.next[s] = self.next[up]
                self.fall[s] = np.where(self.direct[up], length[up] + 1, self.fall[up])
            for c, t in go[s].items():
                self.next[s, c], self.direct[s, c] = t, True
        self.go, self.link, self.ends = go, link, ends

    def walk(self, words: list[int]) -> int:
        s = 0
        for c in words:
            s = self.go[s][c]
        return s


def best_chain(found: list[tuple[int, int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """Words covered and parts of the chain that covers most; found: (start, end) in the text, (start, end) in the template."""
    gain, before, over = [], [], []
    for i, (a, b, p, q) in enumerate(found):
        most, link, lost = q - p, -1, 0
        for j in range(i - 1, -1, -1):
            _, b2, _, q2 = found[j]
            if a - b2 > GAP:
                break
            twice = max(0, b2 - a, q2 - p)
            if twice < q - p and b2 < b and q2 < q and gain[j] + q - p - twice > most:
                most, link, lost = gain[j] + q - p - twice, j, twice
        gain.append(most)
        before.append(link)
        over.append(lost)
    i = max(range(len(found)), key=gain.__getitem__)
    best, chain = gain[i], []
    while i >= 0:
        chain.append((found[i][0] + over[i], found[i][1]))
        i = before[i]
    return best, chain[::-1]


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, identifiers=IDENTIFIERS):
        self.base = len(phrases)
        self.phrases = [(p.split(), label) for p, label in (*phrases, *identifiers)]
        self.sequences = [p for p, _ in self.phrases] + [t.split() for t, _ in templates]
        self.labels = [label for _, label in self.phrases] + [label for _, label in templates]
        words = sorted({w for s in self.sequences for w in s})
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in words])
        hashes = SpanHash(data, FOLDED)(np.concatenate(([0], ends[:-1])), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(words)}
        coded = [[number[w] for w in s] for s in self.sequences]
        self.automaton = SuffixAutomaton(coded, len(words))
        n = len(self.automaton.go)
        self.size = np.array([len(p) for p, _ in self.phrases])
        at = [self.automaton.walk(c) for c in coded[: len(self.phrases)]]
        self.below = np.zeros((n, len(at)), bool)
        self.same = np.zeros((n, len(at)), bool)
        for s in range(n):
            up = self.automaton.link[s]
            while up >= 0:
                self.below[s] |= np.array(at) == up
                up = self.automaton.link[up]
            self.same[s] = np.array(at) == s
        self.shortest = min(self.size.min(), LONG)

    def statistics(self, code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The automaton's state and the longest match ending at each word; 0 outside runs of known words."""
        known = code >= 0
        n = len(code)
        state, longest = np.zeros(n, np.int32), np.zeros(n, np.int32)
        if not n:
            return state, longest
        first = known.copy()
        first[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        last = known.copy()
        last[:-1] &= ~known[1:] | (row[1:] != row[:-1])
        begin, size = np.flatnonzero(first), np.flatnonzero(last) - np.flatnonzero(first) + 1
        long = size >= self.shortest
        begin, size = begin[long], size[long]
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        s, m = np.zeros(len(begin), np.int32), np.zeros(len(begin), np.int32)
        a = self.automaton
        for step in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -step, "left"))
            c = code[begin[:k] + step]
            m[:k] = np.where(a.direct[s[:k], c], m[:k] + 1, a.fall[s[:k], c])
            s[:k] = a.next[s[:k], c]
            state[begin[:k] + step] = s[:k]
            longest[begin[:k] + step] = m[:k]
        return state, longest

    def spans(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """matches: (last word, longest, state) in order. Template, words covered and the parts of each chain.

        Chains of one template don't overlap; the one that covers most comes first, then those beside it.
        """
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for at, size, state in matches:
            for number, end in self.automaton.ends[state]:
                by.setdefault(number, []).append((at - size + 1, at + 1, end - size, end))
        for number, found in by.items():
            cut = [0, *(i for i in range(1, len(found)) if found[i][0] - found[i - 1][1] > GAP), len(found)]
            stack = [found[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            while stack:
                some = stack.pop()
                gain, chain = best_chain(some)
                yield number, gain, chain
                before = [m for m in some if m[1] <= chain[0][0]]
                after = [m for m in some if m[0] >= chain[-1][1]]
                stack += [part for part in (before, after) if part]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        start, end, row = find_words(data, offsets, _IS_WORD)
        h = SpanHash(data, FOLDED)(start, end)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == h, self.order[at], -1)
        state, longest = self.statistics(code, row)
        rows = len(offsets) - 1
        count = np.bincount(row, minlength=rows)
        base = np.concatenate(([0], np.cumsum(count)))
        hot = np.flatnonzero(longest >= self.shortest)
        whole = self.below[state[hot]] | self.same[state[hot]] & (longest[hot, None] >= self.size)
        places: dict[int, list[tuple[int, int]]] = {}
        where, which = np.nonzero(whole)
        for i, k in zip(hot[where].tolist(), which.tolist(), strict=True):
            r = int(row[i])
            places.setdefault(r, []).append((i - int(base[r]) - int(self.size[k]) + 1, k))
        closed = np.ones(len(longest), bool)
        closed[:-1] = (longest[1:] != longest[:-1] + 1) | (row[1:] != row[:-1])
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for i in np.flatnonzero(closed & (longest >= LONG)).tolist():
            r = int(row[i])
            matches.setdefault(r, []).append((i - int(base[r]), int(longest[i]), int(state[i])))
        out = []
        for r in range(rows):
            found = [(a, k) for a, k in places.get(r, []) if k < self.base]
            starts = [a for a, _ in found]
            own = {self.phrases[k][1] for _, k in found}
            labels, covered = {self.phrases[k][1] for _, k in places.get(r, [])}, []
            score = 1.0 if labels else 0.0
            for number, words, chain in self.spans(matches.get(r, [])):
                share = min(1.0, words / len(self.sequences[number]))
                score = max(score, share)
                if share >= COVER and number >= len(self.phrases):
                    labels.add(self.labels[number])
                    covered.append({"label": self.labels[number], "cover": share, "first": chain[0][0], "last": chain[-1][1] - 1})
            out.append(
                (
                    int(count[r]),
                    len(found),
                    min(starts, default=None),
                    max(starts, default=None),
                    ",".join(sorted(own)),
                    ",".join(sorted(labels)),
                    score,
                    sorted(covered, key=lambda x: (x["first"], x["label"])),
                )
            )
        return out


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
_FIELDS = [
    ("n_words", pa.int64()),
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", _SPANS),
]
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,cover:double,first:bigint,last:bigint>>"
)


@lru_cache(1)
def _scanner() -> Scanner:
    """This worker's automaton."""
    return Scanner()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = _scanner()
    for batch in batches:
        rows: list[tuple] = []
        for _, _, data, offsets in text_chunks(batch.column(1)):
            rows += scanner.scan(data, offsets)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True))],
            ["doc_id", *(n for n, _ in _FIELDS)],
        )


def scan_licences(docs: DataFrame) -> DataFrame:
    """Words, phrase places, labels, covered spans and score of each document (doc_id, text)."""
    shared.prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, SCHEMA)
