"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

Passages overlap by half and are twice as long as the longest item, so an item that stands in a text stands whole in
one of them.  Each passage is a query to a block-max WAND search for all items whose BM25 score reaches a share of the
item's score for itself.  What is found is verified: of the five-word shingles of the item's question and of its answer,
`OVERLAP` or more must stand in the passage.

Scores are divided by the item's own, so that one threshold serves all: a term adds at most its share, and an item held
to `OVERLAP` in its shingles has about that share of its terms present.
"""
from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import WORD, by_arrow, columns, keep_rows, small_batches, text_of

K1, B = 1.2, 0.75
OVERLAP = 0.8
LEAST_SCORE = 0.7
#: items of a block, and blocks of an index at most: larger indexes have larger blocks
BLOCK, BLOCKS = 4, 256
SHINGLE = 5
#: bytes of item texts held in one index; more items make more indexes, searched one after another
INDEX_BYTES = 32_000_000
BREAK = re.compile(r"(?<=[.!?])\s+|\n+")


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of an item's question and answer: the last sentence is the answer, or the second half of a lone one.

    Parts too short for a shingle are taken together with the other.
    """
    parts = [WORD.findall(p.lower()) for p in BREAK.split(text)]
    parts = [p for p in parts if p]
    words = [w for p in parts for w in p]
    cut = len(words) - len(parts[-1]) if len(parts) > 1 else len(words) // 2
    if cut < SHINGLE or len(words) - cut < SHINGLE:
        return words, words
    return words[:cut], words[cut:]


@dataclass
class Index:
    """Postings by term: item numbers ascending, and their share of the item's own score.

    `blocks` has a row for each term (its number in `term`) with the largest share in each block of `block` items.
    """

    ids: list = field(default_factory=list)
    question: list = field(default_factory=list)
    answer: list = field(default_factory=list)
    postings: dict = field(default_factory=dict)
    most: dict = field(default_factory=dict)
    term: dict = field(default_factory=dict)
    blocks: np.ndarray = field(default_factory=lambda: np.zeros((1, 0)))
    block: int = BLOCK
    longest: int = 0

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Index:
        out, words = cls(), []
        for item_id, text in items:
            w = WORD.findall((text or "").lower())
            if w:
                q, a = question_answer(text)
                out.ids.append(item_id)
                out.question.append(shingles(q))
                out.answer.append(shingles(a))
                words.append(w)
        n, mean = len(words), sum(map(len, words)) / max(len(words), 1)
        df = Counter(t for w in words for t in set(w))
        lists: dict[str, tuple[list, list]] = {}
        for i, w in enumerate(words):
            weights = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * len(w) / mean)) for t, c in Counter(w).items()}
            own = sum(weights.values())
            for t, x in weights.items():
                p = lists.setdefault(t, ([], []))
                p[0].append(i)
                p[1].append(float(x / own))
        out.block = max(BLOCK, -(-n // BLOCKS))
        out.blocks = np.zeros((len(lists) + 1, -(-n // out.block)))  # row 0: words that no item has
        for k, (t, (at, share)) in enumerate(lists.items(), 1):
            out.postings[t] = (at, share)
            out.most[t] = max(share)
            out.term[t] = k
            np.maximum.at(out.blocks[k], np.array(at) // out.block, share)
        out.longest = max(map(len, words), default=0)
        return out

    def search(self, terms: set[str], least: float) -> list[tuple[int, float]]:
        """All (item number, score) of at least `least`: block-max WAND with a fixed threshold.

        Blocks whose terms' largest shares don't add up to the threshold are passed over whole.  In the others cursors
        stand on ascending item numbers; the pivot is the first item that the terms up to it could lift to the threshold
        by their largest shares in the block, and cursors before it move there.
        """
        numbers = np.array([self.term[t] for t in terms], np.int64)
        rows = self.blocks[numbers]
        found = []
        for b in np.flatnonzero(rows.sum(axis=0) >= least - 1e-9).tolist():
            low, high = b * self.block, (b + 1) * self.block
            cursors = []
            for t, most in zip(terms, rows[:, b].tolist(), strict=True):
                if most:
                    at, share = self.postings[t]
                    k = bisect_left(at, low)
                    cursors.append([at[k], k, at, share, most])
            while cursors:
                cursors.sort(key=lambda c: c[0])
                bound, item = 0.0, -1
                for c in cursors:
                    bound += c[4]
                    if bound >= least - 1e-9:
                        item = c[0]
                        break
                if item < 0:
                    break
                if cursors[0][0] == item:
                    score = sum(c[3][c[1]] for c in cursors if c[0] == item)
                    if score >= least - 1e-9:
                        found.append((item, score))
                    item += 1
                for c in cursors:
                    if c[0] < item:
                        c[1] = bisect_left(c[2], item, c[1])
                        c[0] = c[2][c[1]] if c[1] < len(c[2]) else high
                cursors = [c for c in cursors if c[0] < high]
        return found

    def matches(self, text: str, least: float, overlap: float) -> dict[int, tuple[float, float, float]]:
        """Item number -> (score, question overlap, answer overlap) of the items verified in a whole text."""
        out: dict[int, tuple[float, float, float]] = {}
        words = WORD.findall(text.lower())
        if not words or not self.longest:
            return out
        bounds = np.fromiter((self.most.get(w, 0.0) for w in words), np.float64, len(words))
        size = 2 * self.longest
        sums = np.concatenate([[0.0], np.cumsum(bounds)])
        starts = np.arange(0, max(1, len(words) - self.longest), self.longest)
        ends = np.minimum(starts + size, len(words))
        able = sums[ends] - sums[starts] >= least - 1e-9
        for s, e in zip(starts[able].tolist(), ends[able].tolist(), strict=True):
            terms = {w for w in words[s:e] if w in self.most}
            if sum(map(self.most.__getitem__, terms)) < least - 1e-9:
                continue
            held = None
            for item, score in self.search(terms, least):
                held = shingles(words[s:e]) | ({tuple(words[s:e])} if e - s < SHINGLE else set()) if held is None else held
                q = len(self.question[item] & held) / len(self.question[item])
                a = len(self.answer[item] & held) / len(self.answer[item])
                if q >= overlap - 1e-9 and a >= overlap - 1e-9 and (item not in out or score > out[item][0]):
                    out[item] = (score, q, a)
        return out


def index_parts(benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Indexes of at most about `index_bytes` of item text, fetched one at a time.

    Each is weighted by its own items' statistics.  Null and wordless items are in none.
    """
    items = columns(benchmark, "item_id", "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(size // index_bytes) + 1
    for part in range(n):
        yield Index.of(sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == part).collect()))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every benchmark item that stands in a document.

    Documents without one give no row, so clean, empty and null texts give none; a repeated row repeats its matches, and
    a repeated item is matched under each of its ids.
    """
    given = columns(docs, "doc_id", "text")

    def found_by(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in small_batches(batches):
                rows = [(d, own.ids[i], *v) for d, t in zip(batch.column("doc_id").to_pylist(), text_of(batch.column("text")), strict=True) for i, v in own.matches(t, least, overlap).items()]
                d, i, s, q, a = zip(*rows, strict=True) if rows else ([], [], [], [], [])
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "item_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64()), "question_overlap": pa.array(q, pa.float64()), "answer_overlap": pa.array(a, pa.float64())})

        return by_arrow(given, apply, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")

    return reduce(DataFrame.unionByName, map(found_by, index_parts(benchmark, index_bytes)))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item stands, with the columns they came with."""
    for index in index_parts(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_rows(docs, lambda texts, shared=shared: [not shared.value.matches(t, LEAST_SCORE, OVERLAP) for t in texts])
    return docs
