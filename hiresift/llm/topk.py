"""Exact top-k by inner product over an inverted index: MaxScore, shard by shard.

Vectors are sparse or dense sets of (term, integer weight); a dense vector's terms are its components.  A shard is a
block of rows turned into postings by term.  For a query every term has a bound on what it can add in the shard; terms
are split where the bounds of the smaller ones together stay under the k-th best score so far.  Postings of the larger,
essential terms are traversed; the others are probed, in falling order of their bounds, only for rows still competitive.
Each shard's best k are merged by score, then id.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, small_batches, written
from hiresift.session import shuffled

SHARD_ROWS = 4096
QUERY_ROWS = 1024
EXACT = float(1 << 53)


def quantised(vector: list | None, scale: int = 256) -> list[int] | None:
    """floor(scale * x) of each component; None if the vector or a component is null or not finite."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * float(x)) for x in vector]


def weights_of(vectors: list[list[int]]) -> np.ndarray:
    """Rows as one matrix of whole numbers: float64 while any inner product of it with itself is exact, else Python's."""
    width = max(map(len, vectors), default=0)
    largest = max((abs(x) for v in vectors for x in v), default=0)
    kind = np.float64 if largest * largest * max(width, 1) < EXACT else object
    out = np.zeros((len(vectors), width), kind)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


class Shard:
    """Postings by term of a block of rows: the rows' numbers (None: all rows) and their weights, and bounds."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.n = ids[order], len(ids)
        self.postings = []
        for column in matrix[order].T:
            rows = np.flatnonzero(column)
            dense = 2 * len(rows) > self.n
            self.postings.append((None if dense else rows, np.ascontiguousarray(column if dense else column[rows])))
        self.high = np.array([max(w.max(initial=0), 0) for _, w in self.postings], matrix.dtype)
        self.low = np.array([min(w.min(initial=0), 0) for _, w in self.postings], matrix.dtype)

    def top(self, own_id: int, query: np.ndarray, k: int, least: float | None) -> list[tuple[int, int]]:
        """The shard's best (score, id) for a query: no row under `least`, none with the query's own id."""
        terms = np.flatnonzero(query[:len(self.postings)])
        bounds = np.maximum(query[terms] * self.high[terms], query[terms] * self.low[terms])
        order = np.argsort(-bounds, kind="stable")
        terms, bounds = terms[order], bounds[order]
        rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the terms from here on can still add
        score = np.zeros(self.n, query.dtype)
        if least is None:  # nothing to compete with: a first threshold from every term
            essential = len(terms)
        else:
            essential = int(np.argmax(rest < least)) if (rest < least).any() else len(terms)
        for t in terms[:essential]:
            rows, w = self.postings[t]
            if rows is None:
                score += query[t] * w
            else:
                score[rows] += query[t] * w
        alive = np.flatnonzero(self.ids != own_id)
        for j in range(essential, len(terms)):
            if least is not None and (j - essential) % 4 == 0:
                alive = alive[score[alive] + rest[j] >= least]
            rows, w = self.postings[terms[j]]
            if rows is None:
                score[alive] += query[terms[j]] * w[alive]
            elif len(rows):
                at = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
                hit = rows[at] == alive
                score[alive[hit]] += query[terms[j]] * w[at[hit]]
        if least is not None:
            alive = alive[score[alive] >= least]
        if len(alive) > k:
            alive = alive[score[alive] >= np.partition(score[alive], len(alive) - k)[len(alive) - k]] if score.dtype != object else alive
        best = sorted(((-int(score[i]), int(self.ids[i])) for i in alive))[:k]
        return [(-s, i) for s, i in best]


def shards(items: DataFrame, rows: int) -> DataFrame:
    """One row for each block of up to `rows` vectors of a read task; no shuffle."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"ids": pa.array([ids], pa.list_(pa.int64())), "vectors": pa.array([vectors], pa.list_(pa.list_(pa.float64())))})

        for batch in small_batches(batches):
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if i is not None and quantised(v, 1) is not None:
                    ids.append(i)
                    vectors.append(v)
                if len(ids) == rows:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return by_arrow(items, apply, "ids array<long>, vectors array<array<double>>")


def exact_top_k(items: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of `items`, its own id left out.

    Both sides have vec_id and embedding.  Vectors that are null, or hold a null or a number that is not finite, take no
    part; missing components of shorter vectors are 0; ties go to the smaller id; scores beyond 64 bits are written as
    the nearest that fits, ranked by their true value.  Each shard meets each block of queries in a task of its own.
    """
    as_double = F.col("embedding").cast("array<double>").alias("embedding")
    few = max(1, queries.count() // (16 * query_rows))
    blocks = shards(queries.select("vec_id", as_double).coalesce(few), query_rows).withColumnsRenamed({"ids": "q_ids", "vectors": "q_vectors"})
    cells = meet(written(shards(items.select("vec_id", as_double), shard_rows), "vector-shards"), written(blocks, "query-blocks"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            data = weights_of([quantised(v, scale) for v in row["vectors"]] + [quantised(v, scale) for v in row["q_vectors"]])
            n = len(row["ids"])
            ids = np.array(row["ids"], np.int64)
            parts = [Shard(ids[a:a + 1024], data[a:n][:1024]) for a in range(0, n, 1024)]
            out = []
            for q, vector in zip(row["q_ids"], data[n:], strict=True):
                best: list[tuple[int, int]] = []
                for part in parts:
                    found = part.top(q, vector, k, best[-1][0] if len(best) == k else None)
                    best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
                out += [(q, i, s) for s, i in best]
            q, i, s = zip(*out, strict=True) if out else ([], [], [])
            size, digits = zip(*map(sortable, s), strict=True) if s else ([], [])
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in s], pa.int64()), "size": pa.array(size, pa.int32()), "digits": pa.array(digits, pa.string())})

    best = by_arrow(cells, apply, "query_id long, vec_id long, score long, size int, digits string")
    top = Window.partitionBy("query_id").orderBy(F.desc("size"), F.desc("digits"), "vec_id")
    return best.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sortable(score: int) -> tuple[int, str]:
    """A whole number of any size as (signed count of digits, digits), which sort as the number does."""
    digits = str(abs(score))
    return (len(digits), digits) if score >= 0 else (-len(digits), digits.translate(str.maketrans("0123456789", "9876543210")))


def meet(own: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every shard with every block of queries, dealt over cells by an equi-join: a cell is a bin of shards and a bin
    of blocks, about one of each.  Blocks stand in as many copies as there are shards, which their files' size says
    nothing of: by that estimate all copies would be collected in the driver for a broadcast."""
    n, m = max(1, own.count()), max(1, blocks.count())
    left = own.withColumn("row", F.pmod(F.xxhash64("ids"), F.lit(n))).withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")))
    right = blocks.withColumn("column", F.pmod(F.xxhash64("q_ids"), F.lit(m))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    return left.join(shuffled(right), ["row", "column"]).select("ids", "vectors", "q_ids", "q_vectors")
