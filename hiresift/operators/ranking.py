"""Every document against every posting: pairs or the best few, found inside the tasks that hold the documents.

Postings are laid out in waves of bounded bytes, which are the only thing sent to the tasks; a document brings the
terms it holds.  Within a wave an inverted index leads from terms to postings, so a document touches only postings it
shares something decisive with, and a term that every document and every posting has is one list in each task rather
than one key of a shuffle.  What leaves a task is at most k rows for each document and wave (`best_postings`), or the
pairs themselves (`coverage_pairs`).
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hiresift.functions import arrays as ar
from hiresift.functions import text as tx
from hiresift.session import materialize, ship

WAVE_BYTES = 32 << 20
SCALE = 60  # every share of up to six searches is a whole number of sixtieths
CHUNK = 64


class Searches:
    """Searches of a wave's postings.

    A search asks for all of its groups, a group for any of its terms.  Each search is listed under the group that the
    fewest searches name: it can't succeed in a document without that one.  The searches listed under the groups that
    a document has therefore bound what any posting can score there, and postings are tried in the order of that bound.
    """

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[0])
        self.ids = np.array([r[0] for r in rows], object)
        groups: dict[frozenset, int] = {}
        searches, self.n = [], np.zeros(len(rows), np.int64)
        for at, (_, asked) in enumerate(rows):
            self.n[at] = len(asked or ())
            for search in asked or ():
                searches.append((at, [groups.setdefault(frozenset(g), len(groups)) for g in search]))
        self.of_term: dict[str, list[int]] = defaultdict(list)
        for members, g in groups.items():
            for term in members:
                self.of_term[term].append(g)
        named = np.bincount([g for _, gs in searches for g in set(gs)], minlength=len(groups)) if searches else np.zeros(0, int)
        under: dict[int, list[int]] = defaultdict(list)
        for s, (_, gs) in enumerate(searches):
            under[min(gs, key=lambda g: (named[g], g))].append(s)
        self.under = {g: np.array(s) for g, s in under.items()}
        self.posting = np.array([at for at, _ in searches], np.int64)
        self.asked = [np.array(gs) for _, gs in searches]
        self.n_groups = len(groups)
        self.share = np.array([SCALE // max(1, n) if SCALE % max(1, n) == 0 else SCALE / n for n in self.n.tolist()], np.float64)
        self.scored, self.unscored = np.flatnonzero(self.n > 0), np.flatnonzero(self.n == 0)

    def best(self, held: list[str], k: int) -> list[tuple[int, int]]:
        """(place of a posting, searches that succeed) of the k best: by share, then by id; postings without a search last."""
        groups = sorted({g for t in held for g in self.of_term.get(t, ())})
        has = np.zeros(self.n_groups, bool)
        has[groups] = True
        found: list[tuple[float, int, int]] = []
        listed = [self.under[g] for g in groups if g in self.under]
        if listed:
            able = np.concatenate(listed)
            posting, inverse = np.unique(self.posting[able], return_inverse=True)
            bound = np.bincount(inverse) * self.share[posting]
            order = np.lexsort((posting, -bound))
            able = able[np.argsort(inverse, kind="stable")]
            ends = np.cumsum(np.bincount(inverse))
            for at in range(0, len(order), CHUNK):
                chunk = order[at:at + CHUNK]
                if len(found) >= k and bound[chunk[0]] < -found[k - 1][0]:
                    break
                for p in chunk.tolist():
                    hits = sum(bool(has[self.asked[s]].all()) for s in able[ends[p - 1] if p else 0:ends[p]].tolist())
                    if hits:
                        found.append((-hits * self.share[posting[p]], int(posting[p]), hits))
                found = sorted(found)[:k]
        out = [(p, hits) for _, p, hits in found]
        for rest in (self.scored, self.unscored):
            if len(out) < k:
                taken = {p for p, _ in out}
                out.extend((p, 0) for p in rest[:k + len(taken)].tolist() if p not in taken)
        return out[:k]


class Weights:
    """Weighted terms of a wave's postings: lists from a term to the postings that ask for it."""

    def __init__(self, rows: list[tuple]):
        self.ids = np.array([r[0] for r in rows], object)
        lists: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for at, (_, terms) in enumerate(rows):
            for term, weight in terms or ():
                lists[term].append((at, weight))
        self.lists = {t: np.array(x, np.int64) for t, x in lists.items()}

    def pairs(self, held: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of postings that share a term, how many terms each, their weight)."""
        lists = [self.lists[t] for t in held if t in self.lists]
        if not lists:
            return (np.zeros(0, np.int64),) * 3
        both = np.concatenate(lists)
        posting, inverse = np.unique(both[:, 0], return_inverse=True)
        weight = np.zeros(len(posting), np.int64)
        np.add.at(weight, inverse, both[:, 1])
        return posting, np.bincount(inverse), weight


def _in_waves(documents: DataFrame, postings: DataFrame, lay_out: Callable, evaluate: Callable, schema: str, name: str, wave_bytes: int) -> DataFrame:
    """`evaluate(wave, batch)` over all documents for each wave of postings.

    Postings pass the driver a wave at a time; with more than one wave each result is written before the next begins.
    """
    spark = documents.sparkSession
    ship(spark)

    def run(rows: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)  # no more than a wave, laid out in the tasks

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wave = lay_out(shared.value)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    yield evaluate(wave, batch.slice(at, 1000))

        return documents.mapInArrow(apply, schema)

    held, size, done = [], 0, None
    for row in postings.toLocalIterator():
        if size >= wave_bytes:
            part = materialize(run(held), name)
            done, held, size = part if done is None else done.unionByName(part), [], 0
        held.append(_plain(row))
        size += len(str(row))
    last = run(held)
    return last if done is None else done.unionByName(last)


def _plain(value):
    """Rows as tuples, so that a task needs no schema to read them."""
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value)) if isinstance(value, tuple) else [_plain(x) for x in value]
    return value


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _arrow(df: DataFrame, names: tuple[str, ...]) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(n, to_arrow_type(df.schema[n].dataType)) for n in names]


def best_postings(documents: DataFrame, postings: DataFrame, *, doc: str, k: int = 10, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(doc, jd_id, n_searches, n_matched, score, rank): the k postings whose searches find each document best.

    `documents` is (doc, terms array<string>), `postings` (jd_id, searches array<struct<..., groups>>).  By score, then
    posting id; a posting without searches has no score and stands last; every document has min(k, postings) rows,
    whether it holds a term or not.  A document row without terms (null or empty) counts as holding none, repeated
    document rows are ranked together once, and no postings give no rows.
    """
    asked = postings.select("jd_id", F.transform(F.coalesce("searches", F.array().cast(postings.schema["searches"].dataType)), lambda s: s["groups"]).alias("searches"))
    given = documents.select(doc, "terms")
    fields = [*_arrow(given, (doc,)), *_arrow(asked, ("jd_id",)), pa.field("n_matched", pa.int64()), pa.field("n_searches", pa.int64())]
    out = pa.schema(fields)

    def evaluate(wave: Searches, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {f.name: [] for f in out}
        for d, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for p, hits in wave.best(held or [], k):
                rows[doc].append(d)
                rows["jd_id"].append(wave.ids[p])
                rows["n_matched"].append(hits)
                rows["n_searches"].append(int(wave.n[p]))
        return _batch(rows, out)

    kinds = dict(given.dtypes) | dict(asked.dtypes)
    found = _in_waves(given, asked, Searches, evaluate, f"{doc} {kinds[doc]}, jd_id {kinds['jd_id']}, n_matched long, n_searches long", "best-postings", wave_bytes)
    scored = found.select(doc, "jd_id", "n_searches", "n_matched", tx.ratio_pct(F.col("n_matched"), F.col("n_searches")).alias("score")).distinct()
    order = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("o"), F.col("jd_id"), F.col("n_searches"), F.col("n_matched"), F.col("score"))
    best = scored.groupBy(doc).agg(F.slice(F.array_sort(F.collect_list(order)), 1, k).alias("_b"))  # k rows of each wave
    ranked = F.transform("_b", lambda b, i: F.struct(*[b[c].alias(c) for c in ("jd_id", "n_searches", "n_matched", "score")], (i + 1).alias("rank")))
    return ar.unpack(best, [doc], ranked, "rank")


def coverage_pairs(documents: DataFrame, keywords: DataFrame, *, doc: str, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """Coverage of each posting by each document that holds at least one of its terms; map-only.

    `documents` is (doc, terms array<string>), `keywords` (jd_id, term, weight decimal), a term once for each posting.
    """
    weighted = keywords.groupBy("jd_id").agg(
        F.collect_list(F.struct("term", (F.col("weight") * 100).cast("long").alias("w"))).alias("terms"))
    totals = keywords.groupBy("jd_id").agg(F.sum("weight").alias("total_weight"), F.count("*").alias("n_terms"))
    given = documents.select(doc, "terms")
    out = pa.schema([*_arrow(given, (doc,)), *_arrow(keywords, ("jd_id",)), pa.field("n_matched", pa.int64()), pa.field("w", pa.int64())])

    def evaluate(wave: Weights, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, found = batch.column(0).to_pylist(), [wave.pairs(sorted(set(h or ()))) for h in batch.column(1).to_pylist()]
        sizes = [len(p) for p, _, _ in found]
        joined = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        docs = batch.column(0).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
        return pa.RecordBatch.from_arrays([docs, pa.array(wave.ids[joined[0]], out.field(1).type), pa.array(joined[1]), pa.array(joined[2])], schema=out)

    kinds = dict(given.dtypes) | dict(keywords.dtypes)
    found = _in_waves(given, weighted, Weights, evaluate, f"{doc} {kinds[doc]}, jd_id {kinds['jd_id']}, n_matched long, w long", "coverage", wave_bytes)
    matched = (F.col("w") / 100).cast("double")
    return found.join(totals, "jd_id").select(
        doc, "jd_id", "n_matched", "n_terms", matched.alias("matched_weight"), F.col("total_weight").cast("double").alias("total_weight"),
        tx.ratio_pct(matched, F.col("total_weight")).alias("score"))
