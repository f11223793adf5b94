"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' ids, end to end.  Queues are served in quanta of `quantum` ids; the one whose
deficit (ids due at its share of everything served so far, less ids served) reaches half a quantum first is next.  The
order of service is therefore the order of the times (u + 1/2) * quantum / share at which quantum u falls due, and a
queue's deficit never leaves one quantum.  The served quanta, end to end, are cut into windows of `window` ids: what a
window takes too much or too little of a source, the next ones make up.

Nothing runs window by window.  How many quanta of every queue fall due before a given one follows from the queues'
totals, so each task places its own documents, and the deficits carried over a partition's border are those that the
formula gives.  With shares in proportion to the queues' ids every queue ends together and nothing is left over;
`weights` asks for another mixture: a queue of share w then falls due at its own rate, and what remains when lighter
queues are empty is served at the rates of the rest.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hiresift.llm.common import by_arrow, columns, small_batches, written
from hiresift.llm.tokens import by_bytes, word_encoder

WINDOW = 4096
QUANTUM = 512
MAX_QUEUES = 4096
BATCH_BYTES = 8 << 20
TOKENS = "doc_id long, queue string, chunk int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Every whole text's ids with the end id, and how many ids of its source precede it in its chunk (a read task)."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk, sums = word_encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in by_bytes(batches, size=BATCH_BYTES):
            flat, offsets = encoder.encode_column(batch.column("text"), end_id)
            raw, width = flat.tobytes(), flat.dtype.itemsize
            ids = [raw[a * width:b * width] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            queues = batch.column("queue").to_pylist()
            counts, before = np.diff(offsets).tolist(), []
            for q, n in zip(queues, counts, strict=True):
                before.append(sums.get(q, 0))
                sums[q] = before[-1] + n
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "queue": pa.array(queues, pa.string()), "chunk": pa.array([chunk] * len(ids), pa.int32()), "before": pa.array(before, pa.int64()), "n": pa.array(counts, pa.int64()), "ids": pa.array(ids, pa.binary())})

    queue = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return by_arrow(columns(docs, "doc_id", "text", "source").select("doc_id", "text", queue.alias("queue")), encode, TOKENS)


def due(u: np.ndarray, quantum: int, rate: float) -> np.ndarray:
    """When quantum u of a queue of this rate falls due."""
    return (u + 0.5) * (quantum / rate)


def served_before(when: np.ndarray, place: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int) -> np.ndarray:
    """Ids of all queues in quanta due before `when`; of those due at the same time, in queues before `place`.

    The estimate by division is put right against the very times that order the quanta, so that places never overlap
    or leave a gap.
    """
    out = np.zeros(len(when), np.int64)
    for r, (total, rate) in enumerate(zip(totals.tolist(), rates.tolist(), strict=True)):
        n = np.maximum(np.ceil(when * rate / quantum - 0.5).astype(np.int64), 0)
        def earlier(k: np.ndarray, r: int = r, rate: float = rate) -> np.ndarray:
            t = due(k, quantum, rate)
            return (t < when) | ((t == when) & (r < place))

        for _ in range(3):
            n -= (n > 0) & ~earlier(n - 1)
        for _ in range(3):
            n += earlier(n)
        out += np.minimum(n * quantum, total)
    return out


def cut(offset: np.ndarray, length: np.ndarray, place: np.ndarray, totals: np.ndarray, rates: np.ndarray, quantum: int, window: int) -> tuple[np.ndarray, ...]:
    """Pieces of documents at `offset` of the queues `place`: (document, start, length, position in the packed stream)."""
    first, last = offset // quantum, (offset + length - 1) // quantum
    per_doc = last - first + 1
    doc = np.repeat(np.arange(len(offset)), per_doc)
    u = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + first[doc]
    begin = np.maximum(u * quantum, offset[doc])
    end = np.minimum((u + 1) * quantum, (offset + length)[doc])
    at = served_before(due(u, quantum, rates[place[doc]]), place[doc], totals, rates, quantum) + begin - u * quantum
    size, start = end - begin, begin - offset[doc]
    edge = (at // window + 1) * window - at  # a quantum is no longer than a window: one border at most
    over = np.flatnonzero(edge < size)
    doc, start, at = np.append(doc, doc[over]), np.append(start, start[over] + edge[over]), np.append(at, at[over] + edge[over])
    size = np.append(np.minimum(size, edge), size[over] - edge[over])
    return doc, start, size, at


def placed_quanta(bases: DataFrame, rates: DataFrame, quantum: int) -> DataFrame:
    """(queue, u, at): the place of every quantum in the packed stream, with a row for each and no total on the driver.

    Quanta are sorted by the time they fall due, then queue, in ranges; sums within a range, then over the ranges.
    """
    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = before + np.cumsum(size)
            yield pa.RecordBatch.from_pydict({"queue": batch.column("queue"), "u": batch.column("u"), "size": size, "part": pa.array(np.full(len(size), part), pa.int32()), "before": ends - size})
            before = int(ends[-1]) if len(ends) else before

    totals = bases.groupBy("queue").agg(F.sum("ids").alias("total")).join(rates, "queue", "left") if rates is not None else bases.groupBy("queue").agg(F.sum("ids").alias("total")).withColumn("rate", F.col("total").cast("double"))
    span = bases.join(totals, "queue").selectExpr("queue", "total", "coalesce(rate, 1.0D) AS rate", f"(base + {quantum - 1}) div {quantum} AS first", f"(base + ids + {quantum - 1}) div {quantum} - 1 AS last").where("first <= last")
    quanta = span.select("queue", "total", "rate", F.explode(F.sequence("first", "last")).alias("u"))
    timed = quanta.select("queue", "u", F.least(F.lit(quantum).cast("long"), F.col("total") - F.col("u") * quantum).alias("size"), ((F.col("u") + F.lit(0.5)) * (F.lit(float(quantum)) / F.col("rate"))).alias("due"))
    ordered = timed.repartitionByRange("due", "queue").sortWithinPartitions("due", "queue").select("queue", "u", "size")
    sums = written(by_arrow(ordered, running, "queue string, u long, size long, part int, before long"), "packing-quanta")
    parts = sums.groupBy("part").agg(F.sum("size").alias("ids"))  # a row for each range: few
    shifts = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("shift"))
    return sums.join(shifts, "part").select("queue", "u", (F.col("before") + F.col("shift")).alias("at"))


def pack_sorted(tokens: DataFrame, bases: DataFrame, weights: dict[str, float] | None, quantum: int, window: int, with_ids: bool) -> DataFrame:
    """The same pieces as pack's closed form, for any number of queues: documents are cut at quanta, which are placed by a sort."""
    def cut_quanta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            n = batch.column("n").to_numpy()
            offset = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            first = offset // quantum
            per_doc = (offset + n - 1) // quantum - first + 1
            doc = np.repeat(np.arange(len(n)), per_doc)
            u = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + first[doc]
            begin, end = np.maximum(u * quantum, offset[doc]), np.minimum((u + 1) * quantum, (offset + n)[doc])
            start, raw = begin - offset[doc], batch.column("ids").to_pylist()
            width = [len(x) // k for x, k in zip(raw, n.tolist(), strict=True)]
            own = [raw[d][a * width[d]:(a + k) * width[d]] for d, a, k in zip(doc.tolist(), start.tolist(), (end - begin).tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc)), "queue": batch.column("queue").take(pa.array(doc)), "u": u, "start": start, "length": end - begin, "inside": begin - u * quantum, "doc_tokens": n[doc], "ids": pa.array(own, pa.binary())})

    def at_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            size, start, at = (batch.column(c).to_numpy() for c in ("length", "start", "at"))
            raw, skip, doc = batch.column("ids").to_pylist(), np.zeros(len(size), np.int64), np.arange(len(size))
            edge = (at // window + 1) * window - at
            over = np.flatnonzero(edge < size)
            width = [len(x) // k for x, k in zip(raw, size.tolist(), strict=True)]
            doc, skip, at = np.append(doc, over), np.append(skip, edge[over]), np.append(at, at[over] + edge[over])
            size = np.append(np.minimum(size, edge), size[over] - edge[over])
            own = [np.frombuffer(raw[d][a * width[d]:(a + k) * width[d]], f"<u{width[d]}") for d, a, k in zip(doc.tolist(), skip.tolist(), size.tolist(), strict=True)]
            rows = pa.array(doc)
            out = {"doc_id": batch.column("doc_id").take(rows), "start": start[doc] + skip, "length": size, "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()), "doc_tokens": batch.column("doc_tokens").take(rows), "sequence_id": at // window, "offset": at % window, "queue": batch.column("queue").take(rows)}
            if with_ids:
                out["ids"] = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    rates = None if weights is None else tokens.sparkSession.createDataFrame([(q, max(float(w), 1e-12)) for q, w in weights.items()], "queue string, rate double")
    given = tokens.join(bases.select("queue", "chunk", "base"), ["queue", "chunk"]).select("doc_id", "queue", "before", "base", "n", "ids")
    pieces = by_arrow(given, cut_quanta, "doc_id long, queue string, u long, start long, length long, inside long, doc_tokens long, ids binary")
    at = placed_quanta(bases, rates, quantum)
    placed = pieces.join(at, ["queue", "u"]).select("doc_id", "queue", "start", "length", "doc_tokens", "ids", (F.col("at") + F.col("inside")).alias("at"))
    return by_arrow(placed, at_windows, PIECES + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, window: int = WINDOW, quantum: int = QUANTUM, weights: dict[str, float] | None = None, max_queues: int = MAX_QUEUES, with_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of `window` ids; one row for each piece.

    Sequences are filled without padding, but for the last, which the reader pads.  Null texts are empty (the end id
    alone), a null source is the queue "", repeated rows are packed as often as they stand.  The queues' totals are
    the only rows that reach the driver; of more than `max_queues` sources none does, and quanta are placed by a sort
    to the same result (see pack_sorted).  `with_ids` adds the piece's ids (little-endian 16 or 32 bit, by the vocabulary's size).
    """
    if not 0 < quantum <= window:
        raise ValueError("a quantum must fit a window")
    spark = docs.sparkSession
    tokens = written(tokenised(docs, tokenizer, end_id), "packing-tokens")
    sums = tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("ids"))
    n_queues = sums.select(F.countDistinct("queue")).first()[0]
    ordered = Window.partitionBy("queue").orderBy("chunk")
    bases = written(sums.select("queue", "chunk", "ids", (F.sum("ids").over(ordered) - F.col("ids")).alias("base")), "packing-bases")
    if n_queues > max_queues:
        return pack_sorted(tokens, bases, weights, quantum, window, with_ids)
    per_queue = sorted((r["queue"], int(r["ids"])) for r in bases.groupBy("queue").agg(F.sum("ids").alias("ids")).collect())
    place_of = {g: i for i, (g, _) in enumerate(per_queue)}
    totals = np.array([n for _, n in per_queue], np.int64)
    rates = totals.astype(np.float64) if weights is None else np.array([max(float(weights.get(g, 1.0)), 1e-12) for g, _ in per_queue])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            n = batch.column("n").to_numpy()
            place = np.array([place_of[g] for g in batch.column("queue").to_pylist()], np.int64)
            offset = batch.column("base").to_numpy() + batch.column("before").to_numpy()
            doc, start, size, at = cut(offset, n, place, totals, rates, quantum, window)
            width = np.dtype("<u2") if sum(map(len, (raw := batch.column("ids").to_pylist()))) == 2 * n.sum() else np.dtype("<u4")
            ids = [np.frombuffer(x, width) for x in raw]
            own = [ids[d][s:s + k] for d, s, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            out = {"doc_id": batch.column("doc_id").take(pa.array(doc)), "start": start, "length": size, "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()), "doc_tokens": n[doc], "sequence_id": at // window, "offset": at % window, "queue": batch.column("queue").take(pa.array(doc))}
            if with_ids:
                out["ids"] = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_pydict(out)

    placed = tokens.join(bases.select("queue", "chunk", "base"), ["queue", "chunk"]).select("doc_id", "queue", "before", "base", "n", "ids")
    return by_arrow(placed, pieces, PIECES + (", ids binary" if with_ids else ""))
