"""Token-id files: Simple-8b words in segments, written in document order and read back with vector operations.

File format (a folder of Parquet files, so that Spark commits, retries and lists them like any table).  One row is
one segment of whole documents:

    part, segment     place of the segment; (part, segment) ascending is ascending doc_id
    ids_before        ids in earlier segments of the same part
    doc_ids, doc_lens one entry for each document, in order
    n_ids             ids in the segment
    words             little-endian 64-bit words: high 4 bits selector, low 60 bits payload
    block_words       little-endian 32-bit index of the first word of each block of BLOCK ids
    escapes           little-endian 64-bit ids too wide for a payload; the escape word's payload is the index here

A word's selector says how many ids of how many bits it holds, lowest bits first.  Each block starts on a word, so
any block can be decoded alone, and all of them at once.
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

#: (ids in a word, bits of each) by selector: the fixed Simple-8b table without its run selectors; 15 escapes.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK = 128
SEGMENT_IDS = 1 << 18
COUNTS = np.array([n for n, _ in SELECTORS] + [0, 1])
SEGMENT = "part int, segment int, ids_before long, doc_ids array<long>, doc_lens array<int>, n_ids long, words binary, block_words binary, escapes binary"


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits of each id, 0 for 0; exact up to 64 bits."""
    high, low = (ids >> np.uint64(32)).astype(np.float64), (ids & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped ids) of ids as unsigned 64-bit values.

    All blocks advance together: in each step every unfinished block takes the selector that holds the most of its
    next ids.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    padded = np.zeros(n_blocks * BLOCK, np.uint64)
    padded[: len(ids)] = ids
    values = np.zeros((n_blocks, BLOCK + 60), np.uint64)
    values[:, :BLOCK] = padded.reshape(n_blocks, BLOCK)
    row = BLOCK + 60
    widths, flat = np.zeros((n_blocks, row), np.uint8), values.ravel()
    widths[:, :BLOCK] = _widths(padded).reshape(n_blocks, BLOCK)
    widths = widths.ravel()
    length = np.full(n_blocks, BLOCK)
    if n_blocks:
        length[-1] = len(ids) - BLOCK * (n_blocks - 1)
    live, at = np.arange(n_blocks), np.zeros(n_blocks, np.int64)
    steps = []
    while len(live):
        here = live * row + at[live]
        selector = np.full(len(live), ESCAPE)
        most = widths[here]
        selector[most <= 60] = 13
        for k, (count, bits) in ((12, SELECTORS[12]), (11, SELECTORS[11]), (10, SELECTORS[10]), (9, SELECTORS[9]), (8, SELECTORS[8])):
            most = np.maximum(most, widths[here + count - 1])
            selector[most <= bits] = k
        narrow = np.flatnonzero(most <= 10)  # rare for token ids: six or more in a word
        for k in range(7, -1, -1):
            if not len(narrow):
                break
            count, bits = SELECTORS[k]
            fits = widths[here[narrow][:, None] + np.arange(count)].max(axis=1) <= bits
            selector[narrow[fits]] = k
        steps.append((live, here, selector))
        at[live] += COUNTS[selector]
        live = live[at[live] < length[live]]
    if not steps:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    block, here, selector = (np.concatenate(x) for x in zip(*steps, strict=True))
    order = np.argsort(block, kind="stable")
    here, selector = here[order], selector[order]
    words = selector.astype(np.uint64) << np.uint64(60)
    for k, (count, bits) in enumerate(SELECTORS):
        which = np.flatnonzero(selector == k)
        if len(which):
            for j in range(count):
                words[which] |= flat[here[which] + j] << np.uint64(j * bits)
    wide = np.flatnonzero(selector == ESCAPE)
    words[wide] |= np.arange(len(wide), dtype=np.uint64)
    per_block = np.bincount(block, minlength=n_blocks)
    return words, (np.cumsum(per_block) - per_block).astype(np.uint32), flat[here[wide]]


def decode_ids(words: np.ndarray, block_words: np.ndarray, escapes: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids back, as unsigned 64-bit values: one gather for each selector."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[selector]
    ends = np.cumsum(count)
    block = np.repeat(np.arange(len(block_words)), np.diff(np.append(block_words, len(words))).astype(np.int64))
    first = (ends - count)[block_words.astype(np.int64)] if len(words) else np.zeros(0, np.int64)
    at = block * BLOCK + (ends - count) - first[block]
    out = np.zeros(len(block_words) * BLOCK + 60, np.uint64)
    for k, (n, bits) in enumerate(SELECTORS):
        which = np.flatnonzero(selector == k)
        mask = np.uint64((1 << bits) - 1)
        for j in range(n):
            inside = at[which] + j < (block[which] + 1) * BLOCK  # a block's last word may be part empty
            out[(at[which] + j)[inside]] = ((words[which] >> np.uint64(j * bits)) & mask)[inside]
    wide = np.flatnonzero(selector == ESCAPE)
    out[at[wide]] = escapes[(words[wide] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n_ids]


def _segment(part: int, number: int, before: int, doc_ids: list, ids: list[np.ndarray]) -> tuple[dict, int]:
    joined = np.concatenate(ids)
    words, block_words, escapes = encode_ids(joined)
    row = {"part": part, "segment": number, "ids_before": before, "doc_ids": doc_ids, "doc_lens": [len(x) for x in ids], "n_ids": len(joined), "words": words.astype("<u8").tobytes(), "block_words": block_words.astype("<u4").tobytes(), "escapes": escapes.astype("<u8").tobytes()}
    return row, before + len(joined)


SEGMENT_ARROW = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("ids_before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int32())), ("n_ids", pa.int64()), ("words", pa.binary()), ("block_words", pa.binary()), ("escapes", pa.binary())])


def write_token_file(docs: DataFrame, tokenizer: str, end_id: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode every whole text, end each document with `end_id`, and write segments in ascending doc_id order.

    Null texts are empty (only the end id), null ids sort first, rows of equal id stand in the order of their texts'
    hashes, so that rows of one id are ranged over tasks too.  Returns the segments as read back from the written folder.
    """
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        number, before, held, doc_ids, ids = 0, 0, 0, [], []
        for batch in by_bytes(batches):
            flat, offsets = encoder.encode_column(batch.column("text"), end_id)
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                doc = flat[a:b]
                doc_ids.append(doc_id)
                ids.append(doc)
                held += len(doc)
                if held >= segment_ids:
                    row, before = _segment(part, number, before, doc_ids, ids)
                    yield pa.RecordBatch.from_pylist([row], SEGMENT_ARROW)
                    number, held, doc_ids, ids = number + 1, 0, [], []
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(part, number, before, doc_ids, ids)[0]], SEGMENT_ARROW)

    hashed = columns(docs, "doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = hashed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return written(by_arrow(ordered, segments, SEGMENT), "token-file")


def read_token_file(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            ids = decode_ids(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["block_words"], "<u4"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"]).astype("<u4")
            ends = np.cumsum(row["doc_lens"], dtype=np.int64)
            starts = ends - row["doc_lens"]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * len(crc), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), "in_part": starts + row["ids_before"], "n_tokens": ends - starts, "ids_crc32": pa.array(crc, pa.int64())})

    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))  # a row for each task that wrote
    bases = totals.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    docs = by_arrow(segments, documents, "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32")


