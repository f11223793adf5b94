"""Token counts of a document's sections from one encoding of the whole document.

A document is encoded once; its tokens keep the span of characters that they come from.  Spans and sections are both in
text order, so the interval join is one search of sorted bounds per document.  A token that crosses a boundary goes by
an explicit rule: "first" to the section of its first character, "most" to the section that holds most of it (the
earlier of equals), "each" to every section that it touches.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hiresift.llm.common import by_arrow, columns, small_batches, text_of
from hiresift.llm.tokens import word_encoder

RULES = ("first", "most", "each")


def lines(text: str) -> list[tuple[int, int]]:
    """Sections of the registered query: the text's lines, each with the line end that follows it."""
    out, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        if end > at:
            out.append((at, end))
        at = end
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, sections: list[tuple[int, int]], rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section (ascending, not overlapping), and tokens that no section holds by the rule."""
    begin, stop = np.array([s for s, _ in sections], np.int64), np.array([e for _, e in sections], np.int64)
    if not len(begin):
        return np.zeros(0, np.int64), len(starts)
    first = np.searchsorted(begin, starts, "right") - 1
    last = np.searchsorted(begin, np.maximum(ends, starts + 1), "left") - 1  # the last section that starts before its end
    inside = (first >= 0) & (starts < stop[np.maximum(first, 0)])
    counts = np.bincount(first[inside & (last <= first)], minlength=len(begin))
    cross = np.flatnonzero(~(inside & (last <= first)))
    none = 0
    for i in cross.tolist():  # only tokens over a boundary or in a gap
        over = {k: min(int(ends[i]), int(stop[k])) - max(int(starts[i]), int(begin[k])) for k in range(max(int(first[i]), 0), int(last[i]) + 1)}
        over = {k: v for k, v in over.items() if v > 0}
        if rule == "first":
            chosen = [int(first[i])] if inside[i] else []
        elif rule == "most":
            chosen = [max(over, key=lambda k: (over[k], -k))] if over else []
        else:
            chosen = list(over)
        for k in chosen:
            counts[k] += 1
        none += not chosen
    return counts, none


def count_tokens(docs: DataFrame, tokenizer: str, sections=lines, rule: str = "first") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, doc_tokens): a row for each section of every whole text.

    `sections` gives ascending spans of a text; what no section holds is counted under section -1, whose row is there
    only if it has tokens.  A text without a section, such as a null or empty one, has one row of section -1.  Repeated
    rows are counted as often as they stand.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in small_batches(batches, 500):
            out: dict[str, list] = {n: [] for n in ("doc_id", "section", "start", "end", "n_tokens", "doc_tokens")}
            texts = text_of(batch.column("text"))
            for doc_id, text, (starts, ends) in zip(batch.column("doc_id").to_pylist(), texts, encoder.spans(texts), strict=True):
                spans = sections(text)
                counts, none = allocate(starts, ends, spans, rule)
                rows = [(k, s, e, int(c)) for k, ((s, e), c) in enumerate(zip(spans, counts, strict=True))]
                if none or not rows:
                    rows.append((-1, 0, len(text), none))
                for k, s, e, c in rows:
                    for n, v in zip(out, (doc_id, k, s, e, c, len(starts)), strict=True):
                        out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("n_tokens", pa.int64()), ("doc_tokens", pa.int64())]))

    return by_arrow(columns(docs, "doc_id", "text"), apply, "doc_id long, section int, start int, end int, n_tokens long, doc_tokens long")
