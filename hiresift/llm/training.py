"""Labelled rows for the classifiers: a bounded, class-balanced sample chosen by a hash of the id."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hiresift.llm.common import columns, written
from hiresift.session import shuffled


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; -1 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % modulus, F.lit(-1))


def known_labels(labels: DataFrame, label: str, modulus: int | None = None, held_out: int | None = None) -> DataFrame:
    """(doc_id, y) of every labelled id.

    Ids whose remainder is `held_out` never take part.  An id labelled twice counts as its larger label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if modulus is not None:
        known = known.where(remainder("doc_id", modulus) != held_out)
    return known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).where(F.col("y").isin(0, 1))


def labelled_rows(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, text, y) of every labelled document; dealt by id at any size, so that disk grows with the texts."""
    return columns(docs, "doc_id", "text").join(shuffled(known), "doc_id").select("doc_id", "text", "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, modulus: int | None = None, held_out: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of up to max_rows / 2 rows of each class, and how many labelled rows each class has."""
    known = known_labels(labels, label, modulus, held_out)
    totals = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for y in (0, 1)]
    return written(labelled_rows(docs, chosen[0].unionByName(chosen[1])), f"labelled-{label}"), totals
