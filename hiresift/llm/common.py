"""Helpers shared by the operators of this folder."""
from __future__ import annotations

import re
import shutil
import sys
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hiresift.session import materialize

WORD = re.compile(r"\w+")
#: what a column of a missing name reads as
DEFAULTS = {"source": "string", "lang": "string", "text": "string"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; every other column, whatever its name, is left behind."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast(DEFAULTS.get(n, "string")).alias(n) for n in names])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read back: a lost executor costs one re-read."""
    return materialize(df, name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context: tasks import it by name there."""
    context = spark.sparkContext
    if getattr(context, "_hiresift_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._hiresift_shipped = True


def by_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with this package at hand in the tasks."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)


def keep_rows(docs: DataFrame, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose whole texts `keep` accepts, with all their columns, whatever their names."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(keep(text_of(batch.column(at))), pa.bool_()))

    at = docs.columns.index("text")
    return by_arrow(docs, apply, docs.schema)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows: what a task holds beside the batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def public_tokenizer(name: str) -> str:
    """The place of a public tokenizer's file on this machine; callable on executors."""
    if "/opt/tokenizers" not in sys.path:
        sys.path.append("/opt/tokenizers")
    import public_tokenizers

    return public_tokenizers.path(name)


def text_of(column: pa.Array) -> list[str]:
    """Texts of a column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]
