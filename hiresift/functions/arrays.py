"""Small array helpers shared by the in-row operators."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from hiresift.session import ship


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), 0)


def field(array: Column, name: str) -> Column:
    return F.transform(array, lambda s: s[name])


def first(array: Column) -> Column:
    return F.get(array, 0)


def distinct_by(array: Column, key) -> Column:
    """First element of each key, order kept."""
    return let(F.transform(array, key), lambda keys: F.filter(
        array, lambda s, i: F.array_position(keys, F.get(keys, i)) == i + 1))


def unpack(df, keys, array, marker: str):
    """One row per struct of `array`, its fields as columns.

    The outer generator keeps the optimizer from inferring a `size(array) > 0` filter, which would be pushed
    below the projection and compute a costly array a second and third time.
    """
    out = df.select(*keys, F.inline_outer(array))
    return out.where(F.col(marker).isNotNull())


def unnest(df, keys, array, name: str):
    """One row per element of `array`, as column `name`; same plan shape as `unpack`."""
    return df.select(*keys, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def scanned(df: DataFrame, name: str, kind: str, of: str, scan: Callable[[list], list]) -> DataFrame:
    """The rows with one more column: `scan` of each row's `of` array, in Arrow batches.

    For what needs one pass in order over a row's elements, which lambdas over arrays can only do by copying.
    """
    ship(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(name, _parse_datatype_string(kind))])
    at, arrow = df.columns.index(of), to_arrow_type(schema[name].dataType)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([scan(x or []) for x in batch.column(at).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, new], names=[*batch.schema.names, name])

    return df.mapInArrow(apply, schema)
