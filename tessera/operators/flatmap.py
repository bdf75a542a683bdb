"""Flat-map a user function over the items of a column.

An iterable result becomes one row per element, any other result one row (``None``
included); a string is iterable, so it becomes one row per character.  Items reach the
function as the Python values of their column type (a nullable integer stays an integer),
and results leave in bounded chunks, so one item may yield any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

CHUNK_ROWS = 10_000


def _elements(result: Any) -> Iterator[Any]:
    yield from result if isinstance(result, Iterable) else (result,)


def flat_map(df: DataFrame, fn: Callable, item_col: str, value_type: str | DataType,
             *args, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows (item, value) for every value ``fn(item, *args)`` yields."""
    value = _parse_datatype_string(value_type) if isinstance(value_type, str) else value_type
    schema = StructType([StructField(item_col, df.schema[item_col].dataType, True),
                         StructField("value", value, True)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = ((item, v) for b in batches for item in b.column(0).to_pylist()
                 for v in _elements(fn(item, *args)))
        while chunk := list(islice(pairs, chunk_rows)):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*chunk), arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.select(item_col).mapInArrow(run, schema)
