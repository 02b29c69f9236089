"""Running a batch function over Arrow record batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def map_lists(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str | T.StructType) -> DataFrame:
    """Apply a column-list function to each Arrow batch of ``df``.

    ``make`` runs once a task and returns the function, which takes a dict of Python lists (one per
    input column) and returns such a dict for ``schema``. Batches without result rows are skipped.
    """
    target = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = _arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            out = apply({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            if out and len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, target)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
