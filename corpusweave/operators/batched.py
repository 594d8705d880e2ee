"""User functions over Arrow batches; a batch may return any number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

BatchFunction = Callable[[pa.RecordBatch], pa.RecordBatch]


def map_batches(rows: DataFrame, function: BatchFunction, schema: str) -> DataFrame:
    """Apply a function to batches whose bounds carry no meaning."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield function(batch)

    return rows.mapInArrow(each, schema)


def map_groups(rows: DataFrame, keys: list[str], function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply a function to whole groups, where the bounds do carry meaning.

    A group is one task's table, so its keys must bound its rows, as the packing
    groups do.
    """
    return rows.groupBy(*keys).applyInArrow(function, schema)
