"""Arrow-batched Python functions over DataFrames, for what no built-in expression can say."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def struct_of(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], dict], schema: str | T.StructType) -> DataFrame:
    """``function`` gives the columns (lists or Arrow arrays) that a batch of ``df`` becomes."""
    kind = struct_of(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        for b in batches:
            if b.num_rows:
                columns = function(b)
                yield pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def map_groups(left: DataFrame, right: DataFrame, keys: list[str], function: Callable[[dict, dict], dict], schema: str | T.StructType) -> DataFrame:
    """Co-groups of two DataFrames; ``function`` takes their columns as lists and gives the result's."""
    kind = struct_of(schema)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(function(a.to_pydict(), b.to_pydict()), schema=to_arrow_schema(kind))

    right = right.select(*(right[c].alias(c) for c in right.columns))  # columns of its own, where both sides come from one table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, kind)


def map_group(df: DataFrame, keys: list[str], function: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """Groups of bounded size; ``function`` takes their columns as lists and gives the result's."""
    kind = struct_of(schema)

    def run(a: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(function(a.to_pydict()), schema=to_arrow_schema(kind))

    return df.groupBy(*keys).applyInArrow(run, kind)
