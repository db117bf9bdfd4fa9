"""Folds along the rows of a key, for state that depends on every row before."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(df: DataFrame, key: str, order: list[str | Column], columns: dict[str, Column], out: str, start: Any, step: Callable[..., tuple[Any, list[tuple]]]) -> DataFrame:
    """(key, *out): step(state, *columns) takes each row of a key in order, from start on, and gives the next state and the rows to emit.

    Rows are sorted by Spark and read as a stream of batches; a task holds a batch and one state, however
    many rows a key has. Nulls come as None.
    """
    held = {f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rows = df.select(F.col(key), *(c.alias(n) for n, c in columns.items()), *(c.alias(n) for n, c in held.items()))
    fields = T.StructType([rows.schema[key], *T.StructType.fromDDL(out).fields])
    n = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), start
        for b in batches:
            keys, emitted = b.column(0).to_pylist(), []
            for k, *values in zip(keys, *(b.column(i + 1).to_pylist() for i in range(n)), strict=True):
                if k != now:
                    now, state = k, start
                state, some = step(state, *values)
                emitted += [(k, *x) for x in some]
            columns_ = list(zip(*emitted, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns_, kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    names, kinds = fields.names, [to_arrow_type(f.dataType) for f in fields.fields]
    return rows.repartition(key).sortWithinPartitions(key, *held).mapInArrow(run, fields)
