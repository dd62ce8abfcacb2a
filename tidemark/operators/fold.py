"""Ordered folds over keys as one shuffle and one sort, streamed through Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], new_state: Callable[[], list], step: Callable, outputs: str) -> DataFrame:
    """``df`` with the columns of ``outputs`` that ``step(state, *inputs)`` returns for each row in the order of its key.

    Rows are dealt by key and sorted; a task walks its rows batch by batch and keeps one key's state, so
    a key may be longer than memory. ``order`` must be unique within a key.
    """
    names = df.columns
    added = [x.split()[0] for x in outputs.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in added), outputs])
    kept = [n for n in names if n not in added]
    key_name = unused(df, "_fold_key")
    keyed = df.withColumn(key_name, F.struct(*keys) if len(keys) > 1 else F.col(keys[0]))
    arrow = [_ARROW[x.split(" ", 1)[1]] for x in outputs.split(", ")]

    def run(batches):
        current, state = _NONE, None
        for batch in batches:
            key_column = batch.column(batch.schema.names.index(key_name)).to_pylist()
            columns = [batch.column(batch.schema.names.index(c)).to_pylist() for c in inputs]
            out = [[] for _ in added]
            for key, *row in zip(key_column, *columns):
                if key != current:
                    current, state = key, new_state()
                for col, v in zip(out, step(state, *row)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.names.index(c)) for c in kept], *[pa.array(c, t) for c, t in zip(out, arrow)]], names=[*kept, *added],
            )

    return keyed.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


_NONE = object()
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()),
}
