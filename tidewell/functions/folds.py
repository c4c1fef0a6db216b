"""Folds that depend on order: rows are dealt by key, sorted within each partition and read once as a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packaging import ship


def fold_in_order(df: DataFrame, key: str, order: str, start: Callable[[], dict], step: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
    """One row per row of `df`: what `step` returns for the state of its key and the row, in the order of `order`.

    `schema` names the key, the order and what `step` returns. A task holds one batch of rows and the state of one key, so a key
    may have any number of rows; those of one key are read by one task, since each depends on the one before. A null key is a
    key like others.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        current, state = object(), start()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != current:
                    current, state = row[key], start()
                out.append((row[key], row[order], *step(state, row)))
            yield out

    return _folded(df, key, order, rows, schema)


def fold_to_last(df: DataFrame, key: str, order: str, start: Callable[[], tuple], step: Callable[[tuple, dict], tuple], schema: str) -> DataFrame:
    """One row per key: the state, a tuple, after all its rows in the order of `order`. `schema` names the key and the state."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        begun, current, state = False, None, start()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != current:
                    if begun:
                        out.append((current, *state))
                    begun, current, state = True, row[key], start()
                state = step(state, row)
            yield out
        if begun:
            yield [(current, *state)]

    return _folded(df, key, order, rows, schema)


def _folded(df: DataFrame, key: str, order: str, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]], schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(df.sparkSession)
    # The schema as Spark reads it, without a job.
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    names, types = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows(batches):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

    return df.repartition(F.col(key)).sortWithinPartitions(key, order).mapInArrow(run, schema)
