"""Whole traces in Arrow batches: one shuffle by trace, then vectorised work on many traces at a time.

Rows of a trace meet in one partition, sorted by trace, and reach the worker in batches that are cut
only between traces. A worker holds about ``CHUNK`` rows, or one trace where that has more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import ship

#: A row of an engine is an object of about a kilobyte, so a worker holds some 20 MB of them whatever the table's size.
CHUNK = 20_000


def _cut(batches: Iterator[pa.RecordBatch], key: str, chunk: int) -> Iterator[pa.Table]:
    """Runs of whole groups of about ``chunk`` rows from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < chunk:
            continue
        last = batch.column(key)[batch.num_rows - 1]
        if held[0].column(key)[0] == last:
            continue  # one group so far
        whole = pa.Table.from_batches(held)
        keys = whole.column(key)
        # the last group may go on in the next batch: it starts where the equal keys begin
        at = np.flatnonzero(pc.not_equal(keys, last).to_numpy(zero_copy_only=False))
        edge = int(at[-1]) + 1 if len(at) else 0
        if edge:
            yield whole.slice(0, edge)
            held = whole.slice(edge).to_batches()
            rows -= edge
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        held.clear()  # a giant trace is held once
        yield whole


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of equal keys in one partition.

    Dealt by a hash of its own: a ``repartition`` by columns that a join or an aggregate has dealt by already is dropped
    from the plan, and where that join then turns out small enough to be broadcast, its other side is read as it lies.
    """
    return df.repartition(F.xxhash64(*keys))


def map_traces(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, key: str = "trace_id", chunk: int = CHUNK) -> DataFrame:
    """``fn`` over all rows, called with whole groups of ``key`` (many at a time, sorted by it)."""
    return map_whole(dealt(df, key).sortWithinPartitions(key), fn, schema, key, chunk)


def map_whole(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str, key: str = "trace_id", chunk: int = CHUNK) -> DataFrame:
    """:func:`map_traces` of rows that come group by group as it is, in any order: nothing is shuffled.

    They come so from a step that made them so, with nothing but columns and filters since.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _cut(batches, key, chunk):
            yield from fn(rows.combine_chunks()).to_batches()

    return df.mapInArrow(run, schema)


def groups(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the runs of equal keys."""
    edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)] if len(keys) else [0]
    return list(zip(edges[:-1], edges[1:], strict=True))
