"""One linear pass over rows in key and time order, for keys of any size.

Rows are range-partitioned and sorted by (keys, order columns), so a key that holds a large
part of all rows spreads over many tasks. Each task scans its rows once with constant
memory and emits one fragment per run; only the first and last run of a task can continue
elsewhere, and those few fragments are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs a task hands back to Spark at once.
OUT_ROWS = 50_000


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows so that tasks hold consecutive stretches of the order by ``keys`` and ``order``; equal rows stay together."""
    by = [F.col(c) for c in (*keys, *order)]
    return rows.repartitionByRange(*by).sortWithinPartitions(*by)


def differs(column: pa.Array) -> np.ndarray:
    """For each row but the first, whether its value is another than the row's before; null equals null."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    apart = pc.fill_null(pc.not_equal(after, before), False)
    return pc.or_(apart, pc.xor(pc.is_null(after), pc.is_null(before))).to_numpy(zero_copy_only=False)


def runs(breaks: np.ndarray) -> np.ndarray:
    """Starts of the runs between rows, from the breaks before rows 1, 2, ..."""
    return np.concatenate([[0], np.flatnonzero(breaks) + 1])


def scan(
    stream: Iterator[pa.RecordBatch],
    fragments: Callable[[pa.RecordBatch], pa.RecordBatch],
    joins: Callable[[pa.RecordBatch, pa.RecordBatch], bool],
    join: Callable[[pa.RecordBatch, pa.RecordBatch], pa.RecordBatch],
) -> Iterator[pa.RecordBatch]:
    """Fragments of a sorted stream, with a last column ``edge`` that marks a task's first and last one.

    ``fragments`` turns rows into one fragment per run, ``joins`` tells whether two
    one-row fragments belong together, ``join`` makes them one.
    """
    open_, first = None, True

    def marked(batch: pa.RecordBatch, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        whole = pa.RecordBatch.from_arrays([*batch.columns, pa.array(edge)], names=[*batch.schema.names, "edge"])
        for at in range(0, whole.num_rows, OUT_ROWS):
            yield whole.slice(at, OUT_ROWS)

    for batch in stream:
        if not batch.num_rows:
            continue
        now = fragments(batch)
        if open_ is not None and joins(open_, now.slice(0, 1)):
            open_, now = join(open_, now.slice(0, 1)), now.slice(1)
        if not now.num_rows:
            continue
        if open_ is not None:
            yield from marked(open_, np.array([first]))
            first = False
        done = now.slice(0, now.num_rows - 1)
        if done.num_rows:
            edge = np.zeros(done.num_rows, bool)
            edge[0] = first
            first = False
            yield from marked(done, edge)
        open_ = now.slice(now.num_rows - 1)
    if open_ is not None:
        yield from marked(open_, np.array([True]))
