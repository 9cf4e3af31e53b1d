"""Small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows an operator hands back to Spark at once.
OUT_ROWS = 50_000


def lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with ``counts[i]`` of the consecutive ``values`` in row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def batches(schema: pa.Schema, *columns) -> Iterator[pa.RecordBatch]:
    n = len(columns[0])
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    for i in range(0, n, OUT_ROWS):
        yield pa.RecordBatch.from_arrays([a.slice(i, OUT_ROWS) for a in arrays], schema=schema)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
