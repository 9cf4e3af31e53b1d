"""Sessions: records of one key separated by pauses.

Null times are left out. Null keys form keys of their own. A record that is delivered again
(same keys, time and sequence number) counts once; null sequence numbers are never taken
for equal ones of other times. An empty table has no sessions. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.operators.ordered_scan import differs, in_order, runs, scan


def _scan(n_keys: int, gap: int):
    def fragments(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        t = columns[n_keys].to_numpy()
        if len(t) == 1:
            starts, same = np.array([0]), np.zeros(1, bool)
        else:
            key = np.zeros(len(t) - 1, bool)
            for column in columns[:n_keys]:
                key |= differs(column)
            pause = np.diff(t)
            starts = runs(key | (pause > gap))
            same = np.concatenate([[False], ~key & (pause == 0) & ~differs(columns[n_keys + 1])])
        ends = np.append(starts[1:], len(t)) - 1
        kept = np.add.reduceat((~same).astype(np.int64), starts)
        at, last = pa.array(starts), pa.array(ends)
        return pa.RecordBatch.from_arrays(
            [*(c.take(at) for c in columns[:n_keys]), pa.array(t[starts]), pa.array(t[ends]), pa.array(kept), columns[n_keys + 1].take(at), columns[n_keys + 1].take(last)],
            names=[*batch.schema.names[:n_keys], "start_ns", "end_ns", "n_records", "first_seq", "last_seq"],
        )

    def values(one: pa.RecordBatch) -> list:
        return [c[0].as_py() for c in one.columns]

    def joins(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        x, y = values(a), values(b)
        return x[:n_keys] == y[:n_keys] and y[n_keys] - x[n_keys + 1] <= gap

    def join(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = values(a), values(b)
        again = y[n_keys] == x[n_keys + 1] and y[n_keys + 3] == x[n_keys + 4]  # its first record was the last one before
        row = [*x[: n_keys + 1], y[n_keys + 1], x[n_keys + 2] + y[n_keys + 2] - again, x[n_keys + 3], y[n_keys + 4]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, a.schema, strict=True)], schema=a.schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(stream, fragments, joins, join)

    return run


def sessions(log: DataFrame, keys: list[str], time: str = "ts_ns", seq: str = "seq", gap: int = 1_800_000_000_000) -> DataFrame:
    """(keys, start_ns, end_ns, duration_ns, n_records), one row per session.

    A session goes on while each record comes at most ``gap`` after the one before.
    """
    if gap < 0 or not keys:
        raise ValueError("need keys and a gap of 0 or more")
    rows = log.select(*keys, F.col(time).cast("long").alias("_t"), F.col(seq).cast("long").alias("_s")).filter(F.col("_t").isNotNull())
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*keys).dtypes)
    parts = in_order(rows, keys, ["_t", "_s"]).mapInArrow(
        _scan(len(keys), gap), f"{kinds}, start_ns long, end_ns long, n_records long, first_seq long, last_seq long, edge boolean"
    )
    parts = parts.drop("first_seq", "last_seq")
    # Two fragments a task at most; a session over several tasks is put together here.
    by_start = Window.partitionBy(*keys).orderBy("start_ns", "end_ns")
    new = F.when(F.col("start_ns") - F.lag("end_ns").over(by_start) <= gap, 0).otherwise(1)
    edges = parts.filter("edge").withColumn("_new", new).withColumn("_run", F.sum("_new").over(by_start))
    joined = edges.groupBy(*keys, "_run").agg(F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.sum("n_records").alias("n_records"))
    out = parts.filter("not edge").select(*keys, "start_ns", "end_ns", "n_records").unionByName(joined.drop("_run"))
    return out.withColumn("duration_ns", F.col("end_ns") - F.col("start_ns"))
