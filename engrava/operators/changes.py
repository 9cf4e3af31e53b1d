"""Replaying a change feed of inserts, partial updates and deletes into the current table.

Changes apply per key in the order of (seq, step), however often and late they arrive. An
upsert makes its key live and sets the columns it gives (null: not given); a delete ends the
key if it is live and forgets its columns. Changes with a null key or null seq are left out;
an unknown operation is an error; an empty feed gives an empty table.

``apply_changes`` replays a whole feed. ``apply_feed`` carries on from the state an earlier
call left: for each key the position (seq, step) of its last write, of its last delete and of
the change that set each column. A change is skipped if its key has been deleted at or after
its position, or if it is the very change the state holds; a change that comes late but was
not applied takes its place in the order. So a feed may be applied in parts, in any order and
more than once, with the result of one run over all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.operators.ordered_scan import differs, in_order, runs, scan

UPSERT, DELETE = "upsert", "delete"


def _replay(n_keys: int, n_columns: int):
    """Fragments: keys, first seq, last seq written, whether live at the end, whether it holds a delete, columns."""

    def fragments(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = batch.columns
        seq, is_write = columns[n_keys].to_numpy(), columns[n_keys + 2].to_numpy(zero_copy_only=False)
        n = len(seq)
        key = np.zeros(n - 1, bool)
        for column in columns[:n_keys]:
            key |= differs(column)
        starts = runs(key)
        ends = np.append(starts[1:], n) - 1
        group = np.repeat(np.arange(len(starts)), ends - starts + 1)
        at = np.arange(n)
        deleted = np.maximum.reduceat(np.where(is_write, -1, at), starts)
        written = np.maximum.reduceat(np.where(is_write, at, -1), starts)
        since = is_write & (at > deleted[group])
        values = []
        for column in columns[n_keys + 3 :]:
            given = since & pc.is_valid(column).to_numpy(zero_copy_only=False)
            last = np.maximum.reduceat(np.where(given, at, -1), starts)
            values.append(column.take(pa.array(last, mask=last < 0)))
        first = pa.array(starts)
        return pa.RecordBatch.from_arrays(
            [
                *(c.take(first) for c in columns[:n_keys]),
                columns[n_keys].take(first),
                columns[n_keys + 1].take(first),
                pa.array(seq[np.maximum(written, 0)], mask=written < 0),
                pa.array(is_write[ends]),
                pa.array(deleted >= 0),
                *values,
            ],
            names=[*batch.schema.names[:n_keys], "_first", "_step", "_seq", "_live", "_deleted", *batch.schema.names[n_keys + 3 :]],
        )

    def joins(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(i)[0].as_py() == b.column(i)[0].as_py() for i in range(n_keys))

    def join(a: pa.RecordBatch, b: pa.RecordBatch) -> pa.RecordBatch:
        wiped = b.column(n_keys + 4)[0].as_py()
        pick = lambda i: (b if wiped or b.column(i)[0].is_valid else a).column(i)
        columns = [*a.columns[: n_keys + 2]]
        columns.append((b if b.column(n_keys + 2)[0].is_valid else a).column(n_keys + 2))
        columns.append(b.column(n_keys + 3))
        columns.append(pa.array([wiped or a.column(n_keys + 4)[0].as_py()]))
        columns += [pick(i) for i in range(n_keys + 5, n_keys + 5 + n_columns)]
        return pa.RecordBatch.from_arrays(columns, schema=a.schema)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(stream, fragments, joins, join)

    return run


def apply_changes(changes: DataFrame, keys: list[str], columns: list[str] | None = None, seq: str = "seq", step: str | None = None, op: str = "op") -> DataFrame:
    """(keys, seq, columns): one row per key live at the end; ``seq`` is that of the last change that wrote it.

    ``op`` is 'upsert' or 'delete'; ``step`` orders changes of one sequence number. Repeated
    deliveries lie next to each other in the order and change nothing.
    """
    if not keys:
        raise ValueError("need keys")
    columns = columns or []
    known = F.when(F.col(op) == UPSERT, True).when(F.col(op) == DELETE, False).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(F.col(op), F.lit("null")))))
    order = F.lit(0) if step is None else F.coalesce(F.col(step).cast("int"), F.lit(0))
    rows = changes.select(*keys, F.col(seq).cast("long").alias("_s"), order.alias("_p"), known.cast("boolean").alias("_w"), *columns)
    rows = rows.filter(" and ".join(f"`{c}` is not null" for c in (*keys, "_s")))
    types = dict(rows.dtypes)
    kinds = ", ".join(
        [*(f"`{c}` {types[c]}" for c in keys), "_first long, _step int, _seq long, _live boolean, _deleted boolean", *(f"`{c}` {types[c]}" for c in columns), "edge boolean"]
    )
    parts = in_order(rows, keys, ["_s", "_p"]).mapInArrow(_replay(len(keys), len(columns)), kinds)
    whole = parts.filter("not edge and _live").select(*keys, F.col("_seq").alias("seq"), *columns)
    # Two fragments a task at most: a key that spans tasks is replayed from its fragments.
    by_order = Window.partitionBy(*keys).orderBy("_first", "_step")
    edges = parts.filter("edge").withColumn("_n", F.row_number().over(by_order))
    edges = edges.withColumn("_from", F.max(F.when(F.col("_deleted"), F.col("_n"))).over(Window.partitionBy(*keys)))
    since = F.col("_n") >= F.coalesce("_from", F.lit(0))
    given = [F.max_by(c, F.when(since & F.col(c).isNotNull(), F.col("_n"))).alias(c) for c in columns]
    joined = edges.groupBy(*keys).agg(F.max("_seq").alias("seq"), F.max_by("_live", "_n").alias("_live"), *given).filter("_live")
    return whole.unionByName(joined.select(*keys, "seq", *columns))


_AT = "struct<s:bigint,p:int>"


def _placed(changes: DataFrame, keys: list[str], columns: list[str], seq: str, step: str | None, op: str) -> DataFrame:
    """(keys, _s, _p, _op, columns): each given column with the position of its change, ``_write`` the position itself for writes."""
    order = F.lit(0) if step is None else F.coalesce(F.col(step).cast("int"), F.lit(0))
    rows = changes.select(*keys, F.col(seq).cast("long").alias("_s"), order.alias("_p"), F.col(op).alias("_op"), *columns)
    rows = rows.filter(" and ".join(f"`{c}` is not null" for c in (*keys, "_s")))
    held = [F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), F.col("_s").alias("s"), F.col("_p").alias("p"))).alias(c) for c in columns]
    return rows.select(*keys, "_s", "_p", "_op", *held, F.when(F.col("_op") == UPSERT, F.struct(F.lit(True).alias("v"), F.col("_s").alias("s"), F.col("_p").alias("p"))).alias("_write"))


def _as_changes(state: DataFrame, keys: list[str], columns: list[str], types: dict[str, str]) -> DataFrame:
    """A state as the shortest feed that makes it: a row for its delete, its last write and each column."""
    none = {c: F.lit(None).cast(types[c]).alias(c) for c in (*columns, "_write")}
    parts = [F.struct(F.col("deleted.s").alias("_s"), F.col("deleted.p").alias("_p"), F.lit(DELETE).alias("_op"), *none.values())]
    for held in (*columns, "_write"):
        at = F.col(held)
        given = [at.alias(c) if c == held else none[c] for c in (*columns, "_write")]
        parts.append(F.struct(at["s"].alias("_s"), at["p"].alias("_p"), F.lit(UPSERT).alias("_op"), *given))
    rows = state.select(*keys, F.explode(F.array(*parts)).alias("_r")).filter("_r._s is not null")
    return rows.select(*keys, "_r.*")


def apply_feed(state: DataFrame | None, changes: DataFrame, keys: list[str], columns: list[str] | None = None, seq: str = "seq", step: str | None = None, op: str = "op") -> DataFrame:
    """The state after more changes: (keys, columns, _write, deleted), one row per key ever live or deleted.

    A column is a struct (v, s, p) of its value and the position that set it, ``_write`` the
    position of the last write (null: not live), ``deleted`` that of the last delete.
    ``current`` gives the live rows, ``skipped`` tells how many changes would be skipped.
    """
    columns = columns or []
    feed = _placed(changes, keys, columns, seq, step, op)
    types = dict(feed.dtypes)
    if state is not None:
        feed = _unskipped(state, feed, keys, columns).unionByName(_as_changes(state, keys, columns, types))
    live = apply_changes(feed, keys, [*columns, "_write"], "_s", "_p", "_op").drop("seq")
    ends = feed.filter(F.col("_op") == DELETE).groupBy(*keys).agg(F.max(F.struct(F.col("_s").alias("s"), F.col("_p").alias("p"))).alias("deleted"))
    return live.join(ends, keys, "full").select(*keys, *columns, "_write", F.col("deleted").cast(_AT).alias("deleted"))


def _skip(columns: list[str]):
    """Whether the change (_s, _p) has been applied to the state's row or lies before its last delete."""
    at = F.struct(F.col("_s").alias("s"), F.col("_p").alias("p"))
    same = F.coalesce(F.col("_state._write.s") == F.col("_s"), F.lit(False)) & F.coalesce(F.col("_state._write.p") == F.col("_p"), F.lit(False))
    for c in columns:  # the state's write holds all it gave, unless a column of it was given later
        same = same & (F.col(c).isNull() | (F.struct(F.col(f"_state.`{c}`.s"), F.col(f"_state.`{c}`.p")) >= at))
    return F.coalesce(F.col("_state.deleted").cast(_AT) >= at, F.lit(False)) | same


def _with_state(state: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in state.columns if c not in keys]
    return feed.join(state.select(*keys, F.struct(*rest).alias("_state")), keys, "left")


def _unskipped(state: DataFrame, feed: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return _with_state(state, feed, keys).filter(~_skip(columns)).drop("_state")


def skipped(state: DataFrame, changes: DataFrame, keys: list[str], columns: list[str] | None = None, seq: str = "seq", step: str | None = None, op: str = "op") -> DataFrame:
    """(n_changes, n_skipped) of a feed that is to be applied to a state."""
    columns = columns or []
    rows = _with_state(state, _placed(changes, keys, columns, seq, step, op), keys)
    return rows.agg(F.count("*").alias("n_changes"), F.count_if(_skip(columns)).alias("n_skipped"))


def current(state: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(keys, seq, columns): the live rows of a state."""
    return state.filter("_write is not null").select(*keys, F.col("_write.s").alias("seq"), *(F.col(f"`{c}`.v").alias(c) for c in columns or []))
