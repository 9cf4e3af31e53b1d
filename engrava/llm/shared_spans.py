"""Long spans that stand verbatim in more than one document.

Level-wise doubling. Level 1 takes, from every run of window starts, a content-selected
window of a quarter of the wanted length; level 2 extends only those windows found in
more than one document to twice their length; level 3 hashes every window of the full
length around the survivors of level 2. Each level moves only what the level before left:
a span of the full length always holds a selected window whose extension lies inside it,
so nothing is lost.

Documents with null id are left out; null, empty and short texts have no spans; rows that
repeat an id count as one document. Other columns are ignored, whatever their names.
Windows are compared by 64-bit hashes of their code points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.llm import textkernel as k
from engrava.llm.arrow import batches, signed, texts_of
from engrava.session import materialize

_WINDOWS = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("hash", pa.int64())])
_WINDOWS_SQL = "doc_id long, pos int, hash long"


def _geometry(length: int) -> tuple[int, int, int]:
    """Width of the first windows, how far they grow to the left, starts in a run."""
    base = max(1, length // 4)
    return base, base // 2, length - 2 * base + 1


def _windows_of(pick: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A map over (doc_id, text[, at]) that emits the windows ``pick`` chooses."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = texts_of(batch.column(1))
            at = batch.column(2) if batch.num_columns > 2 else None
            for lo, hi in k.chunks(texts):
                points, starts = k.code_points(texts[lo:hi])
                given = None if at is None else at.slice(lo, hi - lo)
                where, hashes = pick(points, starts, given)
                doc = np.searchsorted(starts, where, side="right") - 1
                yield from batches(_WINDOWS, ids[lo:hi][doc], (where - starts[doc]).astype(np.int32), signed(hashes))

    return run


def _first_windows(length: int):
    base, _, run = _geometry(length)

    def pick(points, starts, _):
        hashes = k.Prefix(points).all(base)
        where = k.anchors(hashes, run)
        doc = np.searchsorted(starts, where, side="right") - 1
        where = where[where + base <= starts[doc + 1] - 1]
        return where, hashes[where]

    return pick


def _given(starts, given):
    flat = given.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(given)), np.diff(given.offsets.to_numpy()))
    return flat + starts[doc], doc


def _doubled_windows(length: int):
    base, left, _ = _geometry(length)

    def pick(points, starts, given):
        where, doc = _given(starts, given)
        begin = where - left
        fits = (begin >= starts[doc]) & (begin + 2 * base <= starts[doc + 1] - 1)
        begin = begin[fits]
        return begin, k.Prefix(points).of(begin, begin + 2 * base)

    return pick


def _full_windows(length: int):
    base, _, _ = _geometry(length)

    def pick(points, starts, given):
        where, doc = _given(starts, given)
        low = np.maximum(where + 2 * base - length, starts[doc])
        high = np.minimum(where, starts[doc + 1] - 1 - length)
        change = np.zeros(len(points) + 1, np.int32)
        real = low <= high
        np.add.at(change, low[real], 1)
        np.add.at(change, high[real] + 1, -1)
        begin = np.flatnonzero(np.cumsum(change[:-1]) > 0)
        return begin, k.Prefix(points).of(begin, begin + length)

    return pick


def _repeated(windows: DataFrame) -> DataFrame:
    """The windows whose content stands in more than one document."""
    twice = (
        windows.groupBy("hash")
        .agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
        .filter("_low < _high")
        .select("hash")
    )
    return windows.join(twice, "hash", "left_semi")


def _texts_with(docs: DataFrame, windows: DataFrame) -> DataFrame:
    at = windows.groupBy("doc_id").agg(F.collect_set("pos").alias("at"))
    return docs.join(at, "doc_id").select("doc_id", "text", "at")


def shared_windows(docs: DataFrame, length: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos) of every window of ``length`` code points that also stands in another document."""
    if length < 1:
        raise ValueError("length must be at least 1")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") >= length)
    )
    first = materialize(docs.mapInArrow(_windows_of(_first_windows(length)), _WINDOWS_SQL), "span1")
    left = _texts_with(docs, _repeated(first).select("doc_id", "pos"))
    second = materialize(left.mapInArrow(_windows_of(_doubled_windows(length)), _WINDOWS_SQL), "span2")
    left = _texts_with(docs, _repeated(second).select("doc_id", "pos"))
    third = materialize(left.mapInArrow(_windows_of(_full_windows(length)), _WINDOWS_SQL), "span3")
    return _repeated(third).select("doc_id", "pos")


def shared_spans(docs: DataFrame, length: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (doc_id, start_pos, end_pos) per longest stretch of characters covered by shared windows.

    Windows that overlap or touch belong to one stretch; positions count code points from 0.
    """
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    gap = F.col("pos") - F.lag("pos").over(by_pos)
    return (
        shared_windows(docs, length, id_col, text_col)
        .withColumn("_new", F.when(gap <= length, 0).otherwise(1))
        .withColumn("_stretch", F.sum("_new").over(by_pos))
        .groupBy("doc_id", "_stretch")
        .agg(F.min("pos").alias("start_pos"), (F.max("pos") + length).cast("int").alias("end_pos"))
        .select("doc_id", "start_pos", "end_pos")
    )


def shared_share(docs: DataFrame, length: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, n_spans, shared_chars, share) for every document with a shared span."""
    spans = (
        shared_spans(docs, length, id_col, text_col)
        .groupBy("doc_id")
        .agg(F.count("*").alias("n_spans"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    )
    sizes = docs.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(
        F.max(F.length(text_col)).cast("long").alias("n_chars")
    )
    return sizes.join(spans, "doc_id").select(
        "doc_id", "n_chars", "n_spans", "shared_chars", (F.col("shared_chars") / F.col("n_chars")).alias("share")
    )
