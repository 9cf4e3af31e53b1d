"""Binary vector files and journal frames."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: crc32, seq, time, type, tenant and payload length, little-endian; the largest payload.
HEADER = struct.Struct("<IQqBHI")
MAX_PAYLOAD = 16 << 20


def encode_frame(seq: int, ts_ns: int, kind: int, tenant: int, payload: bytes) -> bytes:
    if len(payload) > MAX_PAYLOAD:
        raise ValueError("payload too large")
    body = HEADER.pack(0, seq, ts_ns, kind, tenant, len(payload))[4:] + payload
    return struct.pack("<I", zlib.crc32(body)) + body


def decode_frames(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, bool]]:
    """(seq, ts_ns, type, tenant, payload, whole) up to the first torn or damaged frame, which comes out not whole."""
    at = 0
    while at < len(data):
        if at + HEADER.size > len(data):
            yield 0, 0, 0, 0, b"", False
            return
        crc, seq, ts, kind, tenant, size = HEADER.unpack_from(data, at)
        end = at + HEADER.size + size
        if size > MAX_PAYLOAD or end > len(data) or zlib.crc32(data[at + 4 : end]) != crc:
            yield 0, 0, 0, 0, b"", False
            return
        yield seq, ts, kind, tenant, data[at + HEADER.size : end], True
        at = end


def _frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"], strict=True):
            rows = [(path, *r) for r in decode_frames(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "seq", "ts_ns", "type", "tenant", "payload", "whole"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Journal records of segment files; damage before the last segment's tail is an error, a torn tail is cut."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInPandas(_frames, "path string, seq long, ts_ns long, type int, tenant int, payload binary, whole boolean")
    last = files.agg(F.max("path").alias("_last"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    damaged = F.when(~F.col("whole") & (F.col("path") != F.col("_last")), F.raise_error(F.concat(F.lit("damaged segment "), F.col("path")))).otherwise(F.col("whole"))
    return rows.withColumn("whole", damaged.cast("boolean")).filter("whole").select("seq", "ts_ns", "type", "tenant", F.decode("payload", "UTF-8").alias("payload"))


#: Bytes of a vector file one task reads at once.
RANGE_BYTES = 32 << 20


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system.open_input_file(where)


def _uri(path: str) -> str:
    """'file:/x' as Spark writes it, in the form all file systems read."""
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _ranges(kind: str, dtype: pa.DataType):
    schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), ("vec", pa.list_(dtype))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, length, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not length:
                    continue
                with _open(_uri(path)) as file:
                    (dim,) = struct.unpack("<i", file.read(4)) if length >= 4 else (0,)
                    size = 4 + 4 * dim
                    if dim <= 0 or length % size:
                        raise ValueError(f"damaged vector file {path}")
                    first, last = -(-start // size), -(-min(end, length) // size)  # records that begin in the range
                    if last <= first:
                        continue
                    file.seek(first * size)
                    raw = np.frombuffer(file.read((last - first) * size), "<i4").reshape(-1, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"damaged vector file {path}")
                values = np.ascontiguousarray(raw[:, 1:]).view(kind)
                for lo in range(0, len(values), 10_000):
                    part = values[lo : lo + 10_000]
                    vec = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel(), dtype), dim).cast(pa.list_(dtype))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(first + lo, first + lo + len(part))), vec], schema=schema)

    return run


def _read_vecs(spark: SparkSession, path: str, kind: str, dtype: pa.DataType, element: str) -> DataFrame:
    """Files are cut into byte ranges, so one file of any size spreads over tasks and none is held whole."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # the content is not read
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn("end", F.col("start") + RANGE_BYTES)
    spread = ranges.repartition(max(1, min(ranges.count(), 100_000)), "path", "start")
    return spread.mapInArrow(_ranges(kind, dtype), f"path string, pos long, vec array<{element}>")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, vec array<float>) of files of (dimension, floats) records, all of one dimension in a file."""
    return _read_vecs(spark, path, "<f4", pa.float32(), "float")


def read_ivecs(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, vec array<int>) of files of (dimension, integers) records, all of one dimension in a file."""
    return _read_vecs(spark, path, "<i4", pa.int32(), "int")


def encode_vecs(vectors, kind: str = "<f4") -> bytes:
    return b"".join(struct.pack("<i", len(v)) + np.asarray(v, kind).tobytes() for v in vectors)


def _writer(folder: str, suffix: str, encode):
    schema = pa.schema([("path", pa.string()), ("n", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        context, n, out = TaskContext.get(), 0, None
        system, where = fs.FileSystem.from_uri(folder)
        name = f"{where}/part-{context.partitionId():05d}"
        try:
            for batch in stream:
                if out is None:  # a retried task writes under a name of its own and moves it at the end
                    system.create_dir(where, recursive=True)
                    out = system.open_output_stream(f"{name}.{context.taskAttemptId()}.tmp")
                out.write(encode(batch))
                n += batch.num_rows
        finally:
            if out is not None:
                out.close()
        if out is not None:
            system.move(f"{name}.{context.taskAttemptId()}.tmp", f"{name}.{suffix}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.{suffix}"]), pa.array([n])], schema=schema)

    return run


def _write(df: DataFrame, folder: str, suffix: str, encode) -> int:
    rows = df.mapInArrow(_writer(_uri(folder), suffix, encode), "path string, n long")
    return rows.agg(F.sum("n")).first()[0] or 0


def write_vecs(df: DataFrame, folder: str, vec_col: str = "vec", kind: str = "<f4") -> int:
    """One file a task of (dimension, numbers) records; gives the number of vectors. Null vectors are left out."""
    encode = lambda batch: encode_vecs((v for v in batch.column(0).to_pylist()), kind)
    return _write(df.filter(F.col(vec_col).isNotNull()).select(vec_col), folder, "fvecs" if kind == "<f4" else "ivecs", encode)


def write_segments(df: DataFrame, folder: str) -> int:
    """One segment a task of (seq, ts_ns, type, tenant, payload) records as frames, in the order of the rows."""
    columns = df.select("seq", "ts_ns", F.col("type").cast("int"), F.col("tenant").cast("int"), F.encode("payload", "UTF-8"))
    return _write(columns, folder, "seg", lambda batch: b"".join(encode_frame(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)))
