"""A three-dimensional map of a vector corpus: projection, clusters and labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.operators.knn import vectors_of
from engrava.operators.quant import farthest_points, lloyd, nearest_rows, sample_matrix


def _moments(dim: int):
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((dim + 1, dim + 1))
        for batch in stream:
            _, x = vectors_of(batch.column(0), dim)
            one = np.hstack([np.ones((len(x), 1)), x])
            gram += one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(gram.size, dtype=np.int32)), pa.array(gram.ravel())], schema=schema)

    return run


def principal_axes(vectors: DataFrame, dim: int, axes: int = 3, steps: int = 40, vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, leading axes by power iteration with deflation, and the scale that gives the first axis a spread of 12.

    Only one (dim + 1)^2 matrix a task is shuffled.
    """
    sums = vectors.select(vec_col).mapInArrow(_moments(dim), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    gram = np.zeros((dim + 1) ** 2)
    for r in sums:
        gram[r["at"]] = r["value"]
    gram = gram.reshape(dim + 1, dim + 1)
    n = max(gram[0, 0], 1)
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    out = []
    for c in range(axes):
        v = np.sin((np.arange(dim) + 1) * (c + 1)) + 0.1
        for _ in range(steps):
            v = cov @ v - sum((a @ (cov @ v)) * a for a in out)
            size = np.linalg.norm(v)
            v = v / size if size > 1e-12 else v * 0
        out.append(v)
    spread = float(np.sqrt(max(out[0] @ cov @ out[0], 0)))
    return mean, np.array(out), 12 / spread if spread > 1e-9 else 1.0


def _project(mean, axes, scale, centres, dim: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["embedding"].tolist(), float).reshape(len(frame), dim)
            p = (x - mean) @ axes.T * scale
            at = nearest_rows(p, centres)[0] if len(p) else np.empty(0, np.int64)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "cluster": at.astype(np.int32)})

    return run


def galaxy(vectors: DataFrame, dim: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x, y, z, cluster): min(6, max(2, n / 12)) clusters of the projected points, farthest-point seeding."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding")).filter(F.size("embedding") == dim)
    n = rows.count()
    mean, axes, scale = principal_axes(rows, dim)
    clusters = min(max(min(max(n // 12, 2), 6), 1), max(n, 1))
    x = (sample_matrix(rows, "embedding", dim) - mean) @ axes.T * scale
    centres = lloyd(x, farthest_points(x, clusters), 25, reseed=False) if len(x) else np.zeros((1, 3))
    return rows.mapInPandas(_project(mean, axes, scale, centres, dim), "vec_id long, x double, y double, z double, cluster int")


def modal_labels(points: DataFrame, tags: DataFrame, fallback: str = "group") -> DataFrame:
    """(cluster, size, label): the most frequent first tag, ties to the lower one, else the fallback with a number."""
    counts = points.join(tags, "vec_id").filter("tag <> ''").groupBy("cluster", "tag").agg(F.count("*").alias("n"))
    top = counts.groupBy("cluster").agg(F.min_by("tag", F.struct((-F.col("n")).alias("n"), "tag")).alias("label"))
    sizes = points.groupBy("cluster").agg(F.count("*").alias("size"))
    return sizes.join(top, "cluster", "left").withColumn("label", F.coalesce("label", F.concat(F.lit(fallback + " "), (F.col("cluster") + 1).cast("string"))))


def heat(records: DataFrame, order: str, group: str) -> DataFrame:
    """Position of each record in its group's order, from 0 to 1, and the access count drawn from it."""
    rn = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    n = F.count("*").over(Window.partitionBy(group))
    value = F.when(n > 1, rn / (n - 1)).otherwise(F.lit(0.0))
    return records.withColumn("heat", value).withColumn("access", (F.floor(F.col("heat") * 1000) + 1).cast("long"))
