"""Blobs addressed by the digest of their content: put once, get, list, collect.

Metadata and content lie in one table partitioned by the first byte of the digest, so a get
reads one of 256 parts and a put only looks where its content would lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.session import materialize

_KINDS = "blob_id string, content binary, size long, shard string"


def addressed(blobs: DataFrame, content: str = "content") -> DataFrame:
    """(blob_id, content, size, shard): each different content once, named by its SHA-256; null content is left out."""
    rows = blobs.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("blob_id"), F.col(content).alias("content"))
    once = rows.dropDuplicates(["blob_id"])
    return once.select("blob_id", "content", F.octet_length("content").cast("long").alias("size"), F.substring("blob_id", 1, 2).alias("shard"))


class BlobStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(_KINDS).parquet(self.path)
        except Exception as e:  # nothing has been put yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _KINDS)

    def put(self, blobs: DataFrame, content: str = "content") -> DataFrame:
        """(blob_id, size, new) of each different content; what is there already is not written again."""
        rows = materialize(addressed(blobs, content), "blobs")
        known = self.table().select("shard", "blob_id", F.lit(False).alias("new"))
        rows = materialize(rows.join(known, ["shard", "blob_id"], "left").withColumn("new", F.col("new").isNull()), "blobs")
        rows.filter("new").select("blob_id", "content", "size", "shard").write.mode("append").partitionBy("shard").parquet(self.path)
        return rows.select("blob_id", "size", "new")

    def get(self, blob_id: str) -> DataFrame:
        return self.table().filter((F.col("shard") == blob_id[:2]) & (F.col("blob_id") == blob_id)).select("content")

    def list(self) -> DataFrame:
        return self.table().select("blob_id", "size")

    def delete(self, blob_ids: DataFrame) -> int:
        """Delete blobs by id; gives how many there were. Only shards that lose one are written anew."""
        gone = materialize(self.list().join(blob_ids.select("blob_id").distinct(), "blob_id", "left_semi").select("blob_id", F.substring("blob_id", 1, 2).alias("shard")), "gone")
        n = gone.count()
        if n:
            shards = [r[0] for r in gone.select("shard").distinct().collect()]  # at most 256
            kept = materialize(self.table().filter(F.col("shard").isin(shards)).join(gone, ["shard", "blob_id"], "left_anti").select("blob_id", "content", "size", "shard"), "kept")
            for shard in shards:
                part = kept.filter(F.col("shard") == shard).drop("shard")
                part.write.mode("overwrite").parquet(f"{self.path}/shard={shard}")
        return n

    def sweep(self, keep: DataFrame) -> int:
        """Delete every blob that ``keep`` (blob_id) does not hold."""
        return self.delete(self.list().join(keep.select("blob_id"), "blob_id", "left_anti"))
