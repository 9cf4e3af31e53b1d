"""Session defaults and lineage cuts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_SHARED = f"file:///tmp/engrava-{uuid.uuid4().hex[:12]}"
_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("engrava")
    defaults = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session may leave it unset; it then gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    return _LOCAL_SHARED


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` to a table in the shared folder and read it back.

    The table outlives any executor. It is removed by ``release``, or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._engrava_path = path
    return out


def materialize_observed(df: DataFrame, name: str, *measures: Column) -> tuple[DataFrame, dict]:
    """``materialize``, with aggregates over the rows taken while they are written, so that a loop needs one job a round."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return materialize(df.observe(seen, *measures), name), seen.get


def release(df: DataFrame) -> None:
    """Delete the table behind a materialized frame that nothing reads any more."""
    path = df._engrava_path
    for spark, other in list(_written):
        if other == path:
            _written.remove((spark, other))
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Bytes a shuffle partition should hold.
PARTITION_BYTES = 64 << 20


def wide_enough(df: DataFrame, size: int, *keys: str) -> DataFrame:
    """``df`` with enough shuffle partitions by ``keys`` for ``size`` bytes, if the session's number is too small.

    Adaptive execution only ever merges partitions, so what outgrows the setting is spread here.
    """
    wanted = -(-int(size) // PARTITION_BYTES)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder together with the materialized tables."""
    _written.append((spark, path))


def release_materialized() -> None:
    """Delete every table ``materialize`` wrote in this process."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(release_materialized)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ready: set[str] = set()


def _probe(frames):
    import importlib.util

    for frame in frames:
        yield frame.assign(found=importlib.util.find_spec("engrava") is not None)


def ensure_workers(spark: SparkSession) -> None:
    """Make this package importable for the executors' Python workers, if it is not already.

    Where workers do not see the package (no common folder on their path), it is shipped
    to them once per application.
    """
    context = spark.sparkContext
    if context.applicationId in _ready:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    from pyspark import cloudpickle

    probe = cloudpickle.loads(cloudpickle.dumps(_probe))
    probe.__module__ = "__main__"  # sent by value: the workers may not know this module
    seen = spark.range(0, 4, 1, 4).mapInPandas(probe, "id long, found boolean").filter("not found").count()
    if seen:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="engrava-")) / "engrava.zip"  # the driver's copy; Spark distributes it
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, Path("engrava") / file.relative_to(root))
        context.addPyFile(str(archive))
    _ready.add(context.applicationId)
