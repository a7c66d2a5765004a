"""Tables written to the folder that the whole cluster shares.

Iterative plans cut their lineage here: a staged table survives the loss of any
executor, which a cached or locally checkpointed one does not.
"""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_DIR = "/tmp/checkpoints/terratess"
_STAGED: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local default only where that is unset and all runs in one process, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or DEFAULT_DIR).rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back; duplicates and nulls are kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "_staged_path", None)
        if path and (spark := _STAGED.pop(path, None)) is not None:
            _delete(spark, path)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_STAGED.items()):
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone already
            return


class SharedFile:
    """A file of bounded size in the shared folder, written part by part."""

    def __init__(self, spark: SparkSession, name: str):
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        self.path: str = files.makeQualified(path).toString()
        self._out = files.create(path, True)

    def write(self, part: bytes) -> None:
        for at in range(0, len(part), 1 << 22):
            self._out.write(bytearray(part[at : at + (1 << 22)]))

    def close(self) -> None:
        self._out.close()


def put(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file of bounded size to the shared folder; returns its full path."""
    out = SharedFile(spark, name)
    out.write(content)
    out.close()
    return out.path
