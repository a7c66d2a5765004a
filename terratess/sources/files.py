"""Single interchange files on any file system that Spark reaches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

CHUNK = 1 << 20


def write_file(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Streams parts into one file; memory holds about a megabyte."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(context._jsc.hadoopConfiguration()).create(at, True)
    held = bytearray()
    for p in parts:
        held += p
        if len(held) >= CHUNK:
            out.write(bytes(held))
            held = bytearray()
    out.write(bytes(held))
    out.close()


def read_file(spark: SparkSession, path: str) -> bytes:
    """A file of bounded size, whole."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def ranges(spark: SparkSession, path: str) -> Callable[[int, int], bytes]:
    """A function that reads (offset, length) of a file, wherever Spark reaches it."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())

    def read(offset: int, n: int) -> bytes:
        stream = files.open(at)
        try:
            stream.seek(offset)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    return read


def ordered(df: DataFrame, *keys: str) -> Iterator:
    """Rows in order, fetched partition by partition."""
    return df.orderBy(*keys).toLocalIterator(prefetchPartitions=True)
