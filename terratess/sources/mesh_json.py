"""Mesh, parameter and initial-condition files in JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.sources.files import ordered, write_file

_MESH = "mesh struct<vertex: array<array<double>>, nvertex: int, neigh: array<array<int>>, elem: array<array<int>>, is_geographic: int, proj4: string, UTM_zone: int, nelem: int, version: string, cell_global_id: array<int>, local_size: array<int>, partition_method: string>"


def read_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``vertex``, ``elem``, ``neigh`` and one-row ``meta`` tables."""
    m = spark.read.schema(_MESH).json(path, multiLine=True).select("mesh.*")
    three = lambda field, key, names, kind: m.select(F.posexplode(field).alias(key, "r")).select(F.col(key).cast("int").alias(key), *[F.col("r")[k].cast(kind).alias(n) for k, n in enumerate(names)])
    return {
        "vertex": three("vertex", "vid", ("x", "y", "z"), "double"),
        "elem": three("elem", "tri", ("v0", "v1", "v2"), "int"),
        "neigh": three("neigh", "tri", ("n0", "n1", "n2"), "int"),
        "meta": m.select("nvertex", "nelem", "is_geographic", "proj4", F.col("UTM_zone").alias("utm_zone"), "version", "partition_method", "local_size", "cell_global_id"),
    }


def read_param(spark: SparkSession, path: str) -> DataFrame:
    """Columns of equal length as one row per triangle; NaN is null."""
    wide = spark.read.json(path, multiLine=True, allowNonNumericNumbers=True)
    names = [c for c, t in wide.dtypes if t.startswith("array")]
    rows = wide.select(F.posexplode(F.arrays_zip(*names)).alias("tri", "r"))
    return rows.select(F.col("tri").cast("int").alias("tri"), *[F.nanvl(F.col(f"r.{c}").cast("double"), F.lit(None).cast("double")).alias(c) for c in names])


def _number(v) -> str:
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NaN"
    return json.dumps(v)


def _array(name: str, values: Iterator[str], last: bool = False) -> Iterator[bytes]:
    yield f"        {json.dumps(name)}: [".encode()
    for k, v in enumerate(values):
        yield (",\n" if k else "\n").encode() + f"            {v}".encode()
    yield f"\n        ]{'' if last else ','}\n".encode()


def write_mesh(path: str, vertex: DataFrame, elem: DataFrame, neigh: DataFrame, meta: dict) -> None:
    spark = vertex.sparkSession

    def parts() -> Iterator[bytes]:
        yield b'{\n    "mesh": {\n'
        for k, v in ({"nvertex": vertex.count(), "nelem": elem.count(), "version": "1.0"} | meta).items():
            yield f"        {json.dumps(k)}: {json.dumps(v)},\n".encode()
        yield from _array("vertex", (f"[{_number(r.x)}, {_number(r.y)}, {_number(r.z)}]" for r in ordered(vertex, "vid")))
        yield from _array("neigh", (f"[{r.n0}, {r.n1}, {r.n2}]" for r in ordered(neigh, "tri")))
        yield from _array("elem", (f"[{r.v0}, {r.v1}, {r.v2}]" for r in ordered(elem, "tri")), last=True)
        yield b"    }\n}\n"

    write_file(spark, path, parts())


def write_param(path: str, table: DataFrame) -> None:
    """One list per column, in order of triangles; null is NaN. Each column is one ordered pass."""
    names = [c for c in table.columns if c != "tri"]

    def parts() -> Iterator[bytes]:
        yield b"{\n"
        for k, c in enumerate(names):
            yield from _array(c, (_number(r[0]) for r in ordered(table.select(c, "tri"), "tri")), last=k == len(names) - 1)
        yield b"}\n"

    write_file(table.sparkSession, path, parts())


write_ic = write_param
