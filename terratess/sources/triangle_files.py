"""Planar graphs and meshes as numbered text: .poly, .node, .ele, .neigh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.sources.files import ordered, write_file

def _rows(spark: SparkSession, path: str) -> DataFrame:
    """Fields ``n`` of every line, what follows a ``#`` left out, with the line's place."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.split("value", "#")[0].alias("value"))
    return lines.select("line", F.array_remove(F.split("value", r"\s+"), "").alias("n")).where(F.size("n") > 0)


def _body(spark: SparkSession, path: str) -> DataFrame:
    rows = _rows(spark, path)
    return rows.crossJoin(rows.agg(F.min("line").alias("head"))).where("line > head")  # one row


def read_node(spark: SparkSession, path: str) -> DataFrame:
    """``(vid, x, y)``, ids from 0."""
    return _body(spark, path).select((F.get("n", F.lit(0)).cast("int") - 1).alias("vid"), F.get("n", F.lit(1)).cast("double").alias("x"), F.get("n", F.lit(2)).cast("double").alias("y"))


def read_ele(spark: SparkSession, path: str) -> DataFrame:
    return _body(spark, path).select((F.get("n", F.lit(0)).cast("int") - 1).alias("tri"), *[(F.get("n", F.lit(k + 1)).cast("int") - 1).alias(f"v{k}") for k in range(3)])


def read_neigh(spark: SparkSession, path: str) -> DataFrame:
    """Missing neighbours (0 or less in the file) are -1."""
    return _body(spark, path).select((F.get("n", F.lit(0)).cast("int") - 1).alias("tri"), *[F.greatest(F.get("n", F.lit(k + 1)).cast("int") - 1, F.lit(-1)).alias(f"n{k}") for k in range(3)])


def read_poly(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vertices ``(vid, x, y)`` and segments ``(sid, v0, v1)``, ids from 0.

    The header says how many vertices follow; the line after them how many segments.
    """
    from pyspark.sql import Window

    rows = _rows(spark, path).withColumn("place", F.row_number().over(Window.orderBy("line")) - 1)
    many = rows.where("place = 0").select(F.get("n", F.lit(0)).cast("int").alias("many"))
    rows = rows.crossJoin(many)  # one row
    vertex = rows.where("place between 1 and many").select((F.get("n", F.lit(0)).cast("int") - 1).alias("vid"), F.get("n", F.lit(1)).cast("double").alias("x"), F.get("n", F.lit(2)).cast("double").alias("y"))
    segment = rows.where("place > many + 1 and size(n) >= 3").select((F.get("n", F.lit(0)).cast("int") - 1).alias("sid"), (F.get("n", F.lit(1)).cast("int") - 1).alias("v0"), (F.get("n", F.lit(2)).cast("int") - 1).alias("v1"))
    return vertex, segment


def write_poly(path: str, vertex: DataFrame, segment: DataFrame) -> None:
    def parts():
        yield f"{vertex.count()} 2 0 0\n".encode()
        yield from (f"{r.vid + 1} {r.x:.17g} {r.y:.17g}\n".encode() for r in ordered(vertex, "vid"))
        yield f"{segment.count()} 0\n".encode()
        yield from (f"{r.sid + 1} {r.v0 + 1} {r.v1 + 1}\n".encode() for r in ordered(segment, "sid"))
        yield b"0\n"

    write_file(vertex.sparkSession, path, parts())


def write_triangles(stem: str, vertex: DataFrame, elem: DataFrame, neigh: DataFrame) -> None:
    """``stem``.node, .ele and .neigh with ids from 1; missing neighbours are 0."""
    spark = vertex.sparkSession

    def node():
        yield f"{vertex.count()} 2 0 1\n".encode()
        yield from (f"{r.vid + 1} {r.x:.17g} {r.y:.17g} 0\n".encode() for r in ordered(vertex, "vid"))

    def three(table, names):
        yield f"{table.count()} 3\n".encode()
        yield from (f"{r.tri + 1} {' '.join(str(r[c] + 1) for c in names)}\n".encode() for r in ordered(table, "tri"))

    write_file(spark, f"{stem}.node", node())
    write_file(spark, f"{stem}.ele", three(elem, ("v0", "v1", "v2")))
    write_file(spark, f"{stem}.neigh", three(neigh, ("n0", "n1", "n2")))
