"""Per-triangle parameters: merge, validate, drop, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.functions.geometry import angles, area_on
from terratess.model import Grid
from terratess.operators.metrics import mesh_rmse
from terratess.operators.spatial import corners


def merge(*tables: DataFrame) -> DataFrame:
    """Parameters of several tables by ``tri``; of equal names the last table's stay. All must have the same triangles."""

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.drop(*[c for c in b.columns if c != "tri"]).join(b, "tri")

    return reduce(pair, tables)


def lengths(*tables: DataFrame) -> DataFrame:
    """Rows per table, and whether they agree."""
    rows = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "n") for k, t in enumerate(tables)]
    every = reduce(DataFrame.unionByName, rows)
    return every.groupBy().agg(F.count("*").alias("n_tables"), F.min("n").alias("least"), F.max("n").alias("most")).withColumn("equal", F.col("least") == F.col("most"))


def merge_checked(*tables: DataFrame) -> DataFrame:
    """``merge``, but tables of unequal length are an error."""
    found = lengths(*tables).first()
    if not found["equal"]:
        raise ValueError(f"parameter tables have between {found['least']} and {found['most']} triangles")
    return merge(*tables)


def dropped(table: DataFrame, drop: dict[str, bool]) -> DataFrame:
    return table.drop(*[k for k, gone in drop.items() if gone])


def long_form(table: DataFrame) -> DataFrame:
    """``(tri, key, value)``."""
    return table.unpivot("tri", [c for c in table.columns if c != "tri"], "key", "value")


def cells_against_triangles(cells: DataFrame, elem: DataFrame) -> DataFrame:
    """Triangles as a percentage of valid cells, to two places."""
    n = cells.agg(F.count("v").alias("n_cells"))
    return n.crossJoin(elem.agg(F.count("*").alias("n_triangles"))).withColumn("percent", F.round(F.try_divide(F.col("n_triangles") * 100.0, F.col("n_cells")), 2))


def mesh_report(elem: DataFrame, vertex: DataFrame, cells: DataFrame, grid: Grid, layer: str = "z") -> DataFrame:
    """``(tri, error, area, min_angle, max_angle)``; null where undefined."""
    t = corners(elem, vertex)
    xy = [F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")]
    a = angles(*xy)
    shape = t.select("tri", area_on(grid)(*xy).alias("area"), F.least(*a).alias("min_angle"), F.greatest(*a).alias("max_angle"))
    return shape.join(mesh_rmse(elem, vertex, cells, grid, layer), "tri").select("tri", F.col("rmse").alias("error"), "area", "min_angle", "max_angle")
