"""The spatial join of triangles and raster cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.functions.geometry import double_area, to_grid
from terratess.model import Grid

TILE = 16


def corners(elem: DataFrame, vertex: DataFrame) -> DataFrame:
    """``elem`` with the coordinates of its vertices: x0, y0, z0 ... x2, y2, z2.

    Three equi-joins on vertex ids; Spark broadcasts the vertices where they are
    small and shuffles both sides where not.
    """
    for k in range(3):
        v = vertex.select(F.col("vid").alias(f"v{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("z").alias(f"z{k}"))
        elem = elem.join(v, f"v{k}")
    return elem


def on_grid(triangles: DataFrame, grid: Grid) -> DataFrame:
    """Adds the corners in fractional cells: gx0, gy0 ... gx2, gy2."""
    put = {}
    for k in range(3):
        put[f"gx{k}"], put[f"gy{k}"] = to_grid(F.col(f"x{k}"), F.col(f"y{k}"), grid)
    return triangles.withColumns(put)


def _half_planes(triangles: DataFrame) -> DataFrame:
    """Adds per edge ea, eb, ec: ``ea * px + eb * py + ec > 0`` if some corner of the cell lies strictly on the triangle's side."""
    g = [(F.col(f"gx{k}"), F.col(f"gy{k}")) for k in range(3)]
    side = F.signum(double_area(*[c for p in g for c in p]))
    out = triangles.withColumn("_side", side)
    put = {}
    for k in range(3):
        (ax, ay), (bx, by) = g[k], g[(k + 1) % 3]
        ex, ey = F.col("_side") * (bx - ax), F.col("_side") * (by - ay)
        put[f"ea{k}"], put[f"eb{k}"] = -ey, ex
        put[f"ec{k}"] = ey * ax - ex * ay + F.greatest(F.lit(0.0), ex) + F.greatest(F.lit(0.0), -ey)
    return out.withColumns(put).drop("_side")


def tiled(cells: DataFrame, tile: int = TILE) -> DataFrame:
    return cells.withColumns({"tx": F.floor(F.col("px") / tile).cast("int"), "ty": F.floor(F.col("py") / tile).cast("int")})


def touched(triangles: DataFrame, cells: DataFrame, grid: Grid, tile: int = TILE, keep: list[str] | None = None) -> DataFrame:
    """Every (triangle, cell) whose interiors overlap: columns ``keep`` of the triangles (default ``tri``) and all of ``cells``.

    A theta join would be a nested loop; instead a triangle is dealt to the tiles
    under its bounding box and met there by tile key. A cell has one tile, so no pair
    arises twice; a large triangle is spread over many tiles, and a hot tile is a
    skewed key that adaptive execution can split. The overlap is open: cells that
    only share an edge or corner with a triangle do not count, and a triangle
    without area touches none.
    """
    keep = keep or ["tri"]
    edges = [f"e{c}{k}" for k in range(3) for c in "abc"]
    x, y = [F.col(f"gx{k}") for k in range(3)], [F.col(f"gy{k}") for k in range(3)]
    box = {"_x0": F.least(*x), "_x1": F.greatest(*x), "_y0": F.least(*y), "_y1": F.greatest(*y)}
    t = _half_planes(on_grid(triangles, grid)).withColumns(box).select(*keep, *edges, *box)
    tiles = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor(F.col(b) / tile).cast("int"))
    t = t.withColumn("tx", F.explode(tiles("_x0", "_x1"))).withColumn("ty", F.explode(tiles("_y0", "_y1")))
    px, py = F.col("px"), F.col("py")
    inside = (px < F.col("_x1")) & (px + 1 > F.col("_x0")) & (py < F.col("_y1")) & (py + 1 > F.col("_y0"))
    for k in range(3):
        inside = inside & (F.col(f"ea{k}") * px + F.col(f"eb{k}") * py + F.col(f"ec{k}") > 0)
    return t.join(tiled(cells, tile), ["tx", "ty"]).where(inside).drop("tx", "ty", *edges, *box)
