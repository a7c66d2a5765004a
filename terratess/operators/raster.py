"""Raster-to-raster operators over tables of valid cells."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.functions.geometry import map_to_pixel
from terratess.functions.projections import between, same
from terratess.model import NODATA, Grid


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """All (px, py) of a grid, made in parallel."""
    return spark.range(grid.width * grid.height).select((F.col("id") % grid.width).cast("int").alias("px"), F.floor(F.col("id") / grid.width).cast("int").alias("py"))


def centre(grid: Grid) -> tuple[Column, Column]:
    return F.lit(grid.ulx) + (F.col("px") + 0.5) * grid.dx, F.lit(grid.uly) + (F.col("py") + 0.5) * grid.dy


def valid(cells: DataFrame, nodata: float = NODATA) -> DataFrame:
    """Drops cells that hold the nodata value, NaN or null."""
    return cells.where(F.col("v").isNotNull() & (F.col("v") != nodata) & ~F.isnan("v"))


def mask(cells: DataFrame) -> DataFrame:
    """1 for every valid cell."""
    return cells.select("px", "py", F.when(F.col("v").isNotNull(), F.lit(1)).alias("mask")).where("mask = 1")


def count_valid(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("v").alias("n_cells"))


def extent_window(grid: Grid, extent: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """The window (px0, py0, w, h) of cells whose centres lie in (xmin, ymin, xmax, ymax)."""
    xmin, ymin, xmax, ymax = extent
    low = lambda v, o, s: math.ceil((v - o) / s - 0.5)
    xs = sorted(((xmin, xmax)), key=lambda v: (v - grid.ulx) / grid.dx)
    ys = sorted(((ymin, ymax)), key=lambda v: (v - grid.uly) / grid.dy)
    px = (low(xs[0], grid.ulx, grid.dx), math.floor((xs[1] - grid.ulx) / grid.dx - 0.5))
    py = (low(ys[0], grid.uly, grid.dy), math.floor((ys[1] - grid.uly) / grid.dy - 0.5))
    return px[0], py[0], max(px[1] - px[0] + 1, 0), max(py[1] - py[0] + 1, 0)


def extent_subset(cells: DataFrame, grid: Grid, extent: tuple[float, float, float, float]) -> DataFrame:
    """Cells whose centres lie in (xmin, ymin, xmax, ymax); a filter that reaches the scan as a range of px and py."""
    px, py, w, h = extent_window(grid, extent)
    return cells.where(F.col("px").between(px, px + w - 1) & F.col("py").between(py, py + h - 1))


def clip_to_polygon(cells: DataFrame, grid: Grid, rings: DataFrame) -> DataFrame:
    """Cells whose centres lie inside rings ``(fid, ring, seq, x, y)`` by the even-odd rule; rings close themselves.

    An edge is dealt to the rows of cells it crosses and met there by row number, so
    a cell sees only the crossings of its own row.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("fid", "ring").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = rings.withColumns({"bx": F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), "by": F.coalesce(F.lead("y").over(w), F.first("y").over(whole))})
    v = lambda c: (F.col(c) - grid.uly) / grid.dy - 0.5
    low, high = F.least(v("y"), v("by")), F.greatest(v("y"), v("by"))
    crossed = edge.where(F.col("y") != F.col("by")).withColumns({"_a": F.greatest(F.ceil(low), F.lit(0)).cast("int"), "_b": F.least(F.ceil(high) - 1, F.lit(grid.height - 1)).cast("int")}).where("_a <= _b")
    crossed = crossed.withColumn("py", F.explode(F.sequence("_a", "_b")))
    cy = F.lit(grid.uly) + (F.col("py") + 0.5) * grid.dy
    crossed = crossed.select("py", (F.col("x") + (cy - F.col("y")) / (F.col("by") - F.col("y")) * (F.col("bx") - F.col("x"))).alias("cross"))
    cx, _ = centre(grid)
    rows = crossed.groupBy("py").agg(F.sort_array(F.collect_list("cross")).alias("crossings"))
    hit = cells.join(rows, "py").where(F.size(F.filter("crossings", lambda c: c < cx)) % 2 == 1)
    return hit.select(*cells.columns)


def _overlaps(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Source cells dealt to the target cells that they overlap, with the shared area."""

    def span(p: str, so: float, ss: float, to: float, ts: float, n: int) -> tuple[Column, Column, Column, Column]:
        a, b = (F.lit(so) + F.col(p) * ss - to) / ts, (F.lit(so) + (F.col(p) + 1) * ss - to) / ts
        low, high = F.least(a, b), F.greatest(a, b)
        return low, high, F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(n - 1)).cast("int")

    x, y = span("px", source.ulx, source.dx, target.ulx, target.dx, target.width), span("py", source.uly, source.dy, target.uly, target.dy, target.height)
    dealt = cells.where(F.col("v").isNotNull()).select("v", x[0].alias("xa"), x[1].alias("xb"), x[2].alias("x0"), x[3].alias("x1"), y[0].alias("ya"), y[1].alias("yb"), y[2].alias("y0"), y[3].alias("y1")).where("x0 <= x1 and y0 <= y1")
    dealt = dealt.withColumn("tpx", F.explode(F.sequence("x0", "x1"))).withColumn("tpy", F.explode(F.sequence("y0", "y1")))
    wide = lambda a, b, p: F.least(F.col(b), F.col(p) + 1) - F.greatest(F.col(a), F.col(p).cast("double"))
    return dealt.select(F.col("tpx").alias("px"), F.col("tpy").alias("py"), "v", (wide("xa", "xb", "tpx") * wide("ya", "yb", "tpy")).alias("w")).where("w > 0")


def resample(cells: DataFrame, source: Grid, target: Grid, method: str = "average") -> DataFrame:
    """Cells on another grid: the mean by shared area, or for ``mode`` the value with the most shared area, the smallest of equals.

    A sum of doubles may end in another last bit in another order. For ``mode`` areas are added as
    whole numbers (2^59 to 2^60 for a whole cell), so that the order of rows decides nothing, and
    sums no farther apart than other orders could bring sums of doubles are equals.
    """
    parts = _overlaps(cells, source, target)
    if method == "mode":
        scale = 2.0 ** (60 - math.frexp(min(1.0, source.cell_area / target.cell_area))[1])
        whole = F.rint(F.col("w") * scale).cast("long").cast("decimal(20,0)")
        by = parts.groupBy("px", "py", "v").agg(F.sum(whole).cast("double").alias("w"), F.count("*").alias("n"))
        most = by.groupBy("px", "py").agg(F.max(F.struct("w", "n")).alias("most"))
        lost = (F.col("n") + F.col("most.n") - 2) * 2.0**-53
        equals = by.join(most, ["px", "py"]).where(F.col("most.w") - F.col("w") <= F.col("most.w") * lost)
        return equals.groupBy("px", "py").agg(F.min("v").alias("v"))
    if method not in ("average", "mean"):
        raise ValueError(f"unknown resampling {method!r}")
    return parts.groupBy("px", "py").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def warp(spark: SparkSession, cells: DataFrame, source: Grid, target: Grid, inverse: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Nearest-neighbour reprojection: each target cell takes the source cell under its centre. ``inverse`` maps target to source coordinates."""
    x, y = inverse(*centre(target))
    at = grid_cells(spark, target).withColumns({"_sx": F.floor((x - source.ulx) / source.dx).cast("int"), "_sy": F.floor((y - source.uly) / source.dy).cast("int")})
    from_ = cells.select(F.col("px").alias("_sx"), F.col("py").alias("_sy"), "v")
    return at.join(from_, ["_sx", "_sy"]).select("px", "py", "v")


def projected_grid(spark: SparkSession, grid: Grid, crs: str, steps: int = 21) -> Grid:
    """The grid in another coordinate system: the box of its outline there, with square cells of which the diagonal has as many."""
    xmin, ymin, xmax, ymax = grid.extent
    at = [k / (steps - 1) for k in range(steps)]
    rim = {p for t in at for p in ((xmin + t * (xmax - xmin), ymin), (xmin + t * (xmax - xmin), ymax), (xmin, ymin + t * (ymax - ymin)), (xmax, ymin + t * (ymax - ymin)))}
    x, y = between(grid.crs, crs)(F.col("x"), F.col("y"))
    a, b, c, d = spark.createDataFrame(sorted(rim), "x double, y double").select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    size = math.hypot(c - a, d - b) / math.hypot(grid.width, grid.height)
    return Grid(a, size, d, -size, max(1, round((c - a) / size)), max(1, round((d - b) / size)), crs)


def reprojected(spark: SparkSession, cells: DataFrame, source: Grid, crs: str) -> tuple[DataFrame, Grid]:
    """Cells and grid in another coordinate system, nearest neighbour; unchanged where the systems agree, an error where one is unknown."""
    if same(source.crs, crs):
        return cells, source
    target = projected_grid(spark, source, crs)
    return warp(spark, cells, source, target, between(crs, source.crs)), target


def finer(grid: Grid, factor: float) -> Grid:
    """The same extent with cells smaller by ``factor``."""
    return Grid(grid.ulx, grid.dx / factor, grid.uly, grid.dy / factor, round(grid.width * factor), round(grid.height * factor), grid.crs)


def smoothing_factors(factor: float, iterations: int) -> list[float]:
    """Factors of successive passes, each against the original cell: f, then the last one times the pass's number from 1."""
    out, f = [], factor
    for k in range(iterations):
        out.append(f)
        f *= k + 1
    return out


def smooth(spark: SparkSession, cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """Cubic B-spline interpolation: each target cell weighs the 4 x 4 source cells around its centre; missing ones drop out of the weights."""

    x, y = centre(target)
    u, v = (x - source.ulx) / source.dx - 0.5, (y - source.uly) / source.dy - 0.5
    k = F.col("k")
    at = grid_cells(spark, target).withColumns({"u": u, "v_": v}).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(15))))
    at = at.select("px", "py", "u", "v_", (F.floor("u") + k % 4 - 1).cast("int").alias("sx"), (F.floor("v_") + F.floor(k / 4) - 1).cast("int").alias("sy"))

    def weight(c: str, s: str) -> Column:
        d = F.abs(F.col(c) - F.col(s))
        return F.when(d < 1, (4 - 6 * d * d + 3 * d * d * d) / 6).otherwise((2 - d) * (2 - d) * (2 - d) / 6)

    from_ = cells.select(F.col("px").alias("sx"), F.col("py").alias("sy"), "v")
    hit = at.join(from_, ["sx", "sy"]).withColumn("w", weight("u", "sx") * weight("v_", "sy")).where("w > 0")
    return hit.groupBy("px", "py").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def _around(cells: DataFrame, radius: int) -> DataFrame:
    """``(px, py, i, j)`` for the square of offsets around each cell."""
    side = 2 * radius + 1
    near = cells.select("px", "py", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k"))
    return near.select("px", "py", (F.col("k") % side - radius).alias("i"), (F.floor(F.col("k") / side).cast("int") - radius).alias("j"))


def fill_nodata(spark: SparkSession, cells: DataFrame, grid: Grid, radius: int = 5) -> DataFrame:
    """Valid cells, and holes filled by inverse squared distance from valid cells within ``radius`` cells; farther holes stay."""
    holes = grid_cells(spark, grid).join(cells.select("px", "py"), ["px", "py"], "left_anti")
    near = _around(holes, radius).where(f"i * i + j * j between 1 and {radius * radius}").select("px", "py", (F.col("px") + F.col("i")).alias("sx"), (F.col("py") + F.col("j")).alias("sy"), (F.lit(1.0) / (F.col("i") * F.col("i") + F.col("j") * F.col("j"))).alias("w"))
    filled = near.join(cells.select(F.col("px").alias("sx"), F.col("py").alias("sy"), "v"), ["sx", "sy"]).groupBy("px", "py").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))
    return cells.select("px", "py", F.col("v").cast("double").alias("v")).unionByName(filled)


def extract_points(points: DataFrame, cells: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    """``points (pid, x, y, ...)`` with the value of their cell, else the mean of the valid cells among the eight around it, else null."""
    px, py = map_to_pixel(F.col("x"), F.col("y"), grid)
    at = points.withColumns({"px": px, "py": py})
    hit = at.join(cells.select("px", "py", F.col(value).alias("_v")), ["px", "py"], "left")
    lost = hit.where("_v is null").select("px", "py").distinct()
    around = _around(lost, 1).select("px", "py", (F.col("px") + F.col("i")).alias("_sx"), (F.col("py") + F.col("j")).alias("_sy"))
    mean = around.join(cells.select(F.col("px").alias("_sx"), F.col("py").alias("_sy"), F.col(value).alias("_n")), ["_sx", "_sy"]).groupBy("px", "py").agg(F.avg("_n").alias("_mean"))
    return hit.join(mean, ["px", "py"], "left").withColumn(value, F.coalesce("_v", "_mean")).select(*points.columns, value)


def sample_points(points: DataFrame, cells: DataFrame, grid: Grid, values: list[str]) -> DataFrame:
    """``points`` with the values of their cell, null where it is missing."""
    px, py = map_to_pixel(F.col("x"), F.col("y"), grid)
    return points.withColumns({"px": px, "py": py}).join(cells.select("px", "py", *values), ["px", "py"], "left")
