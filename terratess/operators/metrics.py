"""Errors of triangles against rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.functions.geometry import plane
from terratess.model import Grid
from terratess.operators.raster import sample_points
from terratess.operators.spatial import TILE, touched

METRICS = ("rmse", "mean_tol", "max_tol", "cover")


def _sampled(elem: DataFrame, vertex: DataFrame, cells: DataFrame, grid: Grid, layers: list[str]) -> DataFrame:
    """Corners with their cell (px, py) and each layer's value there."""
    at = sample_points(vertex.select("vid", "x", "y"), cells, grid, layers)
    for k in range(3):
        v = at.select(F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("x", "y", "px", "py", *[f"{n}" for n in layers])])
        elem = elem.join(v, f"v{k}")
    return elem


def errors(elem: DataFrame, vertex: DataFrame, cells: DataFrame, grid: Grid, layers: dict[str, str], tile: int = TILE) -> DataFrame:
    """One row per triangle: for each layer (a column of ``cells``) the error named ``{layer}_{metric}``.

    ``rmse`` and ``max_tol`` compare the layer with the plane through its values at
    the vertices, in cell indices; they are 0 if a vertex has no value, the
    vertices' cells are collinear, or no cell is valid. ``mean_tol`` is the distance
    of the means, 0 if either is missing. ``cover`` is the share of the dominant
    whole-number category: 1 without data, 0 if the vertices' categories differ.
    All layers share one spatial join.
    """
    for m in layers.values():
        if m not in METRICS:
            raise ValueError(f"unknown error metric {m!r}; known are {', '.join(METRICS)}")
    names = list(layers)
    t = _sampled(elem, vertex, cells, grid, names)
    flat = [n for n, m in layers.items() if m in ("rmse", "max_tol")]
    put = {}
    for n in flat:
        p = plane(*[F.col(c) for k in range(3) for c in (f"px{k}", f"py{k}", f"{n}{k}")])
        put |= {f"{n}_{c}": v for c, v in p.items()}
    t = t.withColumns(put) if put else t
    keep = ["tri", *put]
    hits = touched(t, cells.select("px", "py", *names), grid, tile, keep=keep)
    stats = []
    for n, m in layers.items():
        v = F.col(n)
        if m in ("rmse", "max_tol"):
            gap = F.try_divide(-(F.col(f"{n}_pa") * F.col("px") + F.col(f"{n}_pb") * F.col("py") - F.col(f"{n}_pd")), F.col(f"{n}_pc").cast("double")) - v
            stats.append((F.sqrt(F.avg(gap * gap)) if m == "rmse" else F.max(F.abs(gap))).alias(f"{n}_stat"))
        elif m == "mean_tol":
            stats.append(F.avg(v).alias(f"{n}_stat"))
    out = t
    if stats:
        out = out.join(hits.groupBy("tri").agg(*stats), "tri", "left")
    for n, m in layers.items():
        if m == "cover":
            out = out.join(histogram(hits, n).groupBy("tri").agg((F.max("n") / F.sum("n")).alias(f"{n}_stat")), "tri", "left")
    final = []
    for n, m in layers.items():
        z = [F.col(f"{n}{k}") for k in range(3)]
        stat = F.col(f"{n}_stat")
        if m in ("rmse", "max_tol"):
            value = F.coalesce(stat, F.lit(0.0))
        elif m == "mean_tol":
            held = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in z[1:]), F.when(z[0].isNotNull(), 1).otherwise(0))
            total = sum((F.coalesce(c, F.lit(0.0)) for c in z[1:]), F.coalesce(z[0], F.lit(0.0)))
            value = F.coalesce(F.abs(F.try_divide(total, held) - stat), F.lit(0.0))
        else:
            kinds = [c.cast("int") for c in z]
            none = z[0].isNull() & z[1].isNull() & z[2].isNull()
            same = F.coalesce((kinds[0] == kinds[1]) & (kinds[1] == kinds[2]), F.lit(False))
            value = F.when(none | stat.isNull(), F.lit(1.0)).when(~same, F.lit(0.0)).otherwise(stat)
        final.append(value.alias(f"{n}_{m}"))
    return out.select("tri", *final)


def histogram(hits: DataFrame, layer: str) -> DataFrame:
    """Cells per (triangle, whole-number category); fractions are cut off."""
    return hits.where(F.col(layer).isNotNull()).groupBy("tri", F.col(layer).cast("int").alias("category")).agg(F.count("*").alias("n"))


def histogram_map(hits: DataFrame, layer: str) -> DataFrame:
    """The same as one map per triangle."""
    return histogram(hits, layer).groupBy("tri").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("categories"))


def mesh_rmse(elem: DataFrame, vertex: DataFrame, cells: DataFrame, grid: Grid, layer: str = "z", tile: int = TILE) -> DataFrame:
    """RMSE for reports: as ``rmse``, but null where a vertex has no value, the plane is vertical or no cell is valid."""
    t = _sampled(elem, vertex, cells, grid, [layer])
    p = plane(*[F.col(c) for k in range(3) for c in (f"px{k}", f"py{k}", f"{layer}{k}")])
    t = t.withColumns(p)
    hits = touched(t, cells.select("px", "py", layer), grid, tile, keep=["tri", *p])
    gap = F.try_divide(-(F.col("pa") * F.col("px") + F.col("pb") * F.col("py") - F.col("pd")), F.col("pc").cast("double")) - F.col(layer)
    return t.select("tri").join(hits.groupBy("tri").agg(F.sqrt(F.avg(gap * gap)).alias("rmse")), "tri", "left")
