"""Statistics of the cells under each triangle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratess.model import Grid
from terratess.operators.spatial import TILE, touched


def mode_of(v: Column) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(v, True)


METHODS: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "average": F.avg, "max": F.max, "min": F.min, "mode": mode_of, "count": F.count, "sum": F.sum}


def aggregate_of(method) -> Callable[[Column], Column]:
    """A named method, or a callable from an array of the valid cells' values to a number, run as an Arrow-batched grouped function."""
    if callable(method):

        def f(v: pd.Series) -> float:
            out = method(v.to_numpy(dtype=np.float64))
            return None if out is None or out == -9999 or out != out else float(out)

        return F.pandas_udf(f, "double")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(sorted(METHODS))}")
    return METHODS[method]


def zonal(triangles: DataFrame, cells: DataFrame, grid: Grid, columns: dict[str, tuple[str, object]], tile: int = TILE) -> DataFrame:
    """One row per triangle: for each output name a (cell column, method) pair.

    All layers of one grid share a single spatial join. Triangles without a valid
    cell keep a row of nulls (0 for counts). Null cell values are nodata and count
    nowhere. Partial sums per task keep the shuffle at one row per triangle and task.
    """
    used = sorted({c for c, _ in columns.values()})
    hits = touched(triangles, cells.select("px", "py", *used), grid, tile)
    named = [aggregate_of(m)(F.col(c)).alias(name) for name, (c, m) in columns.items()]
    if any(callable(m) for _, m in columns.values()) and not all(callable(m) for _, m in columns.values()):
        # user functions and built-in aggregates don't mix in one aggregation
        own = {n: x for n, x in columns.items() if callable(x[1])}
        rest = {n: x for n, x in columns.items() if not callable(x[1])}
        return zonal(triangles, cells, grid, rest, tile).join(zonal(triangles, cells, grid, own, tile), "tri")
    if any(callable(m) for _, m in columns.values()):
        hits = hits.where(" or ".join(f"{c} is not null" for c in used))
    found = hits.groupBy("tri").agg(*named)
    out = triangles.select("tri").join(found, "tri", "left")
    counts = [n for n, (_, m) in columns.items() if m == "count"]
    return out.fillna(0, subset=counts) if counts else out


def plain(classifier: Callable[..., float]) -> Callable[..., Column]:
    """A classifier of columns from a function of numbers (None where a value is missing) that must not return None; it runs over Arrow batches."""

    def each(*values: pd.Series) -> pd.Series:
        rows = zip(*(v.astype(object).where(v.notna(), None) for v in values))
        return pd.Series([_called(classifier, r) for r in rows], dtype="float64")

    batched: Callable[..., Column] = F.pandas_udf(each, "double")
    return batched


def classified(table: DataFrame, name: str, inputs: Sequence[str], classifier: Callable[..., Column], drop_inputs: bool = True) -> DataFrame:
    """Applies ``classifier`` to columns: a function of columns that returns a column, preferably built from ``when``; ``plain`` makes one of a function of numbers."""
    value = classifier(*[F.col(c) for c in inputs])
    if not isinstance(value, Column):
        raise TypeError("a classifier returns a column; wrap a function of numbers in plain()")
    out = table.withColumn(name, value)
    return out.drop(*[c for c in inputs if c != name]) if drop_inputs else out


def _called(classifier, values):
    out = classifier(*values)
    if out is None:
        raise ValueError("a classifier must return a value")
    return float(out)


def layered(rasters: dict[str, DataFrame]) -> DataFrame:
    """Aligned rasters ``(px, py, v)`` as one table of cells, a column for each; a cell that a raster lacks is null there."""
    out = None
    for name, cells in rasters.items():
        one = cells.select("px", "py", F.col("v").alias(name))
        out = one if out is None else out.join(one, ["px", "py"], "full")
    if out is None:
        raise ValueError("no rasters")
    return out


def substituted(v: Column, nodata: float = -9999.0) -> Column:
    """Null for the nodata value of files."""
    return F.nullif(v, F.lit(nodata))


def zonal_window(triangles: DataFrame, cells: DataFrame, grid: Grid, name: str, column: str, method: Callable[[np.ndarray], float], tile: int = TILE) -> DataFrame:
    """``method`` of each triangle's window: a 2-D array of its cells, rows by py, NaN where a cell is outside or nodata.

    For callables that need the shape; those that don't belong in ``zonal``. A
    triangle's window is built in one task, so its size bounds the memory. Null for
    triangles without a valid cell, and for a NaN or nodata result.
    """
    hits = touched(triangles, cells.select("px", "py", F.col(column).cast("double").alias("v")), grid, tile).where("v is not null")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        px, py = group["px"].to_numpy(), group["py"].to_numpy()
        window = np.full((py.max() - py.min() + 1, px.max() - px.min() + 1), np.nan)
        window[py - py.min(), px - px.min()] = group["v"]
        out = float(method(window))
        return pd.DataFrame({"tri": [int(group["tri"].iloc[0])], name: [None if out != out or out == -9999 else out]}).astype({"tri": "int32", name: "float64"})

    return triangles.select("tri").join(hits.groupBy("tri").applyInPandas(run, f"tri int, {name} double"), "tri", "left")
