"""Analytic surfaces, generated in parallel from a range."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.model import Grid
from terratess.operators.raster import grid_cells


def _cells(spark: SparkSession, rows: int, columns: int, value: Column) -> DataFrame:
    return grid_cells(spark, Grid(0, 1, 0, -1, columns, rows)).select("px", "py", value.alias("v"))


def flat(spark: SparkSession, rows: int, columns: int, z: float = 1000.0) -> DataFrame:
    return _cells(spark, rows, columns, F.lit(float(z)))


def ridge(spark: SparkSession, rows: int, columns: int, dx: float, height: float = 300.0, width: float = 600.0) -> DataFrame:
    """A ridge along the middle row."""
    r = (F.col("py") - rows / 2) / (width / dx)
    return _cells(spark, rows, columns, 2 * height / (1 + r * r) - height)


def gauss(spark: SparkSession, rows: int, columns: int, height: float = 1000.0) -> DataFrame:
    """A square hill as wide as the longer side; its full width at half height is a quarter of that."""
    side = max(rows, columns)
    f = side / 4
    d2 = (F.col("px") - rows / 2) * (F.col("px") - rows / 2) + (F.col("py") - columns / 2) * (F.col("py") - columns / 2)
    return _cells(spark, side, side, 2 * height * F.exp(-4 * math.log(2) * d2 / (f * f)) - height)


def vegpatch(spark: SparkSession, rows: int, columns: int, shift: int = 50, half: int = 500, inside: float = 100.0, outside: float = 1.0) -> DataFrame:
    """A square patch beside the middle."""
    near = lambda c, n: (F.col(c) - (n // 2 + shift) >= -half) & (F.col(c) - (n // 2 + shift) < half)
    return _cells(spark, rows, columns, F.when(near("py", rows) & near("px", columns), F.lit(inside)).otherwise(F.lit(outside)))
