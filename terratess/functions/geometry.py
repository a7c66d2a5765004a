"""Geometry of triangles and grid cells as column expressions.

All stay inside code generation. Divisions that can meet zero give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terratess.model import Grid


def map_to_pixel(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """Cell indices, truncated towards zero; the far edge belongs to the last cell, and one cell before the first to the first."""

    def index(value: Column, origin: float, step: float, size: int) -> Column:
        i = ((value - F.lit(origin)) / F.lit(step)).cast("int")
        return F.when(i == size, F.lit(size - 1)).when(i == -1, F.lit(0)).otherwise(i)

    return index(x, grid.ulx, grid.dx, grid.width), index(y, grid.uly, grid.dy, grid.height)


def to_grid(x: Column, y: Column, grid: Grid) -> tuple[Column, Column]:
    """Fractional cell coordinates."""
    return (x - F.lit(grid.ulx)) / F.lit(grid.dx), (y - F.lit(grid.uly)) / F.lit(grid.dy)


def bbox_window(xs: list[Column], ys: list[Column], grid: Grid) -> dict[str, Column]:
    """The window of cells under a bounding box, clamped to the grid: first and last column and row."""
    span = lambda a, b, o, s, n: (
        F.greatest(F.least(((a - o) / s).cast("int"), ((b - o) / s).cast("int")), F.lit(0)),
        F.least(F.greatest(((a - o) / s).cast("int"), ((b - o) / s).cast("int")) + 1, F.lit(n)) - 1,
    )
    px0, px1 = span(F.least(*xs), F.greatest(*xs), grid.ulx, grid.dx, grid.width)
    py0, py1 = span(F.least(*ys), F.greatest(*ys), grid.uly, grid.dy, grid.height)
    return {"px0": px0, "px1": px1, "py0": py0, "py1": py1}


def double_area(x0, y0, x1, y1, x2, y2) -> Column:
    """Twice the signed area; positive if counter-clockwise."""
    return (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)


def area(x0, y0, x1, y1, x2, y2) -> Column:
    return F.abs(double_area(x0, y0, x1, y1, x2, y2)) / 2


def area_on(grid: Grid) -> Callable[..., Column]:
    """The size of a triangle on a grid in square metres: plane, or equal-area where coordinates are degrees."""
    if not grid.geographic:
        return area

    def sized(x0, y0, x1, y1, x2, y2) -> Column:
        flat = F.transform(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y1), (x2, y2))]), lambda p: F.struct(*[c.alias(n) for c, n in zip(mollweide(p["x"], p["y"]), "xy")]))
        return F.get(F.transform(F.array(flat), lambda p: area(*[p[k][n] for k in range(3) for n in "xy"])), F.lit(0))

    return sized


def squared_edges(x0, y0, x1, y1, x2, y2) -> list[Column]:
    """Squared lengths of the edges opposite each vertex."""
    d = lambda ax, ay, bx, by: (ax - bx) * (ax - bx) + (ay - by) * (ay - by)
    return [d(x1, y1, x2, y2), d(x0, y0, x2, y2), d(x0, y0, x1, y1)]


def min_sine2(x0, y0, x1, y1, x2, y2) -> Column:
    """Squared sine of the smallest angle; null for a triangle without extent."""
    a, b, c = squared_edges(x0, y0, x1, y1, x2, y2)
    twice = double_area(x0, y0, x1, y1, x2, y2)
    longest = F.greatest(a, b, c)
    middle = a + b + c - longest - F.least(a, b, c)
    return F.try_divide(twice * twice, longest * middle)


def angles(x0, y0, x1, y1, x2, y2) -> list[Column]:
    """Inner angles in degrees; null where an edge has no length."""

    def corner(ax, ay, bx, by, cx, cy):
        ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
        cosine = F.try_divide(ux * vx + uy * vy, F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy))
        return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))

    return [corner(x0, y0, x1, y1, x2, y2), corner(x1, y1, x2, y2, x0, y0), corner(x2, y2, x0, y0, x1, y1)]


def plane(px0, py0, z0, px1, py1, z1, px2, py2, z2) -> dict[str, Column]:
    """The plane through three points as ``a * x + b * y + c * z = d``."""
    u = (px1 - px0, py1 - py0, z1 - z0)
    v = (px2 - px0, py2 - py0, z2 - z0)
    a = u[1] * v[2] - v[1] * u[2]
    b = v[0] * u[2] - u[0] * v[2]
    c = u[0] * v[1] - v[0] * u[1]
    return {"pa": a, "pb": b, "pc": c, "pd": a * px0 + b * py0 + c * z0}


def mean_z(z0: Column, z1: Column, z2: Column) -> Column:
    return (z0 + z1 + z2) / 3


def mollweide(lon: Column, lat: Column, steps: int = 12) -> tuple[Column, Column]:
    """Equal-area Mollweide metres of geographic degrees on the WGS84 major radius.

    ``2t + sin 2t = pi sin(lat)`` is solved by a fixed number of Newton steps, as a
    fold so that the expression stays small; poles, where the derivative vanishes,
    are exact.
    """
    radius = 6378137.0
    phi = F.radians(lat)
    step = lambda t, _: t - F.coalesce(F.try_divide(2 * t + F.sin(2 * t) - math.pi * F.sin(phi), 2 + 2 * F.cos(2 * t)), F.lit(0.0))
    t = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), phi, step)
    t = F.when(F.abs(lat) >= 90, F.signum(lat) * (math.pi / 2)).otherwise(t)
    return F.lit(2 * math.sqrt(2) / math.pi * radius) * F.radians(lon) * F.cos(t), F.lit(math.sqrt(2) * radius) * F.sin(t)
