"""Table schemas and the grid of a raster.

Rasters are rows of valid cells: a missing row is nodata, so SQL nulls and joins
do what sentinels would. Meshes are vertex, element and neighbour tables with
ids from 0; -1 marks a missing neighbour.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from terratess.functions.projections import geographic

RASTER_CELLS = "raster_id string, px int, py int, v double"
RASTER_TILES = "raster_id string, tx int, ty int, w int, h int, data array<float>"
MESH_VERTEX = "vid int, x double, y double, z double"
MESH_ELEM = "tri int, v0 int, v1 int, v2 int"
MESH_NEIGH = "tri int, n0 int, n1 int, n2 int"
FEATURE = "fid bigint, gtype string, parts array<array<struct<x: double, y: double>>>, props map<string, string>"

#: The value that files use for nodata.
NODATA = -9999.0


@dataclass(frozen=True)
class Grid:
    """A north-up grid: cell (px, py) covers x from ``ulx + px * dx``, y from ``uly + py * dy``; dy is negative."""

    ulx: float
    dx: float
    uly: float
    dy: float
    width: int
    height: int
    crs: str = ""

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax."""
        xs = (self.ulx, self.ulx + self.width * self.dx)
        ys = (self.uly, self.uly + self.height * self.dy)
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def geographic(self) -> bool:
        """Whether coordinates are degrees."""
        return geographic(self.crs)

    @property
    def cell_area(self) -> float:
        return abs(self.dx * self.dy)

    @property
    def least_area(self) -> float:
        """The default smallest triangle: one cell; of a grid in degrees the square metres of its middle cell."""
        if not self.geographic:
            return self.cell_area
        degree = math.radians(1) * 6378137.0
        return self.cell_area * degree * degree * math.cos(math.radians(self.uly + self.height * self.dy / 2))

    @property
    def geotransform(self) -> tuple[float, ...]:
        return (self.ulx, self.dx, 0.0, self.uly, 0.0, self.dy)

    @staticmethod
    def of(geotransform, width: int, height: int, crs: str = "") -> Grid:
        ulx, dx, rx, uly, ry, dy = geotransform
        if rx or ry:
            raise ValueError("rotated rasters are not supported")
        return Grid(ulx, dx, uly, dy, width, height, crs)

    def require_crs(self) -> Grid:
        """Fails for a raster without a coordinate system."""
        if not self.crs:
            raise ValueError("the raster has no coordinate system")
        return self
