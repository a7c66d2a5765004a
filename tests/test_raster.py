"""Raster operators on grids that don't line up."""

import math
import random

import pytest

from terratess.model import Grid
from terratess.operators import raster

FINE = Grid(1000.0, 16.0, 90000.0, -16.0, 16, 16)
COARSE = Grid(1008.0, 40.0, 89996.0, -40.0, 6, 6)

#: Cells of one target cell by category; both share the same area, and sums of doubles put either first by their order.
EVEN = {
    (0, 0): [(0, 0, 1), (0, 1, 2), (0, 2, 1), (1, 0, 1), (2, 0, 1), (2, 1, 2), (2, 2, 2)],
    (1, 1): [(3, 2, 1), (3, 5, 2), (4, 2, 2), (4, 3, 1), (4, 5, 2), (5, 4, 2)],
    (2, 1): [(5, 2, 2), (5, 5, 1), (6, 4, 2), (6, 5, 1), (7, 2, 2), (7, 3, 1)],
}


def share(cell, at, source=FINE, target=COARSE):
    a, b = ((source.ulx + (cell[0] + k) * source.dx - target.ulx) / target.dx for k in (0, 1))
    c, d = ((source.uly + (cell[1] + k) * source.dy - target.uly) / target.dy for k in (0, 1))
    return (min(b, at[0] + 1) - max(a, at[0])) * (min(d, at[1] + 1) - max(c, at[1]))


def modes(spark, rows, at):
    cells = spark.createDataFrame([(x, y, float(v)) for x, y, v in rows], "px int, py int, v double").coalesce(1)
    found = raster.resample(cells, FINE, COARSE, "mode").collect()
    return [r.v for r in found if (r.px, r.py) == at]


@pytest.mark.parametrize("at", sorted(EVEN))
def test_mode_does_not_depend_on_the_order_of_rows(spark, at):
    rows = EVEN[at]
    total = {v: math.fsum(share(r, at) for r in rows if r[2] == v) for v in (1, 2)}
    assert abs(total[1] - total[2]) <= 2.0**-52 * max(total.values())
    mixed = [random.Random(k).sample(rows, len(rows)) for k in range(4)]
    assert [modes(spark, r, at) for r in (rows, rows[::-1], *mixed)] == [[1.0]] * 6


def test_mode_of_many_small_and_of_repeated_cells(spark):
    """Shares far below and above a target cell are added without loss or overflow."""
    fine = Grid(0.0, 1.0, 0.0, -1.0, 1000, 20)
    cells = spark.range(20000).selectExpr("int(id % 1000) px", "int(id / 1000) py", "IF(id % 1000 < 500, 2D, 1D) v")
    whole = Grid(0.0, 1000.0, 0.0, -20.0, 1, 1)
    assert [r.v for r in raster.resample(cells, fine, whole, "mode").collect()] == [1.0]
    assert [r.v for r in raster.resample(cells.where("px > 0 or py > 0 or v = 1").unionByName(cells.where("px = 0 and py < 2")), fine, whole, "mode").collect()] == [2.0]
    one = spark.range(100).selectExpr("0 px", "0 py", "IF(id < 51, 7D, 3D) v")
    assert [r.v for r in raster.resample(one, Grid(0.0, 8.0, 0.0, -8.0, 1, 1), Grid(0.0, 2.0, 0.0, -2.0, 4, 4), "mode").collect()] == [7.0] * 16
