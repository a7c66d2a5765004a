"""Depressions and flow over tiles against walks over the whole raster."""

import math
import random

import pytest

from terratess.model import Grid
from terratess.operators import flow

GRID = Grid(0.0, 10.0, 200.0, -15.0, 21, 17, "local")


def surface(seed, holes=True):
    r = random.Random(seed)
    z = {(x, y): 50 + 8 * math.sin(x / 3) * math.cos(y / 2.5) + r.random() for x in range(21) for y in range(17)}
    return {p: v for p, v in z.items() if not holes or r.random() > 0.03}


def around(p):
    return [(p[0] + j, p[1] + i) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def brute_fill(z, epsilon):
    w = {p: v if any(q not in z for q in around(p)) else math.inf for p, v in z.items()}
    changed = True
    while changed:
        changed = False
        for p in z:
            level = max(z[p], min(w[q] for q in around(p) if q in w) + epsilon) if all(q in z for q in around(p)) else z[p]
            if level < w[p]:
                w[p], changed = level, True
    return w


def brute_flow(z, dx, dy):
    to = {}
    for (x, y), e0 in z.items():
        best = (0.0, None)
        for (i1, j1), (i2, j2) in flow.FACETS:
            a, b = (x + j1, y + i1), (x + j2, y + i2)
            if a not in z or b not in z:
                continue
            d1, d2 = (dx, dy) if i1 == 0 else (dy, dx)
            s1, s2 = (e0 - z[a]) / d1, (z[a] - z[b]) / d2
            r, s, wide = math.atan2(s2, s1), math.hypot(s1, s2), math.atan2(d2, d1)
            if r < 0:
                r, s = 0.0, s1
            elif r > wide:
                r, s = wide, (e0 - z[b]) / math.hypot(d1, d2)
            if s > best[0]:
                best = (s, [(a, 1 - r / wide), (b, r / wide)])
        to[x, y] = best[1] or []
    total = {p: 1.0 for p in z}
    for p in sorted(z, key=lambda p: -z[p]):
        for q, share in to[p]:
            total[q] += total[p] * share
    return total


@pytest.mark.parametrize(("seed", "tile"), [(1, 64), (2, 5), (3, 8)])
def test_flow_equals_brute_force(spark, seed, tile):
    z = surface(seed)
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "px int, py int, v double")
    filled = flow.fill_depressions(cells, 0.01, tile)
    got = {(r.px, r.py): r.v for r in filled.collect()}
    expected = brute_fill(z, 0.01)
    assert got.keys() == z.keys() and all(got[p] == pytest.approx(expected[p], abs=1e-9) for p in z)
    found = {(r.px, r.py): r.v for r in flow.flow_accumulation(filled, GRID, tile).collect()}
    want = brute_flow(got, 10.0, 15.0)
    assert found.keys() == z.keys() and all(found[p] == pytest.approx(want[p], rel=1e-9) for p in z)


def test_a_bowl_drains_over_its_rim(spark):
    """One pit in the middle: all its water leaves where the rim is lowest."""
    z = {(x, y): float((x - 10) ** 2 + (y - 8) ** 2) for x in range(21) for y in range(17)}
    z[20, 8] = 1.0
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in z.items()], "px int, py int, v double")
    filled = flow.fill_depressions(cells, 1e-3, 6)
    level = {(r.px, r.py): r.v for r in filled.collect()}
    assert all(level[p] >= v for p, v in z.items()) and 1.0 < level[10, 8] < 82.0
    assert flow.fill_depressions(cells.limit(0)).count() == 0 and flow.flow_accumulation(cells.limit(0), GRID).count() == 0
