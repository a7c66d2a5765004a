"""Moved rings against distances of points."""

import math
import random

import numpy as np
import pytest

from terratess.operators import vector
from terratess.operators.offset import offset_rings


def inside(p, ring):
    n = 0
    for a, b in zip(ring, np.roll(ring, -1, axis=0)):
        if (a[1] > p[1]) != (b[1] > p[1]) and a[0] + (p[1] - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) > p[0]:
            n += 1
    return n % 2 == 1


def gap(p, ring):
    a, b = np.array(ring), np.roll(ring, -1, axis=0)
    t = np.clip(((p - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1), 0, 1)
    return float(np.sqrt(((a + t[:, None] * (b - a) - p) ** 2).sum(axis=1).min()))


def star(seed, n=40):
    r = random.Random(seed)
    return np.array([(math.cos(2 * math.pi * k / n) * (h := r.uniform(2, 20)), math.sin(2 * math.pi * k / n) * h) for k in range(n)])


def square(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def test_shrunk_square():
    ring = np.array([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], dtype=float)
    for way in (ring, ring[::-1]):
        (found,) = offset_rings(way, -1.0)
        assert np.allclose(sorted(map(tuple, found[:-1])), [(1, 1), (1, 9), (9, 1), (9, 9)])
    assert offset_rings(ring, -6.0) == [] and offset_rings(ring[:2], -1.0) == []
    (grown,) = offset_rings(ring, 1.0, quarter=64)
    assert square(grown) == pytest.approx(140 + math.pi, rel=1e-4)


def test_a_neck_splits_a_ring(spark):
    bell = [(0, 0), (10, 0), (10, 4.4), (20, 4.4), (20, 0), (28, 0), (28, 10), (20, 10), (20, 5.6), (10, 5.6), (10, 10), (0, 10)]
    found = offset_rings(np.array(bell, dtype=float), -1.0)
    # the corners of the neck are points, so a little of its mouth is left
    assert [round(square(r), 2) for r in found] == [64.08, 48.08]
    points = spark.createDataFrame([(7, part, k, float(x), float(y)) for part in (0, 1) for k, (x, y) in enumerate(bell)] + [(8, 0, 0, 0.0, 0.0), (8, 0, 1, 1.0, 0.0), (8, 0, 2, 1.0, 1.0)], "fid long, part int, seq int, x double, y double")
    rows = vector.ring_areas(vector.buffer(points, -1.0)).orderBy("part").collect()
    assert [(r.fid, r.part, round(r.area, 2)) for r in rows] == [(7, 0, 64.08), (7, 1, 48.08), (7, 2, 64.08), (7, 3, 48.08)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("distance", [-3.0, -1.0, 0.7, 2.5])
def test_points_lie_where_their_distance_says(seed, distance):
    ring = star(seed)
    found = [r[:-1] for r in offset_rings(ring, distance, quarter=64)]
    r = random.Random(seed)
    for _ in range(400):
        p = np.array([r.uniform(-24, 24), r.uniform(-24, 24)])
        depth = gap(p, ring) * (1 if inside(p, ring) else -1)
        if abs(depth + distance) > 1e-2:
            assert (sum(inside(p, f) for f in found) % 2 == 1) == (depth > -distance)
