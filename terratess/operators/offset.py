"""Rings moved by a distance: the outline of all points that lie so far inside (or within it outside).

The moved edges, arcs at corners that open, and ways back through corners that close
make one closed curve. Cut at all its crossings, the borders between places that
it winds around and others are the result, so a ring that is shrunk over a neck
falls into several. Work is quadratic in a ring's vertices, in numpy.
"""

from __future__ import annotations

import math

import numpy as np

#: Segments of a quarter of an arc.
QUARTER = 8
_ROWS = 512


def _curve(p: np.ndarray, distance: float, quarter: int) -> np.ndarray:
    """The moved outline of a counter-clockwise ring, with loops where it meets itself."""
    q = np.roll(p, -1, axis=0)
    step = q - p
    length = np.hypot(step[:, 0], step[:, 1])
    normal = np.column_stack([step[:, 1], -step[:, 0]]) / length[:, None]  # outwards
    out = []
    for k in range(len(p)):
        before, after, at = normal[k - 1], normal[k], p[k]
        turn = step[k - 1, 0] * step[k, 1] - step[k - 1, 1] * step[k, 0]
        out.append(at + distance * before)
        if turn * distance > 0:  # the corner opens: an arc around it
            a = math.atan2(before[1], before[0])
            wide = math.remainder(math.atan2(after[1], after[0]) - a, 2 * math.pi)
            n = max(1, math.ceil(abs(wide) / (math.pi / 2) * quarter))
            out += [at + distance * np.array([math.cos(a + wide * s / n), math.sin(a + wide * s / n)]) for s in range(1, n)]
        elif turn * distance < 0:
            out.append(at)
        out.append(at + distance * after)
    return np.array(out)


def _cuts(a: np.ndarray, b: np.ndarray, near: float) -> list[list[float]]:
    """For each segment the shares of its length at which others meet it."""
    d = b - a
    square = (d * d).sum(axis=1)
    cuts: list[list[float]] = [[0.0, 1.0] for _ in range(len(a))]
    for at in range(0, len(a), _ROWS):
        s = slice(at, at + _ROWS)
        cross = d[s, None, 0] * d[None, :, 1] - d[s, None, 1] * d[None, :, 0]
        f = a[None, :, :] - a[s, None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (f[..., 0] * d[None, :, 1] - f[..., 1] * d[None, :, 0]) / cross
            u = (f[..., 0] * d[s, None, 1] - f[..., 1] * d[s, None, 0]) / cross
            slack = near / np.sqrt(square)
            hit = (t > 0) & (t < 1) & (u >= -slack[None, :]) & (u <= 1 + slack[None, :])
            # ends of others that lie on the segment, parallel ones too
            along = (f * d[s, None, :]).sum(axis=2) / square[s, None]
            off = np.abs(f[..., 0] * d[s, None, 1] - f[..., 1] * d[s, None, 0]) / np.sqrt(square[s, None])
        touch = (off <= near) & (along > 0) & (along < 1)
        for where, share in ((hit, t), (touch, along)):
            for i, j in zip(*np.nonzero(where)):
                cuts[at + i].append(float(share[i, j]))
    return cuts


class _Nodes:
    """Points that are one if they are nearer than a bound."""

    def __init__(self, near: float):
        self.near, self.grid, self.points = near, {}, []

    def of(self, x: float, y: float) -> int:
        i, j = math.floor(x / self.near), math.floor(y / self.near)
        for di in (0, -1, 1):
            for dj in (0, -1, 1):
                if (k := self.grid.get((i + di, j + dj))) is not None:
                    return k
        self.grid[i, j] = len(self.points)
        self.points.append((x, y))
        return len(self.points) - 1


def _winding(mid: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How often weighted segments wind around points, each point's own segment left out; the ray goes to larger x."""
    out = np.zeros(len(mid))
    for at in range(0, len(mid), _ROWS):
        s = slice(at, at + _ROWS)
        y = mid[s, None, 1]
        up, down = (a[None, :, 1] <= y) & (b[None, :, 1] > y), (a[None, :, 1] > y) & (b[None, :, 1] <= y)
        with np.errstate(divide="ignore", invalid="ignore"):
            x = a[None, :, 0] + (y - a[None, :, 1]) / (b - a)[None, :, 1] * (b - a)[None, :, 0]
        right = x > mid[s, None, 0]
        count = (up & right).astype(np.int64) - (down & right)
        rows = np.arange(count.shape[0])
        count[rows, own[s]] = 0
        out[s] = (count * weight[None, :]).sum(axis=1)
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def offset_rings(xy: np.ndarray, distance: float, quarter: int = QUARTER) -> list[np.ndarray]:
    """A simple ring moved outwards by ``distance`` (inwards if negative), as closed rings: outer ones counter-clockwise, holes clockwise, the largest first. None if nothing is left."""
    p = np.asarray(xy, dtype=float)
    p = p[:-1] if len(p) > 1 and (p[0] == p[-1]).all() else p
    p = p[(p != np.roll(p, 1, axis=0)).any(axis=1)]
    if len(p) < 3:
        return []
    q = np.roll(p, -1, axis=0)
    twice = float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())
    if twice == 0:
        return []
    origin, p = p.mean(axis=0), (p if twice > 0 else p[::-1]) - p.mean(axis=0)
    near = 1e-10 * float(np.abs(p).max() + abs(distance))
    curve = _curve(p, distance, quarter) if distance else p
    a, b = curve, np.roll(curve, -1, axis=0)
    some = np.hypot(*(b - a).T) > near
    a, b = a[some], b[some]

    nodes = _Nodes(4 * near)
    net: dict[tuple[int, int], int] = {}
    for k, shares in enumerate(_cuts(a, b, near)):
        stops = [nodes.of(*(a[k] + t * (b[k] - a[k])).tolist()) for t in sorted(shares)]
        for i, j in zip(stops, stops[1:]):
            if i != j:
                key, sign = ((i, j), 1) if i < j else ((j, i), -1)
                net[key] = net.get(key, 0) + sign
    edges = [(k, n) for k, n in net.items() if n]
    if not edges:
        return []
    points = np.array(nodes.points)
    ends = np.array([k for k, _ in edges])
    weight = np.array([n for _, n in edges])
    a, b = points[ends[:, 0]], points[ends[:, 1]]
    mid, d = (a + b) / 2, b - a
    # rays run across the edge that they start on: steep ones go to larger x, flat ones to larger y
    steep = np.abs(d[:, 1]) >= np.abs(d[:, 0])
    left = np.zeros(len(edges))
    index = np.arange(len(edges))
    if steep.any():
        left[steep] = _winding(mid[steep], a, b, weight, index[steep]) + np.where(d[steep, 1] > 0, weight[steep], 0)
    if (~steep).any():
        turned = lambda v: np.column_stack([v[:, 1], -v[:, 0]])
        left[~steep] = _winding(turned(mid[~steep]), turned(a), turned(b), weight, index[~steep]) + np.where(-d[~steep, 0] > 0, weight[~steep], 0)
    inner, outer = left > 0, left - weight > 0
    after: dict[int, list[int]] = {}
    for k in np.flatnonzero(inner != outer).tolist():
        i, j = ends[k] if inner[k] else ends[k][::-1]
        after.setdefault(int(i), []).append(int(j))

    rings = []
    for start in sorted(after):
        while after[start]:
            ring = [start]
            to = after[start].pop()
            while to != start:
                came = points[to] - points[ring[-1]]
                ring.append(to)
                ways = after[to]
                if len(ways) > 1:  # the sharpest way to the left, so that rings that touch stay apart
                    ways.sort(key=lambda w: math.atan2(came[0] * (points[w] - points[to])[1] - came[1] * (points[w] - points[to])[0], float(came @ (points[w] - points[to]))))
                to = ways.pop()
            ring.append(start)
            rings.append([tuple(points[k]) for k in ring])
    kept = [r for r in rings if len(r) > 3 and abs(_area(r)) > near * float(np.abs(p).max())]
    return [np.array(r) + origin for r in sorted(kept, key=lambda r: -abs(_area(r)))]
