"""Mesh making: refinement until every triangle is accepted, smoothing, vertex heights."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.model import MESH_ELEM, MESH_NEIGH, MESH_VERTEX, Grid
from terratess.operators import acceptance
from terratess.operators.kernel import Triangulation, circumcentre, encroached, orient, sine2_of
from terratess.operators.raster import extract_points
from terratess.staging import release, stage

Points = Sequence[tuple[float, float]]
#: Vertices that the driver's memory holds by default.
MOST_VERTICES = 200_000


#: Metres of the widest degree.
DEGREE = 111_320.0


def equal_area(lon: float, lat: float) -> tuple[float, float]:
    """Mollweide metres of degrees, as ``geometry.mollweide`` gives them."""
    phi = math.radians(lat)
    t = phi
    for _ in range(12):
        slope = 2 + 2 * math.cos(2 * t)
        if slope < 1e-12:
            break
        t -= (2 * t + math.sin(2 * t) - math.pi * math.sin(phi)) / slope
    return 2 * math.sqrt(2) / math.pi * 6378137.0 * math.radians(lon) * math.cos(t), math.sqrt(2) * 6378137.0 * math.sin(t)


class MeshFull(ValueError):
    """The bound on vertices was reached with triangles left that fail the criteria."""


class Mesh:
    """The growing triangulation of one domain with its outline and inner constraints."""

    def __init__(self, boundary: Points, constraints: Sequence[Points] = (), geographic: bool = False):
        """``geographic`` coordinates are degrees; sizes of triangles are square metres all the same."""
        xs, ys = zip(*boundary)
        self.geographic = geographic
        self.boundary, self.constraints = list(boundary), [list(c) for c in constraints]
        self.t = Triangulation(min(xs), min(ys), max(xs), max(ys))
        self.skipped = 0  # constraint segments that cross others or leave the domain
        self.left = 0  # triangles that fail the criteria and cannot be split
        self._build([])

    def _build(self, inner: Points) -> None:
        t = self.t
        ring = [t.insert(x, y) for x, y in self.boundary]
        lines = [[t.insert(x, y) for x, y in c if self._in_box(x, y)] for c in self.constraints]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            if not t.constrain(a, b):
                raise ValueError("the outline crosses itself")
        # the outline as it stands, vertices on it included
        outline = set(t.fixed)
        t.mark_inside(outline)
        for line in lines:
            for a, b in zip(line, line[1:]):
                if not t.constrain(a, b):
                    self.skipped += 1
        t.mark_inside(outline)
        for x, y in inner:
            t.insert(x, y)

    def _in_box(self, x: float, y: float) -> bool:
        p = self.t._own(x, y)
        return -1 <= p[0] <= 2 and -1 <= p[1] <= 2

    def corners(self, tri: Sequence[int]) -> list[tuple[float, float]]:
        return [self.t.xy(v) for v in tri]

    def area(self, p: Sequence[tuple[float, float]]) -> float:
        return abs(orient(*[equal_area(x, y) for x, y in p] if self.geographic else p)) / 2

    def split(self, tri: Sequence[int], shortest: float) -> bool:
        """Improves one triangle: its circumcentre, or the middle of the fixed edges that this would crowd. False if nothing could be done."""
        t = self.t
        p = [t.points[v] for v in tri]
        if min((p[i][0] - p[i - 1][0]) ** 2 + (p[i][1] - p[i - 1][1]) ** 2 for i in range(3)) <= (shortest / t.scale) ** 2:
            return False
        c = circumcentre(*p)
        if c is None:
            return False
        if self._segments is None:
            self._segments = np.array(sorted(t.fixed), dtype=np.int64)
        crowded = encroached(t, c, self._segments) if len(self._segments) else []
        if len(crowded):
            done = False
            for a, b in self._segments[crowded].tolist():
                (ax, ay), (bx, by) = t.points[a], t.points[b]
                if (min(a, b), max(a, b)) in t.fixed and (ax - bx) ** 2 + (ay - by) ** 2 > (2 * shortest / t.scale) ** 2:
                    t._insert(((ax + bx) / 2, (ay + by) / 2))
                    done = True
            self._segments = None
            return done
        if not (-10 < c[0] < 11 and -10 < c[1] < 11) or not t.inside.get(t.locate(c), False):
            return False
        t._insert(c)
        return True

    _segments: np.ndarray | None = None

    def improve(self, max_area: float, least_sine2: float, shortest: float, most: int) -> None:
        """Geometry alone: splits what is too large or too sharp until nothing is, or nothing can be."""
        stuck: set[tuple[int, ...]] = set()
        while len(self.t.points) < most:
            todo = []
            for k in self.t.domain():
                tri = self.t.triangles[k]
                key = tuple(sorted(tri))
                if key in stuck:
                    continue
                p = self.corners(tri)
                if (a := self.area(p)) > max_area or sine2_of(*p) < least_sine2:
                    todo.append((-a, key))
            if not todo:
                return
            for _, key in sorted(todo):
                if len(self.t.points) >= most:
                    return
                if self._stands(key) and not self.split(key, shortest):
                    stuck.add(key)

    def failing(self, max_area: float, least_sine2: float) -> int:
        """Triangles that are too large or too sharp."""
        all_ = (self.corners(self.t.triangles[k]) for k in self.t.domain())
        return sum(self.area(p) > max_area or sine2_of(*p) < least_sine2 for p in all_)

    def _stands(self, key: tuple[int, ...]) -> bool:
        """Whether a triangle of these vertices still exists; split() looks no further."""
        p = [self.t.points[v] for v in key]
        k = self.t.locate((sum(q[0] for q in p) / 3, sum(q[1] for q in p) / 3))
        return tuple(sorted(self.t.triangles[k])) == key

    def smooth(self, iterations: int) -> None:
        """Lloyd steps: free vertices move to the centroids of their Voronoi cells; the mesh is triangulated anew each time. Error bounds no longer hold after it."""
        for _ in range(iterations):
            vertex, elem, _ = self.t.tables()
            held = {self.t.points[v] for e in self.t.fixed for v in e}
            moved = cell_centroids(vertex, elem)
            old = self.t
            fixed = [old._own(x, y) in held for x, y in vertex.tolist()]
            inner = [tuple(q) for q, f in zip(moved.tolist(), fixed) if not f]
            kept = sorted({v for e in old.fixed for v in e})
            outline, edges = [old.points[v] for v in kept], sorted(old.fixed)
            self.t = Triangulation(0, 0, 1, 1)
            self.t.origin, self.t.scale = old.origin, old.scale
            number = {v: self.t._insert(q) for v, q in zip(kept, outline)}
            for a, b in edges:
                self.t.constrain(number[a], number[b])
            ring = self._outline_edges(old, number)
            self.t.mark_inside(ring)
            for x, y in inner:
                self.t.insert(x, y)
            self._segments = None

    @staticmethod
    def _outline_edges(old: Triangulation, number: dict[int, int]) -> set[tuple[int, int]]:
        out = set()
        for k in old.domain():
            for i in range(3):
                n = old.near[k][i]
                if n < 0 or not old.inside.get(n, False):
                    a, b = (number[v] for v in (old.triangles[k][(i + 1) % 3], old.triangles[k][(i + 2) % 3]))
                    out.add((min(a, b), max(a, b)))
        return out


def cell_centroids(vertex: np.ndarray, elem: np.ndarray) -> np.ndarray:
    """Of each vertex the centroid of its Voronoi cell, whose corners are the circumcentres of its triangles in turn.

    Where a triangle's circumcentre lies beyond an edge that no other triangle has, the
    cell reaches out of the domain: there it is the area-weighted mean of the triangles' centres.
    """
    p = vertex[elem]
    a, b, c = p[:, 0], p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    twice = b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0]
    bb, cc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    centre = a + np.column_stack([c[:, 1] * bb - b[:, 1] * cc, b[:, 0] * cc - c[:, 0] * bb]) / (2 * twice)[:, None]

    total, mean = np.zeros(len(vertex)), np.zeros_like(vertex)
    for k in range(3):
        np.add.at(total, elem[:, k], np.abs(twice))
        np.add.at(mean, elem[:, k], np.abs(twice)[:, None] * p.mean(axis=1))
    mean /= np.maximum(total, 1e-300)[:, None]

    ends = np.sort(np.concatenate([elem[:, [1, 2]], elem[:, [2, 0]], elem[:, [0, 1]]]), axis=1)
    _, which, times = np.unique(ends, axis=0, return_inverse=True, return_counts=True)
    rim = (times[which.ravel()] == 1).reshape(3, -1)
    open_ = np.zeros(len(vertex), dtype=bool)
    for k in range(3):
        u, v = p[:, (k + 1) % 3], p[:, (k + 2) % 3]
        side = lambda x, u=u, v=v: (v[:, 0] - u[:, 0]) * (x[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (x[:, 0] - u[:, 0])
        beyond = rim[k] & (side(centre) * side(p[:, k]) < 0)
        open_[elem[beyond].ravel()] = True
        open_[elem[rim[k]][:, [(k + 1) % 3, (k + 2) % 3]].ravel()] = True

    owner = elem.ravel()
    corner = np.repeat(centre, 3, axis=0) - vertex[owner]
    towards = np.repeat(p.mean(axis=1), 3, axis=0) - vertex[owner]
    order = np.lexsort((np.arctan2(towards[:, 1], towards[:, 0]), owner))
    owner, corner = owner[order], corner[order]
    last = np.append(owner[1:] != owner[:-1], True)
    first = np.flatnonzero(np.append(True, last[:-1]))
    after = np.arange(1, len(owner) + 1)
    after[last] = first
    cross = corner[:, 0] * corner[after, 1] - corner[:, 1] * corner[after, 0]
    size, moment = np.zeros(len(vertex)), np.zeros_like(vertex)
    np.add.at(size, owner, cross)
    np.add.at(moment, owner, cross[:, None] * (corner + corner[after]))
    good = ~open_ & (size > 1e-12 * np.maximum(total, 1e-300))
    out = mean
    out[good] = vertex[good] + moment[good] / (3 * size[good])[:, None]
    return out


def frames(spark: SparkSession, mesh: Mesh) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vertex (height 0), element and neighbour tables."""
    vertex, elem, near = mesh.t.tables()
    v = spark.createDataFrame([(k, float(x), float(y), 0.0) for k, (x, y) in enumerate(vertex)], MESH_VERTEX)
    e = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(elem)], MESH_ELEM)
    n = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(near)], MESH_NEIGH)
    return v, e, n


def refine(spark: SparkSession, boundary: Points, cells: DataFrame, grid: Grid, criteria: acceptance.Criteria, constraints: Sequence[Points] = (), lloyd: int = 0, most_vertices: int = MOST_VERTICES) -> Mesh:
    """A mesh of the domain in which every triangle is accepted by ``criteria``.

    Each round the kernel first settles areas and angles, then one distributed
    query judges the triangles that no earlier round accepted, and the bad ones
    are split, largest first. It ends when none is bad; ``MeshFull`` is raised when
    the bound on vertices is reached before. Triangles of no more than ``min_area``
    are accepted, which bounds refinement; edges are not cut below a thousandth of
    its side, so sharp corners of the outline can stay: a warning gives the number of
    such triangles, which ``Mesh.left`` holds.
    """
    mesh = Mesh(boundary, constraints, grid.geographic)
    shortest = max(criteria.min_area, 1e-12) ** 0.5 / 1000 / (DEGREE if grid.geographic else 1)
    judged: set[tuple[int, ...]] = set()
    while True:
        mesh.improve(criteria.max_area, acceptance.LEAST_SINE2, shortest, most_vertices)
        before = len(mesh.t.points)
        if not criteria.tested and not criteria.uniform:
            mesh.left = mesh.failing(criteria.max_area, acceptance.LEAST_SINE2)
            if mesh.left and before >= most_vertices:
                raise MeshFull(f"{mesh.left} triangles fail the criteria at the bound of {most_vertices} vertices")
            break
        fresh = [tri for k in mesh.t.domain() if tuple(sorted(tri := mesh.t.triangles[k])) not in judged]
        if not fresh:
            break
        used = sorted({v for tri in fresh for v in tri})
        vertex = spark.createDataFrame([(v, *mesh.t.xy(v), 0.0) for v in used], MESH_VERTEX)
        elem = spark.createDataFrame([(k, *tri) for k, tri in enumerate(fresh)], MESH_ELEM)
        found = acceptance.badness(elem, vertex, cells, grid, criteria).where(F.col("badness") != acceptance.NOT_BAD)
        # one row per triangle of the mesh in the making, which the kernel holds anyway
        bad = {r["tri"]: r["area"] for r in found.select("tri", "area").collect()}
        judged |= {tuple(sorted(tri)) for k, tri in enumerate(fresh) if k not in bad}
        if bad and before >= most_vertices:
            raise MeshFull(f"{len(bad)} triangles fail the criteria at the bound of {most_vertices} vertices")
        for k in sorted(bad, key=lambda k: (-bad[k], k)):
            if len(mesh.t.points) >= most_vertices:
                break
            key = tuple(sorted(fresh[k]))
            if mesh._stands(key):
                mesh.split(key, shortest)
        if len(mesh.t.points) == before:
            mesh.left = len(bad)
            break
    if mesh.left:
        warnings.warn(f"{mesh.left} triangles fail the criteria and cannot be split", stacklevel=2)
    if lloyd:
        mesh.smooth(lloyd)
    return mesh


def vertex_heights(vertex: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """Heights at the vertices, from the cell or its neighbours; null where there is none."""
    return extract_points(vertex.select("vid", "x", "y"), cells, grid, "z")


def repair_heights(vertex: DataFrame, elem: DataFrame) -> DataFrame:
    """Fills missing heights with the mean of the other valid vertices of a triangle: in each round that of the smallest id, until none is left.

    A vertex whose whole component has no height is an error.
    """
    corner = F.array(*[F.struct(F.col(f"v{k}").alias("vid"), F.array(f"v{(k + 1) % 3}", f"v{(k + 2) % 3}").alias("others")) for k in range(3)])
    links = elem.select("tri", F.inline(corner)).select("tri", "vid", F.explode("others").alias("other"))
    held = None
    left = vertex.where("z is null").count()
    while left:
        lost = vertex.where("z is null").select("vid")
        means = links.join(lost, "vid", "left_semi").join(vertex.where("z is not null").select(F.col("vid").alias("other"), "z"), "other").groupBy("vid", "tri").agg(F.avg("z").alias("mean"))
        first = means.groupBy("vid").agg(F.min(F.struct("tri", "mean"))["mean"].alias("_mean"))
        vertex = stage(vertex.join(first, "vid", "left").withColumn("z", F.coalesce("z", "_mean")).drop("_mean"), "heights")
        release(held)
        held = vertex
        before, left = left, vertex.where("z is null").count()
        if left == before:
            raise ValueError(f"{left} vertices have no height and no neighbour with one")
    return vertex
