"""The kernel and refinement: invariants of meshes."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terratess.model import Grid
from terratess.operators import acceptance, refine, topology
from terratess.operators.kernel import orient, sine2_of
from terratess.operators.refine import Mesh
from terratess.sources import synthetic

FLAT = [(488479.5, 6713528.0), (490527.5, 6713528.0), (490527.5, 6711480.0), (488479.5, 6711480.0)]


def ring_area(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def check(mesh, area):
    vertex, elem, near = mesh.t.tables()
    sizes = [orient(*vertex[r]) / 2 for r in elem]
    assert min(sizes) > 0
    assert math.isclose(sum(sizes), area, rel_tol=1e-9)
    for k, row in enumerate(near):
        for i, n in enumerate(row):
            if n >= 0:
                assert k in near[n]
                assert {elem[k][(i + 1) % 3], elem[k][(i + 2) % 3]} <= set(elem[n])
    return vertex, elem, sizes


def test_flat_domain_is_two_triangles():
    mesh = Mesh(FLAT)
    mesh.improve(2048.0 * 2048, 0.125, 1.0, 1000)
    _, elem, sizes = check(mesh, 2048.0 * 2048)
    assert len(elem) == 2
    assert sizes == [2097152.0, 2097152.0]


def test_improve_bounds_area_and_angle():
    ring = [(0.0, 0.0), (100.0, 10.0), (60.0, 50.0), (110.0, 90.0), (10.0, 100.0), (30.0, 50.0)]
    mesh = Mesh(ring)
    mesh.improve(30.0, 0.125, 0.01, 20_000)
    vertex, elem, sizes = check(mesh, ring_area(ring))
    assert max(sizes) <= 30
    assert min(sine2_of(*vertex[r]) for r in elem) >= 0.125


def test_constraints_are_edges_and_crossings_are_skipped():
    mesh = Mesh([(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)], [[(10.0, 50.0), (90.0, 45.0)], [(50.0, 10.0), (50.0, 90.0)]])
    assert mesh.skipped == 1
    check(mesh, 10_000.0)
    mesh.improve(40.0, 0.125, 0.01, 20_000)
    check(mesh, 10_000.0)
    # the line's pieces cover it whole
    on = sorted(mesh.t.xy(v)[0] for e in mesh.t.fixed for v in e if abs(mesh.t.xy(v)[1] - (50 - (mesh.t.xy(v)[0] - 10) / 16)) < 1e-6)
    assert math.isclose(on[0], 10) and math.isclose(on[-1], 90)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 63), st.integers(1, 63)), min_size=1, max_size=40))
def test_insertions_keep_a_triangulation(points):
    mesh = Mesh([(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)])
    for x, y in points:
        mesh.t.insert(float(x), float(y))
    check(mesh, 4096.0)


def test_lloyd_keeps_domain_and_improves_angles():
    random.seed(3)
    mesh = Mesh([(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)])
    mesh.improve(20.0, 0.125, 0.01, 5000)
    vertex, elem, _ = mesh.t.tables()
    before = np.mean([sine2_of(*vertex[r]) for r in elem])
    mesh.smooth(5)
    vertex, elem, _ = check(mesh, 2500.0)
    assert np.mean([sine2_of(*vertex[r]) for r in elem]) >= before - 0.02


def test_voronoi_centroids(spark):
    """Inside the domain: the mean place of the points that a vertex is nearest to."""
    random.seed(5)
    mesh = Mesh([(0.0, 0.0), (40.0, 0.0), (40.0, 40.0), (0.0, 40.0)])
    mesh.improve(25.0, 0.125, 0.01, 5000)
    vertex, elem, _ = mesh.t.tables()
    found = refine.cell_centroids(vertex, elem)
    side = np.linspace(0.025, 39.975, 800)
    grid = np.stack(np.meshgrid(side, side), axis=-1).reshape(-1, 2)
    nearest = np.concatenate([((g[:, None, :] - vertex[None]) ** 2).sum(axis=2).argmin(axis=1) for g in np.array_split(grid, 200)])
    checked = 0
    for v, (x, y) in enumerate(vertex.tolist()):
        if 8 < x < 32 and 8 < y < 32:
            assert np.abs(found[v] - grid[nearest == v].mean(axis=0)).max() < 0.03
            checked += 1
    assert checked > 5


@pytest.mark.parametrize("many", [2, 3])
def test_graph_partition_cuts_less_and_keeps_sizes(spark, many):
    """Scattered parts: exchanges bring neighbours together, sizes stay."""
    n = 12
    elem = [(2 * (r * n + c) + k, *([r * (n + 1) + c, r * (n + 1) + c + 1, (r + 1) * (n + 1) + c] if k == 0 else [r * (n + 1) + c + 1, (r + 1) * (n + 1) + c + 1, (r + 1) * (n + 1) + c])) for r in range(n) for c in range(n) for k in range(2)]
    neigh = topology.neighbours(spark.createDataFrame(elem, "tri int, v0 int, v1 int, v2 int"))
    r = random.Random(1)
    parts = spark.createDataFrame([(t, r.randrange(many)) for t, *_ in elem], "tri int, part int")
    pairs = topology.edges(neigh)
    found = topology.partition_by_graph(parts, neigh)
    assert topology.edge_cut(pairs, found) < 0.6 * topology.edge_cut(pairs, parts)
    count = lambda x: sorted(map(tuple, topology.partition_sizes(x).collect()))
    assert count(found) == count(parts) and found.select("tri").distinct().count() == len(elem)


@pytest.fixture(scope="module")
def hill(spark):
    grid = Grid(0.0, 10.0, 320.0, -10.0, 32, 32, "local")
    cells = synthetic.gauss(spark, 32, 32, 100.0).withColumnRenamed("v", "z")
    return grid, cells


def test_refined_mesh_satisfies_the_criteria(spark, hill):
    grid, cells = hill
    criteria = acceptance.Criteria(max_area=40_000.0, min_area=200.0, layers={"z": acceptance.Layer("rmse", 15.0)})
    outline = [(0.0, 0.0), (320.0, 0.0), (320.0, 320.0), (0.0, 320.0)]
    mesh = refine.refine(spark, outline, cells, grid, criteria)
    check(mesh, 320.0 * 320.0)
    vertex, elem, _ = refine.frames(spark, mesh)
    left = acceptance.badness(elem, vertex, cells, grid, criteria).where("badness <> 'NOT_BAD'")
    assert left.count() == 0
    assert 4 < elem.count() < 400


def test_uniform_refines_to_least_area(spark, hill):
    grid, cells = hill
    mesh = refine.refine(spark, [(0.0, 0.0), (320.0, 0.0), (320.0, 320.0), (0.0, 320.0)], cells, grid, acceptance.Criteria(1e6, 5000.0, uniform=True))
    _, _, sizes = check(mesh, 320.0 * 320.0)
    assert max(sizes) <= 5000


def test_heights_are_repaired_in_rounds(spark):
    vertex = spark.createDataFrame([(0, 0.0, 0.0, 1.0), (1, 1.0, 0.0, 3.0), (2, 0.0, 1.0, None), (3, 1.0, 1.0, None)], "vid int, x double, y double, z double")
    elem = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "tri int, v0 int, v1 int, v2 int")
    found = {r.vid: r.z for r in refine.repair_heights(vertex, elem).collect()}
    assert found == {0: 1.0, 1: 3.0, 2: 2.0, 3: 3.0}
    with pytest.raises(ValueError):
        refine.repair_heights(vertex.withColumn("z", vertex.z * None), elem)


def test_full_mesh_is_an_error(spark, hill):
    grid, cells = hill
    outline = [(0.0, 0.0), (320.0, 0.0), (320.0, 320.0), (0.0, 320.0)]
    by_error = acceptance.Criteria(max_area=40_000.0, min_area=200.0, layers={"z": acceptance.Layer("rmse", 15.0)})
    for criteria in (by_error, acceptance.Criteria(500.0, 100.0), acceptance.Criteria(1e6, 500.0, uniform=True)):
        with pytest.raises(refine.MeshFull):
            refine.refine(spark, outline, cells, grid, criteria, most_vertices=20)


def test_sharp_corner_is_counted(spark, hill):
    grid, cells = hill
    with pytest.warns(UserWarning, match="cannot be split"):
        mesh = refine.refine(spark, [(0.0, 0.0), (320.0, 0.0), (320.0, 20.0)], cells, grid, acceptance.Criteria(1e6, 2000.0))
    assert mesh.left > 0


def test_deep_holes_are_filled(spark):
    """A strip of triangles with a height at one end only, more than 100 vertices deep."""
    n = 206  # two a round
    vertex = spark.createDataFrame([(k, float(k), float(k % 2), 5.0 if k < 2 else None) for k in range(n)], "vid int, x double, y double, z double").coalesce(1)
    elem = spark.createDataFrame([(k, k, k + 1, k + 2) for k in range(n - 2)], "tri int, v0 int, v1 int, v2 int").coalesce(1)
    assert {r.z for r in refine.repair_heights(vertex, elem).collect()} == {5.0}
