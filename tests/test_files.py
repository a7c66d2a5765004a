"""Round trips through files, configuration rules, the whole pipeline."""

import json
import numpy as np
import pytest
from pyspark.sql import functions as F

from terratess.functions import geometry, projections
from terratess.functions.projections import Albers, Utm
from terratess.model import Grid
from terratess.operators import raster, refine, spatial, topology, vector
from terratess.plans import config, pipeline
from terratess.sources import geojson, geotiff, mesh_json, report, shapefile, synthetic, triangle_files

VERTEX = [(0, 488479.5, 6713528.0, 1000.0), (1, 490527.5, 6713528.0, 1000.0), (2, 490527.5, 6711480.0, 1000.0), (3, 488479.5, 6711480.0, 1000.0)]
ELEM = [(0, 1, 0, 2), (1, 0, 3, 2)]


@pytest.fixture(scope="module")
def mesh(spark):
    vertex = spark.createDataFrame(VERTEX, "vid int, x double, y double, z double")
    elem = spark.createDataFrame(ELEM, "tri int, v0 int, v1 int, v2 int")
    return vertex, elem, topology.neighbours(elem)


def values(df, *keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def test_flat_golden_neighbours(mesh):
    assert values(mesh[2].select("tri", "n0", "n1", "n2"), "tri") == [(0, 1, -1, -1), (1, -1, 0, -1)]


def test_mesh_and_param_json(spark, mesh, tmp_path):
    vertex, elem, neigh = mesh
    mesh_json.write_mesh(str(tmp_path / "a.mesh"), vertex, elem, neigh, {"is_geographic": 0, "proj4": "+proj=utm +zone=8"})
    back = mesh_json.read_mesh(spark, str(tmp_path / "a.mesh"))
    assert values(back["vertex"], "vid") == VERTEX
    assert values(back["elem"], "tri") == ELEM
    assert values(back["neigh"], "tri") == values(neigh.select("tri", "n0", "n1", "n2"), "tri")
    assert back["meta"].first().nelem == 2
    params = spark.createDataFrame([(0, 2097152.0, None), (1, 2097152.0, 3.5)], "tri int, area double, veg double")
    mesh_json.write_param(str(tmp_path / "a.param"), params)
    assert values(mesh_json.read_param(spark, str(tmp_path / "a.param")).select("tri", "area", "veg"), "tri") == [(0, 2097152.0, None), (1, 2097152.0, 3.5)]


def test_numbered_text_files(spark, mesh, tmp_path):
    vertex, elem, neigh = mesh
    triangle_files.write_triangles(str(tmp_path / "m"), vertex, elem, neigh)
    assert values(triangle_files.read_node(spark, str(tmp_path / "m.node")), "vid") == [r[:3] for r in VERTEX]
    assert values(triangle_files.read_ele(spark, str(tmp_path / "m.ele")), "tri") == ELEM
    assert values(triangle_files.read_neigh(spark, str(tmp_path / "m.neigh")), "tri") == [(0, 1, -1, -1), (1, -1, 0, -1)]
    v, s = vector.boundary_graph(vertex.select(F.col("vid").alias("seq"), "x", "y"))
    triangle_files.write_poly(str(tmp_path / "m.poly"), v, s)
    v2, s2 = triangle_files.read_poly(spark, str(tmp_path / "m.poly"))
    assert values(v2, "vid") == values(v, "vid") and values(s2, "sid") == values(s, "sid") == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 3, 0)]


def test_geojson(spark, tmp_path):
    points = spark.createDataFrame([(0, 0, 0, 1.0, 2.0), (0, 0, 1, 3.0, 4.0), (1, 0, 0, 5.0, 6.0), (1, 0, 1, 7.0, 8.5)], "fid long, part int, seq int, x double, y double")
    geojson.write_geojson(str(tmp_path / "l.json"), vector.collected(points, "LineString"))
    assert values(vector.exploded(geojson.read_geojson(spark, str(tmp_path / "l.json"))), "fid", "seq") == values(points, "fid", "seq")


def test_shapefile(spark, mesh, tmp_path):
    from terratess.operators.spatial import corners

    t = corners(mesh[1], mesh[0]).withColumn("a_very_long_name", F.col("tri") + 0.5)
    shapefile.write_triangles_shapefile(str(tmp_path / "s"), t, ["a_very_long_name"], "EPSG:26908")
    back = shapefile.read_shapefile(spark, str(tmp_path / "s"))
    rows = back.orderBy("fid").collect()
    assert [r.props for r in rows] == [{"a_very_lon": "0.5"}, {"a_very_lon": "1.5"}]
    assert {(p.x, p.y) for p in rows[0].parts[0]} == {v[1:3] for v in (VERTEX[1], VERTEX[0], VERTEX[2])}
    assert [r.area for r in vector.ring_areas(vector.exploded(back)).collect()] == [2097152.0, 2097152.0]


@pytest.mark.parametrize("kind", ["f4", "f8", "i2"])
def test_geotiff(spark, tmp_path, kind):
    grid = Grid(1000.0, 10.0, 5000.0, -10.0, 7, 5, "somewhere")
    cells = synthetic.flat(spark, 5, 7).withColumn("v", F.col("px") * 10.0 + F.col("py")).where("px <> 3 or py <> 2")
    geotiff.write_geotiff(str(tmp_path / "r.tif"), cells, grid, kind=kind)
    assert geotiff.read_grid(spark, str(tmp_path / "r.tif")) == grid
    assert values(geotiff.read_cells(spark, str(tmp_path / "r.tif")).select("px", "py", "v"), "px", "py") == values(cells, "px", "py")


def test_projections_match_known_points(spark):
    p = spark.createDataFrame([(-135.0, 60.0)], "lon double, lat double")
    x, y = Utm(8).forward(F.col("lon"), F.col("lat"))
    r = p.select(x, y).first()
    assert abs(r[0] - 500_000) < 1e-6 and abs(r[1] - 6_651_411.19) < 0.05
    x, y = Albers().forward(F.col("lon") + 39.0, F.col("lat") - 20.0)
    assert max(abs(v) for v in p.select(x, y).first()) < 1e-6


def test_simplify_keeps_within_tolerance():
    xy = np.column_stack([np.arange(101.0), np.sin(np.arange(101.0) / 5)])
    keep = vector.douglas_peucker(xy, 0.2)
    kept = xy[keep]
    gap = np.abs(np.interp(xy[:, 0], kept[:, 0], kept[:, 1]) - xy[:, 1])
    assert keep[0] and keep[-1] and keep.sum() < 60 and gap.max() < 0.25


@pytest.mark.parametrize(
    "more",
    [
        {"max_tolerance": None},
        {"errormetric": "other"},
        {"extent": (0, 0, 1, 1), "clip_to_shp": "x"},
        {"min_area": -1},
        {"parameter_files": {"v": {"file": ["a"], "method": ["mean"], "classifier": max}}},
        {"parameter_files": {"v": {"file": ["a", "b"], "method": ["mean", "mean"]}}},
        {"parameter_files": {"v": {"file": ["a", "b"], "method": ["mean", "mean"], "classifier": max, "tolerance": 1.0}}},
        {"parameter_files": {"v": {"file": "a", "method": ["mean"]}}},
        {"parameter_files": {"v": {"file": "a", "method": "median"}}},
        {"parameter_files": {"v": {"file": "a", "method": "mean", "weight": 1.5}}},
        {"parameter_files": {"area": {"file": "a", "method": "mean"}}},
        {"unknown": 1},
    ],
)
def test_config_rules(more):
    with pytest.raises(config.ConfigError):
        config.from_mapping({"dem_filename": "d.tif", "max_area": 10.0, "max_tolerance": 1.0} | more)


def test_config_accepts_documented_forms():
    c = config.from_mapping({"dem_filename": "d.tif", "max_area": 10.0, "max_tolerance": 1.0, "parameter_files": {"v": {"file": "a", "method": "mode", "tolerance": 0.9, "weight": 0.25}}})
    assert c.weighted and c.topo_weight == 0.75 and c.output_dir == "d"


def test_whole_pipeline(spark, tmp_path):
    grid = Grid(0.0, 10.0, 320.0, -10.0, 32, 32, "local")
    geotiff.write_geotiff(str(tmp_path / "dem.tif"), synthetic.gauss(spark, 32, 32, 100.0).where("px > 1"), grid)
    geotiff.write_geotiff(str(tmp_path / "veg.tif"), synthetic.vegpatch(spark, 32, 32, shift=0, half=8), grid)
    line = spark.createDataFrame([(0, 0, 0, 60.0, 60.0), (0, 0, 1, 250.0, 200.0)], "fid long, part int, seq int, x double, y double")
    geojson.write_geojson(str(tmp_path / "river.json"), vector.collected(line, "LineString"), "local")
    cfg = config.from_mapping(
        {
            "dem_filename": str(tmp_path / "dem.tif"), "max_area": 20_000.0, "min_area": 400.0, "max_tolerance": 20.0, "user_output_dir": str(tmp_path / "out"),
            "parameter_files": {"veg": {"file": str(tmp_path / "veg.tif"), "method": "mode"}, "mixed": {"file": [str(tmp_path / "veg.tif"), str(tmp_path / "dem.tif")], "method": ["mode", "mean"], "classifier": lambda v, z: F.when(v > 1, z).otherwise(0.0)}},
            "constraints": {"river": {"file": str(tmp_path / "river.json")}},
        }
    )
    r = pipeline.run(spark, cfg)
    assert abs(r.params.agg(F.sum("area")).first()[0] - 300 * 320) < 1e-6
    assert {x[0] for x in r.params.select("veg").distinct().collect()} == {1.0, 100.0}
    assert set(r.params.columns) == {"tri", "area", "id", "veg", "mixed"}
    for ending in ("mesh", "param", "shp", "dbf", "vtu", "node"):
        assert (tmp_path / "out" / f"mesh.{ending}").stat().st_size > 100
    assert list(r.took) == ["rasters", "mesh", "parameters", "files"] and all(s > 0 for s in r.took.values())
    assert geotiff.read_cells(spark, str(tmp_path / "out" / "mesh_surface.tif")).count() == 30 * 32
    lines = str(tmp_path / "out" / "mesh_lines.geojson")
    assert geojson.read_crs(spark, lines) == "local" and geojson.read_geojson(spark, lines).count() == 1
    vertex, segment = triangle_files.read_poly(spark, str(tmp_path / "out" / "mesh.poly"))
    assert vertex.count() == segment.count() == 4
    again = pipeline.run(spark, config.Config(**{**cfg.__dict__, "reuse_mesh": True}))
    assert values(again.elem, "tri") == values(r.elem, "tri")


def test_report(spark, tmp_path):
    report.write_report(str(tmp_path / "r"), spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)], "tri int, error double, area double, min_angle double, max_angle double"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == [("1.0", "2.0", "3.0", "4.0")]


@pytest.fixture(scope="module")
def strip(spark, tmp_path_factory):
    """A strip of triangles on disk, with its surface."""
    at = tmp_path_factory.mktemp("strip")
    vertex = spark.createDataFrame([(k, 10.0 * (k // 2), 10.0 * (k % 2), float(k)) for k in range(22)], "vid int, x double, y double, z double")
    elem = spark.createDataFrame([(7 * k % 20, *([k, k + 2, k + 1] if k % 2 == 0 else [k, k + 1, k + 2])) for k in range(20)], "tri int, v0 int, v1 int, v2 int")
    mesh_json.write_mesh(str(at / "s.mesh"), vertex, elem, topology.neighbours(elem), {"is_geographic": 0, "proj4": "local"})
    geotiff.write_geotiff(str(at / "s.tif"), synthetic.flat(spark, 4, 40, 7.0), Grid(0.0, 2.5, 10.0, -2.5, 40, 4, "local"))
    for name in ("a", "b"):
        mesh_json.write_param(str(at / f"{name}.param"), elem.select("tri", F.col("v0").cast("double").alias("both"), F.lit(1.0 if name == "a" else 2.0).alias(name)))
    return at


@pytest.mark.parametrize("kind", ["rcm", "nd", "metis"])
def test_permutations(spark, strip, kind):
    from terratess.plans import tools

    found = {r["when"]: r["bandwidth"] for r in tools.permute(spark, str(strip / "s.mesh"), str(strip / f"{kind}.mesh"), kind, 4).collect()}
    if kind == "rcm":
        assert found["after"] == 1 < found["before"]
    old, new = (mesh_json.read_mesh(spark, str(strip / f"{n}.mesh")) for n in ("s", kind))
    assert {r[1:] for r in values(old["elem"], "tri")} == {r[1:] for r in values(new["elem"], "tri")}
    assert values(topology.neighbours(new["elem"]).select("tri", "n0", "n1", "n2"), "tri") == values(new["neigh"], "tri")
    assert new["meta"].first()["version"] == tools.VERSIONS[kind]
    if kind == "metis":
        assert new["meta"].first()["local_size"] == [5, 5, 5, 5]


def test_tools(spark, strip):
    from terratess.plans import tools

    r = tools.stats(spark, str(strip / "s.mesh"), str(strip / "s.tif"), str(strip / "report")).first()
    assert (r["n_cells"], r["n_triangles"], r["percent"]) == (160, 20, 12.5)
    assert spark.read.csv(str(strip / "report"), header=True).where("cast(error as double) = 0 and cast(area as double) = 50").count() == 20
    out = tools.merge(spark, [str(strip / "a.param"), str(strip / "b.param")], str(strip / "m.param"))
    merged = mesh_json.read_param(spark, out)
    assert set(merged.columns) == {"tri", "both", "a", "b"} and merged.count() == 20
    tools.to_vtu(spark, str(strip / "s.mesh"), out, str(strip / "s.vtu"))
    tools.to_shapefile(spark, str(strip / "s.mesh"), str(strip / "shape"), out)
    assert 'Name="both"' in (strip / "s.vtu").read_text()
    assert shapefile.read_shapefile(spark, str(strip / "shape")).count() == 20
    for source, target in (("shape", "again"), ("again", "third")):  # with and without the statistics
        r = tools.update_shapefile(spark, str(strip / source), str(strip / "s.tif"), str(strip / target))
        assert r.first()["percent"] == 12.5
        names, table = shapefile.read_attributes(spark, str(strip / target))
        assert sorted(names[:-4]) == ["a", "b", "both"] and names[-4:] == ["error", "area", "min_angle", "max_angle"]
        assert table.where("error = 0 and area = 50 and round(min_angle, 6) = 45 and round(max_angle, 6) = 90 and a = 1 and b = 2").count() == 20
    mesh_json.write_param(str(strip / "short.param"), merged.where("tri < 5").select("tri", "a"))
    with pytest.raises(ValueError):
        tools.merge(spark, [out, str(strip / "short.param")], str(strip / "n.param"))
    assert tools.invalid_vertices(spark, str(strip / "s.mesh"), str(strip / "s.tif")).count() == 0


def test_windows_have_shape(spark, strip):
    from terratess.operators import spatial, zonal

    m = mesh_json.read_mesh(spark, str(strip / "s.mesh"))
    cells = synthetic.flat(spark, 4, 40).where("px <> 0")
    grid = Grid(0.0, 2.5, 10.0, -2.5, 40, 4, "local")
    t = spatial.corners(m["elem"], m["vertex"])
    found = zonal.zonal_window(t, cells, grid, "rows", "v", lambda w: w.shape[0] * 100 + w.shape[1])
    assert found.count() == 20 and {r["rows"] for r in found.collect()} <= {404.0, 403.0, 304.0, 303.0}
    holes = zonal.zonal_window(t, cells, grid, "n", "v", lambda w: np.isnan(w).sum())
    assert all(r["n"] > 0 for r in holes.collect())


def test_classifiers_say_what_they_are(spark):
    from terratess.operators import zonal

    table = spark.createDataFrame([(0, 1.0, 2.0), (1, None, 3.0)], "tri int, a double, b double")
    rule = lambda a, b: b if a is None else a + b
    assert values(zonal.classified(table, "c", ["a", "b"], zonal.plain(rule)), "tri") == [(0, 3.0), (1, 3.0)]
    assert values(zonal.classified(table, "c", ["a", "b"], lambda a, b: F.coalesce(a, b) * 2), "tri") == [(0, 2.0), (1, 6.0)]
    with pytest.raises(TypeError):
        zonal.classified(table, "c", ["a", "b"], lambda a, b: 1.0)
    with pytest.raises(ZeroDivisionError):  # an error of the classifier's own is not hidden
        zonal.classified(table, "c", ["a", "b"], lambda a, b: 1 / 0)
    with pytest.raises(Exception, match="must return a value"):
        zonal.classified(table, "c", ["a", "b"], zonal.plain(lambda a, b: None)).collect()
    filled = spark.createDataFrame([(-9999.0,), (1.0,)], "v double").select(zonal.substituted(F.col("v")).alias("v"))
    assert [r.v for r in filled.collect()] == [None, 1.0]


UTM = "+proj=utm +zone=11 +datum=WGS84 +units=m"


def test_degrees_are_measured_in_metres(spark, tmp_path):
    """A mesh on a grid in degrees is bounded by square metres, and its parameters hold them."""
    grid = Grid(-116.0, 0.001, 51.0, -0.001, 40, 30, "EPSG:4326")
    geotiff.write_geotiff(str(tmp_path / "dem.tif"), synthetic.flat(spark, 30, 40, 500.0), grid)
    assert geotiff.read_grid(spark, str(tmp_path / "dem.tif")).geographic
    cfg = config.from_mapping({"dem_filename": str(tmp_path / "dem.tif"), "max_area": 200_000.0, "max_tolerance": 50.0, "user_output_dir": str(tmp_path / "out"), "write_shp": False, "write_vtu": False})
    r = pipeline.run(spark, cfg)
    areas = [x.area for x in r.params.select("area").collect()]
    cell = 111_319.49**2 * 1e-6 * np.cos(np.radians(50.985))
    assert len(areas) > 40 and max(areas) <= 200_000 and abs(sum(areas) / (cell * 1200) - 1) < 1e-3
    assert abs(grid.least_area / cell - 1) < 1e-6
    assert json.loads((tmp_path / "out" / "mesh.mesh").read_text())["mesh"]["is_geographic"] == 1


def test_surface_parameters_and_lines_are_projected(spark, tmp_path):
    """A surface in degrees, a parameter in UTM and a line in degrees meet in the output's system."""
    degrees = Grid(-117.2, 0.0005, 50.1, -0.0005, 80, 60, "+proj=longlat +datum=WGS84")
    geotiff.write_geotiff(str(tmp_path / "dem.tif"), synthetic.flat(spark, 60, 80, 100.0), degrees)
    x, y = projections.of(UTM).forward(F.lit(-117.2), F.lit(50.1))
    ux, uy = spark.range(1).select(x, y).first()
    metres = Grid(ux - 500, 50.0, uy + 500, -50.0, 100, 100, UTM)
    # the parameter is 1 west of the middle of the surface, else 2
    mid = spark.range(1).select(projections.of(UTM).forward(F.lit(-117.18), F.lit(50.085))[0].alias("x")).first().x
    cells = synthetic.flat(spark, 100, 100, 0.0).withColumn("v", F.when(F.col("px") * 50 + metres.ulx < mid, 1.0).otherwise(2.0))
    geotiff.write_geotiff(str(tmp_path / "side.tif"), cells, metres)
    line = spark.createDataFrame([(0, 0, 0, -117.19, 50.08), (0, 0, 1, -117.17, 50.09)], "fid long, part int, seq int, x double, y double")
    geojson.write_geojson(str(tmp_path / "river.json"), vector.collected(line, "LineString"))
    settings = {
        "dem_filename": str(tmp_path / "dem.tif"), "max_area": 200_000.0, "max_tolerance": 50.0, "user_output_dir": str(tmp_path / "out"), "write_shp": False, "write_vtu": False, "use_input_prj": False, "wkt_out": UTM,
        "parameter_files": {"side": {"file": str(tmp_path / "side.tif"), "method": "mode"}}, "constraints": {"river": {"file": str(tmp_path / "river.json")}},
    }
    r = pipeline.run(spark, config.from_mapping(settings))
    assert r.grid.crs == UTM and not r.grid.geographic and 30 < r.grid.dx < 60
    # about 2.86 km by 3.34 km
    assert abs(r.params.agg(F.sum("area")).first()[0] / (0.04 * 0.03 * 111_319.49**2 * np.cos(np.radians(50.085))) - 1) < 0.02
    t = spatial.corners(r.elem, r.vertex).join(r.params, "tri").withColumn("cx", (F.col("x0") + F.col("x1") + F.col("x2")) / 3)
    wrong = t.where((F.abs(F.col("cx") - mid) > 500) & (F.col("side") != F.when(F.col("cx") < mid, 1.0).otherwise(2.0)))
    assert wrong.count() == 0 and t.where("side = 1").count() > 5 and t.where("side = 2").count() > 5
    ends = vector.exploded(geojson.read_geojson(spark, str(tmp_path / "out" / "mesh_lines.geojson")))
    to = projections.between("EPSG:4326", UTM)
    want = line.select(*[c.alias(n) for c, n in zip(to(F.col("x"), F.col("y")), "xy")]).orderBy("x").collect()
    assert all(abs(a.x - b.x) < 1e-4 and abs(a.y - b.y) < 1e-4 for a, b in zip(ends.orderBy("x").collect(), want))
    with pytest.raises(ValueError):
        pipeline.run(spark, config.from_mapping(settings | {"wkt_out": "nowhere"}))


def test_named_systems():
    names = {
        "EPSG:4326": projections.Geographic(), "GEOGCS[\"WGS 84\",DATUM[\"WGS_1984\"]]": projections.Geographic(), "EPSG:32611": projections.Utm(11), "EPSG:32733": projections.Utm(33, False),
        "NAD83 / UTM zone 8N": projections.Utm(8), 'PROJCS["NAD_1983_UTM_Zone_8N",GEOGCS["GCS_North_American_1983"]]': projections.Utm(8), "+proj=utm +zone=8 +south +datum=WGS84": projections.Utm(8, False),
        "ESRI:102008": projections.Albers(), projections.Albers().crs: projections.Albers(),
        'PROJCS["x",GEOGCS["y"],PROJECTION["Albers_Conic_Equal_Area"],PARAMETER["longitude_of_center",-96],PARAMETER["Standard_Parallel_1",20],PARAMETER["Standard_Parallel_2",60],PARAMETER["latitude_of_center",40]]': projections.Albers(),
    }
    for name, p in names.items():
        assert projections.of(name) == p
    for name in ("local", "", 'PROJCS["Lambert",GEOGCS["WGS 84"]]', "EPSG:3857"):
        with pytest.raises(ValueError):
            projections.of(name)
    assert projections.same("local", "local") and not projections.same("local", "other") and projections.same("EPSG:32608", "NAD83 / UTM zone 8N")


def test_kernel_and_columns_agree_on_sizes(spark):
    points = [(float(lon), float(lat)) for lon in (-180, -117.3, 0, 12.5, 179) for lat in (-89.9, -45, 0, 50.123, 90)]
    found = spark.createDataFrame(points, "lon double, lat double").select("lon", "lat", *[c.alias(n) for c, n in zip(geometry.mollweide(F.col("lon"), F.col("lat")), "xy")]).collect()
    for r in found:
        x, y = refine.equal_area(r.lon, r.lat)
        assert abs(x - r.x) < 1e-3 and abs(y - r.y) < 1e-3


def test_windows_are_read_by_block(spark, tmp_path):
    grid = Grid(0.0, 1.0, 50.0, -1.0, 70, 50, "local")
    cells = synthetic.ridge(spark, 50, 70, 10.0)
    geotiff.write_geotiff(str(tmp_path / "r.tif"), cells, grid, kind="f8")
    whole = geotiff.read_cells(spark, str(tmp_path / "r.tif"))
    assert values(whole.select("py", "px", "v"), "py", "px") == values(cells.select("py", "px", "v"), "py", "px")
    part = geotiff.read_cells(spark, str(tmp_path / "r.tif"), (5, 7, 20, 9)).select("py", "px", "v")
    assert values(part, "py", "px") == values(geotiff.read_window(whole, 5, 7, 20, 9).select("py", "px", "v"), "py", "px") and part.count() == 180
    t = geotiff.Tiff(lambda at, n, data=(tmp_path / "r.tif").read_bytes(): data[at : at + n])
    assert [y for _, y, _ in t.blocks((0, 7, 3, 2))] == [7, 8]


def test_an_extent_reads_its_window_alone(spark, tmp_path):
    grid = Grid(0.0, 10.0, 320.0, -10.0, 32, 32, "local")
    geotiff.write_geotiff(str(tmp_path / "dem.tif"), synthetic.gauss(spark, 32, 32, 100.0), grid)
    cfg = config.from_mapping({"dem_filename": str(tmp_path / "dem.tif"), "max_area": 1000.0, "max_tolerance": 5.0, "extent": (55.0, 105.0, 200.0, 240.0)})
    cells, own = pipeline.surface(spark, cfg)
    assert own == grid and sorted((r.px, r.py) for r in cells.collect()) == [(x, y) for x in range(5, 20) for y in range(8, 22)]
    assert raster.extent_window(grid, (400.0, 0.0, 500.0, 10.0))[2] == 10 and raster.extent_subset(cells, grid, (400.0, 0.0, 500.0, 10.0)).count() == 0
