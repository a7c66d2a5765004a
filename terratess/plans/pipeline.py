"""From rasters and lines to a parameterised mesh and its files."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.functions import geometry
from terratess.model import Grid
from terratess.operators import acceptance, raster, refine, spatial, vector, zonal
from terratess.plans.config import Config, Parameter
from terratess.shipping import ship
from terratess.sources import geojson, geotiff, mesh_json, shapefile, triangle_files, vtu
from terratess.staging import stage


log = logging.getLogger(__name__)


@dataclass
class Result:
    grid: Grid
    vertex: DataFrame
    elem: DataFrame
    neigh: DataFrame
    params: DataFrame
    initial: DataFrame | None
    #: Seconds of each step.
    took: dict[str, float] = field(default_factory=dict)


def surface(spark: SparkSession, cfg: Config) -> tuple[DataFrame, Grid]:
    """The DEM's valid cells after cutting, projecting, filling and smoothing, staged."""
    grid = geotiff.read_grid(spark, cfg.dem_filename)
    window = raster.extent_window(grid, cfg.extent) if cfg.extent else None
    cells = geotiff.read_cells(spark, cfg.dem_filename, window).select("px", "py", "v")
    if cfg.clip_to_shp:
        rings = vector.exploded(shapefile.read_shapefile(spark, cfg.clip_to_shp)).withColumnRenamed("part", "ring")
        rings = vector.reproject(rings, shapefile.read_crs(spark, cfg.clip_to_shp), grid.crs)
        cells = raster.clip_to_polygon(cells, grid, rings)
    if not cfg.use_input_prj:
        cells, grid = raster.reprojected(spark, cells, grid, cfg.wkt_out)
    if cfg.fill_holes:
        cells = raster.fill_nodata(spark, cells, grid, cfg.fill_radius)
    if cfg.do_smoothing:
        for f in raster.smoothing_factors(cfg.smoothing_scaling_factor, cfg.max_smooth_iter):
            target = raster.finer(grid, f)
            cells, grid = raster.smooth(spark, stage(cells, "cells"), grid, target), target
    return stage(cells, "dem"), grid


def aligned(spark: SparkSession, file: str, method, grid: Grid, cfg: Config) -> DataFrame:
    """One parameter raster on the DEM's grid and in its coordinate system."""
    own = geotiff.read_grid(spark, file)
    cells, own = raster.reprojected(spark, geotiff.read_cells(spark, file).select("px", "py", "v"), own, grid.crs)
    same = own.geotransform == grid.geotransform and (own.width, own.height) == (grid.width, grid.height)
    if not same and cfg.do_cell_resize:
        cells = raster.resample(cells, own, grid, "mode" if method == "mode" else "average")
    elif not same:
        cells = raster.warp(spark, cells, own, grid, lambda x, y: (x, y))
    return raster.fill_nodata(spark, cells, grid, cfg.fill_radius) if cfg.fill_holes else cells


def layers(spark: SparkSession, dem: DataFrame, grid: Grid, cfg: Config) -> DataFrame:
    """All rasters as columns of one table of cells: ``z`` and per parameter ``name__k``; staged once, joined once."""
    every = {"z": dem}
    for name, p in (cfg.parameter_files | cfg.initial_conditions).items():
        for k, (file, method) in enumerate(zip(p.files, p.methods)):
            every[f"{name}__{k}"] = aligned(spark, file, method, grid, cfg)
    return stage(zonal.layered(every), "layers")


def domain(spark: SparkSession, dem: DataFrame, grid: Grid, cfg: Config) -> list[tuple[float, float]]:
    """The outline: the largest region of valid cells, its outer ring, simplified where asked. One ring is a bounded list."""
    region = vector.cell_components(raster.mask(dem).select("px", "py", F.col("mask").alias("v")))
    best = vector.largest(vector.component_areas(region, grid), "area", "component")
    rings = vector.rings(region.join(F.broadcast(best.select("component")), "component", "left_semi"), grid).where("part = 0")
    if cfg.simplify:
        if not cfg.no_simplify_buffer and cfg.simplify_buffer:
            rings = vector.buffer(rings, cfg.simplify_buffer).where("part = 0")  # the largest of the pieces
        rings = vector.simplify(rings, cfg.simplify_tol)
    vertex, _ = vector.boundary_graph(vector.longest_line(stage(rings, "outline")))
    return [(r.x, r.y) for r in vertex.orderBy("vid").collect()]


def constraint_lines(spark: SparkSession, cfg: Config, outline: list[tuple[float, float]], crs: str) -> DataFrame | None:
    """Inner lines, simplified each by its own tolerance in its own units, projected, cut to the domain, rounded and numbered together."""
    found = []
    for c in cfg.constraints.values():
        json, stem = c.file.endswith("json"), c.file.removesuffix(".shp")
        features = geojson.read_geojson(spark, c.file) if json else shapefile.read_shapefile(spark, stem, require_crs=not c.crs)
        points = vector.exploded(features)
        if c.simplify:
            points = vector.simplify(points, c.simplify)
        points = vector.reproject(points, c.crs or (geojson.read_crs(spark, c.file) if json else shapefile.read_crs(spark, stem)), crs)
        found.append(vector.clip_lines(points, outline))
    return stage(vector.merged(*found), "constraints") if found else None


def criteria(cfg: Config, grid: Grid) -> acceptance.Criteria:
    found = {"z": acceptance.Layer(cfg.errormetric, None if cfg.uniform else cfg.max_tolerance, cfg.topo_weight if cfg.weighted else 0.0)}
    for name, p in cfg.parameter_files.items():
        if p.tolerance is not None:
            found[f"{name}__0"] = acceptance.Layer("cover" if p.categorical else cfg.errormetric, p.tolerance, p.weight or 0.0)
    return acceptance.Criteria(cfg.max_area, cfg.min_area or grid.least_area, found, cfg.uniform, cfg.weight_threshold if cfg.weighted else None)


def parameterise(triangles: DataFrame, cells: DataFrame, grid: Grid, wanted: dict[str, Parameter]) -> DataFrame:
    """``(tri, area, id, name ...)``: all parameters from one spatial join."""
    columns = {f"{n}__{k}": (f"{n}__{k}", m) for n, p in wanted.items() for k, m in enumerate(p.methods)}
    out = triangles.select("tri", geometry.area_on(grid)(*[F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")]).alias("area"), F.col("tri").cast("long").alias("id"))
    if not columns:
        return out
    found = zonal.zonal(triangles, cells, grid, columns)
    for n, p in wanted.items():
        inputs = [f"{n}__{k}" for k in range(len(p.files))]
        found = zonal.classified(found, n, inputs, p.classifier) if p.classifier else found.withColumnRenamed(inputs[0], n)
    return out.join(found, "tri")


@contextmanager
def timed(took: dict[str, float], step: str) -> Iterator[None]:
    began = time.perf_counter()
    yield
    took[step] = time.perf_counter() - began
    log.info("%s took %.2f s", step, took[step])


def mesh_of(spark: SparkSession, cfg: Config, dem: DataFrame, cells: DataFrame, grid: Grid, stem: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The refined mesh as (vertex, elem, neigh); outline, inner lines and mesh are written beside it."""
    outline = domain(spark, dem, grid, cfg)
    ring = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(outline)], "seq int, x double, y double")
    triangle_files.write_poly(f"{stem}.poly", *vector.boundary_graph(ring))
    lines = constraint_lines(spark, cfg, outline, grid.crs)
    inner: dict = {}
    if lines is not None:
        geojson.write_geojson(f"{stem}_lines.geojson", vector.collected(lines, "MultiLineString"), grid.crs)
        for r in lines.orderBy("fid", "part", "seq").collect():  # the kernel holds the planar graph anyway
            inner.setdefault((r.fid, r.part), []).append((r.x, r.y))
    mesh = refine.refine(spark, outline, cells, grid, criteria(cfg, grid), list(inner.values()), cfg.lloyd_itr, cfg.most_vertices)
    vertex, elem, neigh = refine.frames(spark, mesh)
    triangle_files.write_triangles(stem, vertex, elem, neigh)
    return vertex, elem, neigh


def run(spark: SparkSession, cfg: Config) -> Result:
    ship(spark)
    took: dict[str, float] = {}
    stem = f"{cfg.output_dir.rstrip('/')}/mesh"
    with timed(took, "rasters"):
        dem, grid = surface(spark, cfg)
        cells = layers(spark, dem, grid, cfg)
        geotiff.write_geotiff(f"{stem}_surface.tif", dem, grid)
    with timed(took, "mesh"):
        if cfg.reuse_mesh:
            vertex, elem, neigh = triangle_files.read_node(spark, f"{stem}.node"), triangle_files.read_ele(spark, f"{stem}.ele"), triangle_files.read_neigh(spark, f"{stem}.neigh")
        else:
            vertex, elem, neigh = mesh_of(spark, cfg, dem, cells, grid, stem)
    with timed(took, "parameters"):
        heights = refine.repair_heights(refine.vertex_heights(vertex, cells, grid), elem)
        triangles = spatial.corners(elem, heights)
        params = parameterise(triangles, cells, grid, cfg.parameter_files)
        params = params.drop(*[n for n, p in cfg.parameter_files.items() if p.drop])
        initial = parameterise(triangles, cells, grid, cfg.initial_conditions).drop("area", "id") if cfg.initial_conditions else None
        result = Result(grid, heights, elem, neigh, stage(params, "params"), initial, took)
    with timed(took, "files"):
        write(result, stem, cfg)
    if cfg.verbose:
        print("\n".join(f"{step}: {s:.2f} s" for step, s in took.items()))
    return result


def write(r: Result, stem: str, cfg: Config) -> None:
    mesh_json.write_mesh(f"{stem}.mesh", r.vertex, r.elem, r.neigh, {"is_geographic": int(r.grid.geographic), "proj4": r.grid.crs})
    mesh_json.write_param(f"{stem}.param", r.params)
    if r.initial is not None:
        mesh_json.write_ic(f"{stem}.ic", r.initial)
    triangles = spatial.corners(r.elem, r.vertex)
    if cfg.write_shp:
        columns = [c for c in r.params.columns if c != "tri"]
        shapefile.write_triangles_shapefile(stem, triangles.join(r.params, "tri"), columns, r.grid.crs)
    if cfg.write_vtu:
        elevation = triangles.select("tri", geometry.mean_z(F.col("z0"), F.col("z1"), F.col("z2")).alias("elevation"), F.col("tri").alias("cellid"))
        vtu.write_vtu(f"{stem}.vtu", r.vertex, r.elem, elevation.join(r.params.drop("id"), "tri"), r.grid.crs)
