"""Tools on finished meshes: statistics, permutation, parameter merge, conversions.

``python -m terratess.plans.tools stats|permute|merge|vtu|shp|update ...`` runs one.
"""

from __future__ import annotations

import argparse
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.functions.geometry import mean_z
from terratess.operators import params, raster, spatial, topology, vector
from terratess.shipping import ship
from terratess.sources import geotiff, mesh_json, report, shapefile, vtu

#: Versions of the mesh format after an ordering, by kind.
VERSIONS = {"rcm": "1.2.0", "nd": "1.2.0", "metis": "2.0.0"}


def stats(spark: SparkSession, mesh: str, dem: str, out: str) -> DataFrame:
    """Area, angles and RMSE per triangle as CSV, and triangles against valid cells."""
    m = mesh_json.read_mesh(spark, mesh)
    grid = geotiff.read_grid(spark, dem)
    cells = geotiff.read_cells(spark, dem).select("px", "py", F.col("v").alias("z"))
    report.write_report(out, params.mesh_report(m["elem"], m["vertex"], cells, grid))
    return params.cells_against_triangles(cells.withColumnRenamed("z", "v"), m["elem"])


def update_shapefile(spark: SparkSession, stem: str, dem: str, out: str) -> DataFrame:
    """A mesh's shapefile with ``error, area, min_angle, max_angle`` of each triangle against the raster, which it had before or not; triangles against valid cells.

    Triangles of shapefiles have no shared vertices: each has three of its own.
    """
    ship(spark)
    points = vector.exploded(shapefile.read_shapefile(spark, stem)).where("part = 0 and seq < 3").withColumn("vid", (F.col("fid") * 3 + F.col("seq")).cast("int"))
    elem = points.select(F.col("fid").cast("int").alias("tri")).distinct().select("tri", *[(F.col("tri") * 3 + k).alias(f"v{k}") for k in range(3)])
    grid = geotiff.read_grid(spark, dem)
    cells = geotiff.read_cells(spark, dem).select("px", "py", F.col("v").alias("z"))
    vertex = points.select("vid", "x", "y", F.lit(0.0).alias("z"))
    found = params.mesh_report(elem, vertex, cells, grid)
    fields, held = shapefile.read_attributes(spark, stem)
    fields = [f for f in fields if f not in found.columns]
    table = spatial.corners(elem, vertex).join(found, "tri").join(held.select("tri", *fields), "tri", "left")
    shapefile.write_triangles_shapefile(out, table, [*fields, "error", "area", "min_angle", "max_angle"], shapefile.read_crs(spark, stem))
    return params.cells_against_triangles(cells.withColumnRenamed("z", "v"), elem)


def order(m: dict[str, DataFrame], kind: str, parts: int = 2) -> tuple[DataFrame, DataFrame | None]:
    """``(tri, position)`` and for partitions their sizes."""
    if kind == "rcm":
        return topology.rcm_order(m["neigh"]), None
    t = spatial.corners(m["elem"], m["vertex"])
    centres = t.select("tri", ((F.col("x0") + F.col("x1") + F.col("x2")) / 3).alias("x"), ((F.col("y0") + F.col("y1") + F.col("y2")) / 3).alias("y"))
    if kind == "nd":
        return topology.dissection_order(centres), None
    if kind != "metis":
        raise ValueError(f"unknown ordering {kind!r}; known are {', '.join(VERSIONS)}")
    found = topology.partition_by_graph(topology.partition_by_position(centres, parts), m["neigh"])
    return topology.partition_order(found).select("tri", "position"), topology.partition_sizes(found)


def permute(spark: SparkSession, mesh: str, out: str, kind: str = "rcm", parts: int = 2) -> DataFrame:
    """Renumbers triangles; returns the bandwidth before and after."""
    ship(spark)
    m = mesh_json.read_mesh(spark, mesh)
    found, sizes = order(m, kind, parts)
    elem, neigh = topology.relabelled(m["elem"], m["neigh"], found)
    head = m["meta"].first()
    meta = {"is_geographic": head["is_geographic"], "proj4": head["proj4"], "UTM_zone": head["utm_zone"], "version": VERSIONS[kind], "partition_method": kind}
    if sizes is not None:
        meta["local_size"] = [r["local_size"] for r in sizes.orderBy("part").collect()]  # one number per part
    mesh_json.write_mesh(out, m["vertex"], elem, neigh, meta)
    return topology.permutation_report(topology.edges(m["neigh"]), found)


def merge(spark: SparkSession, files: list[str], out: str | None = None) -> str:
    """Parameter files as one; the last of equal names stays, unequal lengths are an error."""
    out = out or "+".join(PurePosixPath(f).stem for f in files) + ".param"
    mesh_json.write_param(out, params.merge_checked(*[mesh_json.read_param(spark, f) for f in files]))
    return out


def to_vtu(spark: SparkSession, mesh: str, param: str, out: str) -> None:
    m = mesh_json.read_mesh(spark, mesh)
    elevation = spatial.corners(m["elem"], m["vertex"]).select("tri", mean_z(F.col("z0"), F.col("z1"), F.col("z2")).alias("elevation"))
    cells = elevation.join(mesh_json.read_param(spark, param), "tri", "left")
    vtu.write_vtu(out, m["vertex"], m["elem"], cells, m["meta"].first()["proj4"] or "", prefix="")


def to_shapefile(spark: SparkSession, mesh: str, stem: str, param: str | None = None) -> None:
    m = mesh_json.read_mesh(spark, mesh)
    t, columns = spatial.corners(m["elem"], m["vertex"]), []
    if param:
        p = mesh_json.read_param(spark, param)
        columns = [c for c in p.columns if c != "tri"]
        t = t.join(p, "tri")
    shapefile.write_triangles_shapefile(stem, t, columns, m["meta"].first()["proj4"] or "")


def invalid_vertices(spark: SparkSession, mesh: str, dem: str) -> DataFrame:
    """Vertices whose cell and neighbours have no value."""
    m = mesh_json.read_mesh(spark, mesh)
    cells = geotiff.read_cells(spark, dem).select("px", "py", "v")
    return raster.extract_points(m["vertex"].select("vid", "x", "y"), cells, geotiff.read_grid(spark, dem)).where("v is null")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    kinds = parser.add_subparsers(dest="tool", required=True)
    for name, options in {"stats": ("mesh", "dem", "out"), "permute": ("mesh", "out"), "merge": (), "vtu": ("mesh", "param", "out"), "shp": ("mesh", "stem"), "update": ("stem", "dem", "out")}.items():
        p = kinds.add_parser(name)
        for o in options:
            p.add_argument(o)
        if name == "permute":
            p.add_argument("--kind", choices=sorted(VERSIONS), default="rcm")
            p.add_argument("--parts", type=int, default=2)
        if name == "merge":
            p.add_argument("files", nargs="+")
            p.add_argument("--out")
        if name == "shp":
            p.add_argument("--param")
    a = vars(parser.parse_args(args))
    spark = SparkSession.builder.getOrCreate()
    run = {"stats": stats, "permute": permute, "merge": merge, "vtu": to_vtu, "shp": to_shapefile, "update": update_shapefile}[a.pop("tool")]
    found = run(spark, **a)
    if isinstance(found, DataFrame):
        found.show()


if __name__ == "__main__":
    main()
