"""The engine's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terratess.functions import geometry as g
from terratess.functions.projections import Albers, Utm, between
from terratess.model import Grid
from terratess.operators import acceptance, flow, metrics, params, raster, spatial, topology, vector, zonal
from terratess.operators.numbering import numbered
from terratess.plans import adapter
from terratess.sources import synthetic

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

CRITERIA = {"rmse": 20000.0, "cover": 0.9}


class Scene:
    """Grid, cells and mesh of one query; every table is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.w = adapter.width(spark, sf_dir)
        self.grid = adapter.grid(self.w)
        self.cells = adapter.dem(spark, sf_dir, self.w)
        self.vertex = adapter.vertices(spark, self.w)
        self.elem = adapter.elements(spark, self.w)

    @property
    def triangles(self) -> DataFrame:
        return spatial.corners(self.elem, self.vertex)

    def layer(self, name: str = "z") -> DataFrame:
        return self.cells.select("px", "py", F.col(name).cast("double").alias("v"))

    def zonal(self, **columns) -> DataFrame:
        return zonal.zonal(self.triangles, self.cells, self.grid, columns)

    def errors(self, **layers) -> DataFrame:
        return metrics.errors(self.elem, self.vertex, self.cells, self.grid, layers)

    @property
    def neigh(self) -> DataFrame:
        return topology.neighbours(self.elem)

    @property
    def centres(self) -> DataFrame:
        return self.triangles.select("tri", ((F.col("x0") + F.col("x1") + F.col("x2")) / 3).alias("x"), ((F.col("y0") + F.col("y1") + F.col("y2")) / 3).alias("y"))


def query(f: Callable[[Scene], DataFrame]) -> Callable[[Scene], DataFrame]:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(Scene(spark, sf_dir))

    QUERIES[f.__name__] = run
    return f


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query
def zonal_mean(s: Scene) -> DataFrame:
    return _round(s.zonal(mean=("z", "mean")), "mean")


@query
def zonal_min(s: Scene) -> DataFrame:
    return s.zonal(min=("z", "min"))


@query
def zonal_max(s: Scene) -> DataFrame:
    return s.zonal(max=("z", "max"))


@query
def zonal_mode(s: Scene) -> DataFrame:
    return s.zonal(mode=("lc", "mode"))


@query
def zonal_count(s: Scene) -> DataFrame:
    return s.zonal(n_cells=("z", "count"))


@query
def zonal_all(s: Scene) -> DataFrame:
    """All parameters of all layers in one spatial join."""
    return _round(s.zonal(z_mean=("z", "mean"), z_min=("z", "min"), z_max=("z", "max"), lc_mode=("lc", "mode"), q_mean=("q", "average"), n=("z", "count")), "z_mean", "q_mean")


@query
def zonal_multi_classified(s: Scene) -> DataFrame:
    """Two rasters, two methods, one classifier."""
    found = s.zonal(height=("z", "mean"), kind=("lc", "mode"))
    rule = lambda height, kind: F.when((kind == 1) & (height >= 50000), 3.0).when(kind == 1, 2.0).otherwise(1.0)
    return zonal.classified(found, "class", ["height", "kind"], rule)


@query
def zonal_user_method(s: Scene) -> DataFrame:
    """A callable from cell values to a number: the range."""
    return s.zonal(spread=("z", lambda v: v.max() - v.min()))


@query
def classifier_callable(s: Scene) -> DataFrame:
    found = s.zonal(height=("z", "min"), kind=("lc", "mode"))
    return zonal.classified(found, "class", ["height", "kind"], zonal.plain(_plain_rule))


def _plain_rule(height, kind):
    return 0.0 if height is None or height > 5000 else float(kind) + 1


@query
def tri_area(s: Scene) -> DataFrame:
    return s.triangles.select("tri", g.area(*[F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")]).alias("area"))


@query
def tri_min_sine2(s: Scene) -> DataFrame:
    return _round(s.triangles.select("tri", g.min_sine2(*[F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")]).alias("sine2")), "sine2")


@query
def tri_angles(s: Scene) -> DataFrame:
    a = g.angles(*[F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")])
    return _round(s.triangles.select("tri", F.least(*a).alias("min_angle"), F.greatest(*a).alias("max_angle")), "min_angle", "max_angle")


@query
def tri_elevation(s: Scene) -> DataFrame:
    at = raster.extract_points(s.vertex.drop("z"), s.cells, s.grid, "z")
    return _round(spatial.corners(s.elem, at).select("tri", g.mean_z(F.col("z0"), F.col("z1"), F.col("z2")).alias("elevation")), "elevation")


@query
def tri_window(s: Scene) -> DataFrame:
    w = g.bbox_window([F.col(f"x{k}") for k in range(3)], [F.col(f"y{k}") for k in range(3)], s.grid)
    return s.triangles.select("tri", *[v.alias(c) for c, v in w.items()])


@query
def geographic_area(s: Scene) -> DataFrame:
    """Equal-area size of triangles given in degrees."""
    lon = lambda k: (F.col(f"x{k}") - 1000) / 100000 - 120
    lat = lambda k: (F.col(f"y{k}") - 90000) / 100000 + 50
    xy = [c for k in range(3) for c in g.mollweide(lon(k), lat(k))]
    flat = s.triangles.select("tri", *[c.alias(f"m{i}") for i, c in enumerate(xy)])
    return _round(flat.select("tri", g.area(*[F.col(f"m{i}") for i in range(6)]).alias("area")), "area", places=1)


@query
def plane_rmse(s: Scene) -> DataFrame:
    return _round(s.errors(z="rmse"), "z_rmse")


@query
def plane_max_diff(s: Scene) -> DataFrame:
    return _round(s.errors(z="max_tol"), "z_max_tol")


@query
def mean_tolerance(s: Scene) -> DataFrame:
    return _round(s.errors(z="mean_tol"), "z_mean_tol")


@query
def category_cover(s: Scene) -> DataFrame:
    return _round(s.errors(lc="cover"), "lc_cover")


@query
def category_histogram(s: Scene) -> DataFrame:
    return metrics.histogram(spatial.touched(s.triangles, s.cells, s.grid), "lc")


@query
def report_rmse(s: Scene) -> DataFrame:
    return _round(metrics.mesh_rmse(s.elem, s.vertex, s.cells, s.grid), "rmse")


def _criteria(**more) -> acceptance.Criteria:
    layers = {"z": acceptance.Layer("rmse", CRITERIA["rmse"], 0.5), "lc": acceptance.Layer("cover", CRITERIA["cover"], 0.25), "q": acceptance.Layer("mean_tol", None, 0.25)}
    return acceptance.Criteria(max_area=9800.0, min_area=7000.0, layers=layers, **more)


@query
def badness_strict(s: Scene) -> DataFrame:
    return acceptance.badness(s.elem, s.vertex, s.cells, s.grid, _criteria()).select("tri", "badness")


@query
def badness_weighted(s: Scene) -> DataFrame:
    return acceptance.badness(s.elem, s.vertex, s.cells, s.grid, _criteria(weight_threshold=0.75)).select("tri", "badness", "alpha")


@query
def badness_uniform(s: Scene) -> DataFrame:
    return acceptance.badness(s.elem, s.vertex, s.cells, s.grid, _criteria(uniform=True)).select("tri", "badness")


@query
def refinement_queue(s: Scene) -> DataFrame:
    """The worst triangles first; the place stands in a column."""
    bad = acceptance.badness(s.elem, s.vertex, s.cells, s.grid, _criteria()).where("badness <> 'NOT_BAD'")
    placed = numbered(bad, [F.desc("area"), F.round("sine2", 9).asc(), F.col("tri").asc()], "place", first=1)
    return placed.select("tri", "area", F.col("place").cast("int").alias("place"))


@query
def point_extract(s: Scene) -> DataFrame:
    return raster.sample_points(s.vertex.select("vid", "x", "y"), s.cells, s.grid, ["z"]).select("vid", "px", "py", "z")


@query
def point_extract_fallback(s: Scene) -> DataFrame:
    return _round(raster.extract_points(s.vertex.select("vid", "x", "y"), s.cells, s.grid, "z"), "z").select("vid", "z")


@query
def mesh_neighbors(s: Scene) -> DataFrame:
    return s.neigh


@query
def mesh_bandwidth(s: Scene) -> DataFrame:
    return topology.bandwidth(topology.edges(s.neigh))


@query
def mesh_density(s: Scene) -> DataFrame:
    return topology.density(topology.edges(s.neigh), s.elem)


@query
def mesh_adjacency(s: Scene) -> DataFrame:
    return topology.adjacency(s.neigh)


@query
def partition_order(s: Scene) -> DataFrame:
    """Triangles by strip of ten, then id."""
    parts = s.elem.select("tri", F.floor(F.col("tri") % 30 / 10).cast("int").alias("part"))
    return topology.partition_order(parts)


@query
def partition_bisection(s: Scene) -> DataFrame:
    """Sizes of four parts of neighbouring triangles."""
    return topology.partition_sizes(topology.partition_by_position(s.centres, 4))


@query
def permuted_bandwidth(s: Scene) -> DataFrame:
    order = topology.partition_order(s.elem.select("tri", (F.col("tri") % 3).alias("part"))).select("tri", "position")
    return topology.permutation_report(topology.edges(s.neigh), order)


@query
def rcm_order(s: Scene) -> DataFrame:
    return topology.rcm_order(s.neigh)


@query
def dissection_order(s: Scene) -> DataFrame:
    return topology.dissection_order(s.centres)


@query
def param_merge(s: Scene) -> DataFrame:
    """Two tables with one name in common: the later one's stays."""
    a = s.zonal(height=("z", "min"), kind=("lc", "mode"))
    b = s.zonal(height=("z", "max"), amount=("q", "max"))
    return params.merge(a, b).select("tri", "kind", "height", "amount")


@query
def param_length_check(s: Scene) -> DataFrame:
    return params.lengths(s.elem, s.elem.where("tri % 7 <> 0"), s.vertex)


@query
def param_long(s: Scene) -> DataFrame:
    return params.long_form(s.zonal(height=("z", "min"), amount=("q", "max")))


@query
def cells_vs_triangles(s: Scene) -> DataFrame:
    return params.cells_against_triangles(s.layer(), s.elem)


@query
def mesh_report(s: Scene) -> DataFrame:
    return _round(params.mesh_report(s.elem, s.vertex, s.cells, s.grid), "error", "min_angle", "max_angle")


def _coarse(s: Scene) -> Grid:
    return Grid(adapter.ULX + 8, 40.0, adapter.ULY - 4, -40.0, s.w * 16 // 40, s.w * 16 // 40)


@query
def resample_average(s: Scene) -> DataFrame:
    return _round(raster.resample(s.layer(), s.grid, _coarse(s)), "v")


@query
def resample_mode(s: Scene) -> DataFrame:
    return raster.resample(s.layer("lc"), s.grid, _coarse(s), "mode")


@query
def fill_nodata(s: Scene) -> DataFrame:
    return _round(raster.fill_nodata(s.spark, s.layer(), s.grid, 2), "v")


@query
def smooth(s: Scene) -> DataFrame:
    return _round(raster.smooth(s.spark, s.layer(), s.grid, raster.finer(s.grid, 2)), "v")


@query
def extent_subset(s: Scene) -> DataFrame:
    return raster.extent_subset(s.layer(), s.grid, (1100.0, 89500.0, 1500.0, 89900.0))


@query
def mask_cells(s: Scene) -> DataFrame:
    return raster.mask(s.layer())


@query
def count_valid(s: Scene) -> DataFrame:
    return raster.count_valid(s.layer())


@query
def clip_polygon(s: Scene) -> DataFrame:
    """Cells inside a concave outline."""
    ring = [(1050.0, 89950.0), (1700.0, 89900.0), (1400.0, 89600.0), (1650.0, 89300.0), (1080.0, 89350.0)]
    points = s.spark.createDataFrame([(0, 0, k, x, y) for k, (x, y) in enumerate(ring)], "fid long, ring int, seq int, x double, y double")
    return raster.clip_to_polygon(s.layer(), s.grid, points)


@query
def warp_shift(s: Scene) -> DataFrame:
    """Nearest neighbour on a grid of other cell size and origin."""
    return raster.warp(s.spark, s.layer(), s.grid, _coarse(s), lambda x, y: (x, y))


@query
def components(s: Scene) -> DataFrame:
    return vector.cell_components(s.cells.select("px", "py", (F.col("lc") % 2).alias("v"))).select("px", "py", "component")


@query
def largest_component(s: Scene) -> DataFrame:
    found = vector.cell_components(raster.mask(s.layer()).select("px", "py", F.col("mask").alias("v")))
    return vector.largest(vector.component_areas(found, s.grid), "area", "component").select("component", "n_cells", "area")


@query
def polygon_areas(s: Scene) -> DataFrame:
    """Outer less inner rings; equals cells times cell area."""
    rings = vector.polygonize(s.cells.select("px", "py", (F.col("lc") % 2).alias("v")), s.grid)
    areas = vector.ring_areas(rings)
    return areas.groupBy(F.col("fid").alias("component")).agg(F.sum(F.when(F.col("part") == 0, F.col("area")).otherwise(-F.col("area"))).alias("area"))


def _lines(s: Scene) -> DataFrame:
    """Orders of a customer as a polyline."""
    o = adapter.read(s.spark, s.sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("fid"), F.lit(0).alias("part"), (F.row_number().over(w) - 1).alias("seq"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"))


@query
def longest_line(s: Scene) -> DataFrame:
    return vector.longest_line(_lines(s)).select("fid", "seq", "x", "y")


@query
def pslg_segments(s: Scene) -> DataFrame:
    """All lines, one behind the other, as one ring."""
    return vector.boundary_graph(_lines(s).select(F.struct("fid", "seq").alias("seq"), "x", "y"))[1]


@query
def constraint_segments(s: Scene) -> DataFrame:
    return vector.constraint_segments(_lines(s)).drop("part")


@query
def merged_constraints(s: Scene) -> DataFrame:
    lines = _lines(s)
    return vector.merged(lines.where("fid % 2 = 0"), lines.where("fid % 2 = 1")).drop("part")


@query
def simplify_lines(s: Scene) -> DataFrame:
    return vector.simplify(_lines(s), 1000.0)


@query
def ridge_dem(s: Scene) -> DataFrame:
    return _round(synthetic.ridge(s.spark, 64, 64, 10.0), "v")


@query
def gauss_dem(s: Scene) -> DataFrame:
    return _round(synthetic.gauss(s.spark, 64, 48), "v")


@query
def vegpatch_dem(s: Scene) -> DataFrame:
    return synthetic.vegpatch(s.spark, 64, 64, shift=5, half=10)


@query
def flat_dem(s: Scene) -> DataFrame:
    return synthetic.flat(s.spark, 16, 16)


def _relief(s: Scene) -> DataFrame:
    """Amounts on the scene's cells, none punched out: a rough surface full of pits."""
    items = adapter.read(s.spark, s.sf_dir, "lineitem")
    cells = items.groupBy((F.col("l_orderkey") % s.w).cast("int").alias("px"), (F.col("l_partkey") % s.w).cast("int").alias("py"))
    return cells.agg((F.sum(F.col("l_quantity").cast("long")) % 1000).cast("double").alias("v"))


@query
def filled_depressions(s: Scene) -> DataFrame:
    return _round(flow.fill_depressions(_relief(s), 0.01, 64), "v")


@query
def flow_accumulation(s: Scene) -> DataFrame:
    return _round(flow.flow_accumulation(flow.fill_depressions(_relief(s), 0.01, 64), s.grid, 64), "v")


def _mapped(s: Scene) -> DataFrame:
    return adapter.read(s.spark, s.sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50 / 10.0 - 137.5).alias("lon"), (F.col("c_custkey") % 300 / 10.0 + 40.0).alias("lat"))


@query
def projected_points(s: Scene) -> DataFrame:
    """Customers on the map in UTM and Albers metres."""
    c, out = _mapped(s), {}
    for name, p in (("albers", Albers()), ("utm", Utm(8))):
        x, y = p.forward(F.col("lon"), F.col("lat"))
        out |= {f"{name}_x": x, f"{name}_y": y}
    return _round(c.select("c_custkey", *[v.alias(k) for k, v in out.items()]), *out, places=3)


#: A grid in degrees over the scene, were it in zone 8.
DEGREES = Grid(-135.02, 0.0002, 50.03, -0.0002, 200, 120, "+proj=longlat +datum=WGS84")


@query
def warp_projected(s: Scene) -> DataFrame:
    """The surface, as if it lay in UTM zone 8, on a grid in degrees."""
    metres = Grid(499000.0, s.grid.dx, 5541000.0, s.grid.dy, s.w, s.w, Utm(8).crs)
    return raster.warp(s.spark, s.layer(), metres, DEGREES, between(DEGREES.crs, metres.crs))


@query
def projection_round_trip(s: Scene) -> DataFrame:
    """The largest error of forward and inverse over customers placed on the map, rounded to a tenth of a millidegree."""
    c = adapter.read(s.spark, s.sf_dir, "customer").select((F.col("c_custkey") % 50 / 10.0 - 137.5).alias("lon"), (F.col("c_custkey") % 300 / 10.0 + 40.0).alias("lat"))
    out = []
    for name, p in (("albers", Albers()), ("utm", Utm(8))):
        x, y = p.forward(F.col("lon"), F.col("lat"))
        lon, lat = p.inverse(F.col("x"), F.col("y"))
        back = c.withColumns({"x": x, "y": y}).select(F.abs(lon - F.col("lon")).alias("a"), F.abs(lat - F.col("lat")).alias("b"))
        out.append(back.agg(F.lit(name).alias("projection"), (F.round(F.max(F.greatest("a", "b")), 7) + 0.0).alias("error")).select("projection", "error"))
    return out[0].unionByName(out[1])
