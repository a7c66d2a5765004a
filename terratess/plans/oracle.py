"""DuckDB SQL for the engine's queries."""

from __future__ import annotations

from terratess.functions.projections import E1, E2, FLATTENING, A
from terratess.plans.adapter import CTES, DX, DY, ULX, ULY
from terratess.plans.queries import CRITERIA, DEGREES


def _q(body: str, ctes: str = "") -> str:
    return f"WITH RECURSIVE {CTES.strip()}{', ' + ctes.strip() if ctes else ''} {body.strip()}"


def _zonal(aggregates: str, fill: str | None = None) -> str:
    return _q(f"SELECT tri, {fill or 's.* EXCLUDE (tri)'} FROM elem LEFT JOIN (SELECT tri, {aggregates} FROM hit GROUP BY tri) s USING (tri)" if fill else f"SELECT e.tri, s.* EXCLUDE (tri) FROM elem e LEFT JOIN (SELECT tri, {aggregates} FROM hit GROUP BY tri) s USING (tri)")


_MODE = "(SELECT tri, arg_min(lc, (-n, lc)) AS mode FROM (SELECT tri, lc, count(*) AS n FROM hit GROUP BY tri, lc) GROUP BY tri)"

_SHAPE = """
edge2 AS (
    SELECT tri, (x1 - x2) ** 2 + (y1 - y2) ** 2 AS a, (x0 - x2) ** 2 + (y0 - y2) ** 2 AS b, (x0 - x1) ** 2 + (y0 - y1) ** 2 AS c,
        (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) AS twice FROM triangle),
shape AS (SELECT tri, abs(twice) / 2 AS area, twice * twice / nullif(greatest(a, b, c) * (a + b + c - greatest(a, b, c) - least(a, b, c)), 0) AS sine2 FROM edge2)
"""

_CORNERS = """
cosines AS (
    SELECT tri,
        ((x1 - x0) * (x2 - x0) + (y1 - y0) * (y2 - y0)) / (sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) * sqrt((x2 - x0) ** 2 + (y2 - y0) ** 2)) AS a,
        ((x2 - x1) * (x0 - x1) + (y2 - y1) * (y0 - y1)) / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) * sqrt((x0 - x1) ** 2 + (y0 - y1) ** 2)) AS b,
        ((x0 - x2) * (x1 - x2) + (y0 - y2) * (y1 - y2)) / (sqrt((x0 - x2) ** 2 + (y0 - y2) ** 2) * sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) AS c
    FROM triangle),
turned AS (SELECT tri, degrees(acos(a)) AS a, degrees(acos(b)) AS b, degrees(acos(c)) AS c FROM cosines)
"""

_PLANE = """
normal AS (
    SELECT *, (py1 - py0) * (z2 - z0) - (py2 - py0) * (z1 - z0) AS pa, (px2 - px0) * (z1 - z0) - (px1 - px0) * (z2 - z0) AS pb,
        (px1 - px0) * (py2 - py0) - (px2 - px0) * (py1 - py0) AS pc FROM sampled),
gap AS (
    SELECT n.tri, -(pa * h.px + pb * h.py - (pa * px0 + pb * py0 + pc * z0)) / nullif(pc, 0)::DOUBLE - h.z AS gap FROM normal n JOIN hit h USING (tri)),
flat AS (SELECT tri, sqrt(avg(gap * gap)) AS rmse, max(abs(gap)) AS most FROM gap GROUP BY tri)
"""

_COVER = """
shares AS (SELECT tri, max(n) / sum(n)::DOUBLE AS share FROM (SELECT tri, lc, count(*) AS n FROM hit GROUP BY tri, lc) GROUP BY tri),
cover AS (
    SELECT tri, CASE WHEN (lc0 IS NULL AND lc1 IS NULL AND lc2 IS NULL) OR share IS NULL THEN 1.0
        WHEN NOT coalesce(lc0 = lc1 AND lc1 = lc2, false) THEN 0.0 ELSE share END::DOUBLE AS lc_cover FROM sampled LEFT JOIN shares USING (tri))
"""

_FALLBACK = """
found AS (
    SELECT v.vid, v.x, v.y, coalesce(v.z, (SELECT avg(d.z) FROM dem d WHERE abs(d.px - v.px) <= 1 AND abs(d.py - v.py) <= 1)) AS z FROM at_vertex v)
"""

_JUDGED = _SHAPE + "," + _PLANE + "," + _COVER + f"""
, judged AS (
    SELECT s.tri, s.area, coalesce(s.sine2, 0) AS sine2, coalesce(f.rmse, 0) AS rmse, c.lc_cover,
        CASE WHEN area > 9800 THEN 'IMPERATIVELY_BAD' WHEN coalesce(sine2, 0) < 0.125 THEN 'BAD' WHEN area <= 7000 THEN 'NOT_BAD' END AS cheap,
        CASE WHEN coalesce(f.rmse, 0) < {CRITERIA['rmse']} AND lc_cover > {CRITERIA['cover']} THEN 'NOT_BAD' ELSE 'BAD' END AS full_,
        (CASE WHEN coalesce(f.rmse, 0) <= {CRITERIA['rmse']} THEN 0.5 ELSE 0 END + CASE WHEN lc_cover >= {CRITERIA['cover']} THEN 0.25 ELSE 0 END + 0.25)::DOUBLE AS alpha
    FROM shape s LEFT JOIN flat f USING (tri) JOIN cover c USING (tri))
"""

_EDGES = """
edge AS (
    SELECT tri, slot, least(a, b) AS a, greatest(a, b) AS b FROM (
        SELECT tri, 0 AS slot, v1 AS a, v2 AS b FROM elem UNION ALL SELECT tri, 1, v2, v0 FROM elem UNION ALL SELECT tri, 2, v0, v1 FROM elem)),
near AS (SELECT e.tri, e.slot, coalesce(f.tri, -1) AS n FROM edge e LEFT JOIN edge f ON e.a = f.a AND e.b = f.b AND e.tri <> f.tri),
link AS (SELECT tri AS i, slot, n AS j FROM near WHERE n <> -1)
"""

_COARSE = f"""
coarse AS (SELECT (w * 16 // 40)::INTEGER AS n FROM size),
spread AS (
    SELECT z, lc, ({ULX} + px * {DX} - {ULX + 8}) / 40.0::DOUBLE AS xa, ({ULX} + (px + 1) * {DX} - {ULX + 8}) / 40.0::DOUBLE AS xb,
        ({ULY} + py * ({DY}) - {ULY - 4}) / (-40.0)::DOUBLE AS ya, ({ULY} + (py + 1) * ({DY}) - {ULY - 4}) / (-40.0)::DOUBLE AS yb FROM dem),
targets AS (SELECT unnest(range(n))::INTEGER AS px, n FROM coarse),
target AS (SELECT a.px, b.px AS py FROM targets a, targets b),
part AS (
    SELECT t.px, t.py, s.z, s.lc, (least(xb, t.px + 1) - greatest(xa, t.px)) * (least(yb, t.py + 1) - greatest(ya, t.py)) AS w
    FROM spread s JOIN target t ON xa < t.px + 1 AND xb > t.px AND ya < t.py + 1 AND yb > t.py)
"""

_GRIDS = """
axis AS (SELECT unnest(range(w))::INTEGER AS k FROM size), cell AS (SELECT a.k AS px, b.k AS py FROM axis a, axis b)
"""

_LINE = """
line AS (SELECT o_custkey AS fid, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INTEGER AS seq, o_totalprice AS x, o_orderkey::DOUBLE AS y FROM orders)
"""

_RING = [(1050.0, 89950.0), (1700.0, 89900.0), (1400.0, 89600.0), (1650.0, 89300.0), (1080.0, 89350.0)]


def _crossed() -> str:
    """How many edges of the ring lie to the left of a cell's centre."""
    cx, cy = f"({ULX} + (px + 0.5) * {DX})", f"({ULY} + (py + 0.5) * ({DY}))"
    edges = zip(_RING, _RING[1:] + _RING[:1])
    return " + ".join(f"CASE WHEN ({a[1]} > {cy}) <> ({b[1]} > {cy}) AND {a[0]} + ({cy} - {a[1]}) / ({b[1] - a[1]}) * ({b[0] - a[0]}) < {cx} THEN 1 ELSE 0 END" for a, b in edges)


def _regions(value: str) -> str:
    return f"""
here AS (SELECT px, py, {value} AS v, py::BIGINT * 4294967296 + px AS id FROM dem),
runs AS (
    SELECT *, max(CASE WHEN fresh THEN id END) OVER (PARTITION BY py ORDER BY px) AS run FROM (
        SELECT *, coalesce(px <> lag(px) OVER w + 1 OR v <> lag(v) OVER w, true) AS fresh FROM here WINDOW w AS (PARTITION BY py ORDER BY px))),
pairs AS (SELECT DISTINCT a.run AS a, b.run AS b FROM runs a JOIN runs b ON a.px = b.px AND abs(a.py - b.py) = 1 AND a.v = b.v),
reach(run, root) USING KEY (run) AS (
    SELECT DISTINCT run, run FROM runs
    UNION
    SELECT p.b, min(r.root) FROM reach r JOIN pairs p ON p.a = r.run JOIN recurring.reach o ON o.run = p.b WHERE r.root < o.root GROUP BY p.b)
"""


_MAPPED = "mapped AS (SELECT c_custkey, c_custkey % 50 / 10.0::DOUBLE - 137.5 AS lon, c_custkey % 300 / 10.0::DOUBLE + 40.0 AS lat FROM customer)"


def _utm(lon: str, lat: str, zone: int, source: str) -> str:
    """Transverse Mercator: the conformal latitude, then Krueger's series."""
    n = FLATTENING / (2 - FLATTENING)
    a = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    radius = 0.9996 * A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    d = lambda v: f"{v!r}::DOUBLE"
    add = lambda f, g, first: " + ".join([first, *[f"{d(c)} * {f}({2 * k} * xi) * {g}({2 * k} * eta)" for k, c in enumerate(a, 1)]])
    return f"""
utm1 AS (SELECT *, sinh(atanh(sin(radians({lat}))) - {d(E1)} * atanh({d(E1)} * sin(radians({lat})))) AS t, radians({lon} - ({6 * zone - 183})) AS lam FROM {source}),
utm2 AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM utm1),
utm AS (SELECT *, 500000 + {d(radius)} * ({add('cos', 'sinh', 'eta')}) AS utm_x, {d(radius)} * ({add('sin', 'cosh', 'xi')}) AS utm_y FROM utm2)"""


def _albers(lon: str, lat: str, source: str) -> str:
    """The equal-area cone between two parallels, by the textbook formulas, constants and all in SQL."""
    e, e2, s = f"{E1!r}::DOUBLE", f"{E2!r}::DOUBLE", lambda v: f"sin(radians({v}))"
    q = lambda v: f"((1 - {e2}) * ({s(v)} / (1 - {e2} * {s(v)} ** 2) - ln((1 - {e} * {s(v)}) / (1 + {e} * {s(v)})) / (2 * {e})))"
    m = lambda v: f"(cos(radians({v})) / sqrt(1 - {e2} * {s(v)} ** 2))"
    return f"""
cone1 AS (SELECT ({m('20.0::DOUBLE')} ** 2 - {m('60.0::DOUBLE')} ** 2) / ({q('60.0::DOUBLE')} - {q('20.0::DOUBLE')}) AS n),
cone2 AS (SELECT n, {m('20.0::DOUBLE')} ** 2 + n * {q('20.0::DOUBLE')} AS c FROM cone1),
cone AS (SELECT n, c, {A!r}::DOUBLE * sqrt(c - n * {q('40.0::DOUBLE')}) / n AS rho0 FROM cone2),
albers AS (SELECT o.*, {A!r}::DOUBLE * sqrt(c - n * {q(lat)}) / n * sin(n * radians({lon} + 96)) AS albers_x, rho0 - {A!r}::DOUBLE * sqrt(c - n * {q(lat)}) / n * cos(n * radians({lon} + 96)) AS albers_y FROM {source} o, cone)"""


_CENTRES = f"""
target AS (SELECT px::INTEGER AS px, py::INTEGER AS py, {DEGREES.ulx}::DOUBLE + (px + 0.5) * {DEGREES.dx}::DOUBLE AS lon, {DEGREES.uly}::DOUBLE + (py + 0.5) * ({DEGREES.dy}::DOUBLE) AS lat
    FROM range({DEGREES.width}) a(px), range({DEGREES.height}) b(py))
"""

#: Mollweide metres of the mesh's vertices, were they degrees; the auxiliary angle by Newton steps.
_EQUAL_AREA = """
degree AS (SELECT vid, (x - 1000) / 100000 - 120 AS lon, (y - 90000) / 100000 + 50 AS lat FROM vertex),
angle AS (
    SELECT vid, lon, list_reduce(list_prepend(radians(lat), list_transform(range(12), lambda k: radians(lat))),
        lambda t, phi: t - (2 * t + sin(2 * t) - pi() * sin(phi)) / (2 + 2 * cos(2 * t))) AS t FROM degree),
equal AS (SELECT vid, 2 * sqrt(2.0::DOUBLE) / pi() * 6378137.0::DOUBLE * radians(lon) * cos(t) AS x, sqrt(2.0::DOUBLE) * 6378137.0::DOUBLE * sin(t) AS y FROM angle)
"""

#: Cubic B-spline weights of the 4 x 4 cells around centres of cells half as wide.
_SPLINE = """
fine AS (SELECT px::INTEGER AS px, py::INTEGER AS py, (px + 0.5::DOUBLE) / 2 - 0.5 AS u, (py + 0.5::DOUBLE) / 2 - 0.5 AS v FROM size, range(2 * w) a(px), range(2 * w) b(py)),
offsets AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(-1, 3) a(i), range(-1, 3) b(j)),
near AS (
    SELECT f.px, f.py, d.z, abs(u - d.px) AS dx, abs(v - d.py) AS dy FROM fine f, offsets o JOIN dem d ON d.px = floor(f.u)::INTEGER + o.i AND d.py = floor(f.v)::INTEGER + o.j),
weighed AS (
    SELECT px, py, z, CASE WHEN dx < 1 THEN (4 - 6 * dx ** 2 + 3 * dx ** 3) / 6 ELSE (2 - dx) ** 3 / 6 END * CASE WHEN dy < 1 THEN (4 - 6 * dy ** 2 + 3 * dy ** 3) / 6 ELSE (2 - dy) ** 3 / 6 END AS w FROM near)
"""


#: Heights spread inwards from cells beside missing ones, always the lowest way.
_FLOOD = """
relief AS (SELECT (l_orderkey % w)::INTEGER AS px, (l_partkey % w)::INTEGER AS py, (sum(l_quantity::BIGINT) % 1000)::DOUBLE AS z FROM lineitem, size GROUP BY ALL),
step AS (SELECT i::INTEGER AS i, j::INTEGER AS j FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i <> 0 OR j <> 0),
beside AS (SELECT a.px, a.py, b.px AS qx, b.py AS qy, b.z AS qz FROM relief a, step s JOIN relief b ON b.px = a.px + s.i AND b.py = a.py + s.j),
rim AS (SELECT r.px, r.py, r.z FROM relief r LEFT JOIN beside b USING (px, py) GROUP BY ALL HAVING count(b.qx) < 8),
flood(px, py, w) USING KEY (px, py) AS (
    SELECT px, py, z FROM rim
    UNION
    SELECT b.qx, b.qy, min(greatest(b.qz, f.w + 0.01::DOUBLE)) FROM flood f JOIN beside b ON b.px = f.px AND b.py = f.py LEFT JOIN recurring.flood o ON o.px = b.qx AND o.py = b.qy
    WHERE o.w IS NULL OR greatest(b.qz, f.w + 0.01::DOUBLE) < o.w GROUP BY b.qx, b.qy)
"""


ORACLES: dict[str, str] = {
    "filled_depressions": _q("SELECT px, py, round(w, 6) AS v FROM flood", _FLOOD),
    "geographic_area": _q("SELECT tri, round(abs((b.x - a.x) * (c.y - a.y) - (c.x - a.x) * (b.y - a.y)) / 2, 1) AS area FROM elem JOIN equal a ON a.vid = v0 JOIN equal b ON b.vid = v1 JOIN equal c ON c.vid = v2", _EQUAL_AREA),
    "smooth": _q("SELECT px, py, round(sum(w * z) / sum(w), 6) AS v FROM weighed WHERE w > 0 GROUP BY px, py", _SPLINE),
    "projected_points": f"WITH {_MAPPED}, {_utm('lon', 'lat', 8, 'mapped')}, {_albers('lon', 'lat', 'utm')} SELECT c_custkey, round(albers_x, 3) AS albers_x, round(albers_y, 3) AS albers_y, round(utm_x, 3) AS utm_x, round(utm_y, 3) AS utm_y FROM albers",
    "warp_projected": _q("SELECT u.px, u.py, d.z AS v FROM utm u JOIN dem d ON d.px = floor((utm_x - 499000) / 16)::INTEGER AND d.py = floor((utm_y - 5541000) / -16)::INTEGER", _CENTRES + "," + _utm("lon", "lat", 8, "target")),
    "zonal_mean": _zonal("round(avg(z), 6) AS mean"),
    "zonal_min": _zonal("min(z) AS min"),
    "zonal_max": _zonal("max(z) AS max"),
    "zonal_mode": _q(f"SELECT tri, mode FROM elem LEFT JOIN {_MODE} USING (tri)"),
    "zonal_count": _q("SELECT tri, coalesce(n, 0) AS n_cells FROM elem LEFT JOIN (SELECT tri, count(z) AS n FROM hit GROUP BY tri) USING (tri)"),
    "zonal_all": _q(f"SELECT e.tri, z_mean, z_min, z_max, mode AS lc_mode, q_mean, coalesce(n, 0) AS n FROM elem e LEFT JOIN (SELECT tri, round(avg(z), 6) AS z_mean, min(z) AS z_min, max(z) AS z_max, round(avg(q), 6) AS q_mean, count(z) AS n FROM hit GROUP BY tri) USING (tri) LEFT JOIN {_MODE} USING (tri)"),
    "zonal_multi_classified": _q(f"SELECT tri, CASE WHEN mode = 1 AND height >= 50000 THEN 3.0 WHEN mode = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS class FROM elem LEFT JOIN (SELECT tri, avg(z) AS height FROM hit GROUP BY tri) USING (tri) LEFT JOIN {_MODE} USING (tri)"),
    "zonal_user_method": _zonal("max(z) - min(z) AS spread"),
    "classifier_callable": _q(f"SELECT tri, CASE WHEN height IS NULL OR height > 5000 THEN 0 ELSE mode + 1 END::DOUBLE AS class FROM elem LEFT JOIN (SELECT tri, min(z) AS height FROM hit GROUP BY tri) USING (tri) LEFT JOIN {_MODE} USING (tri)"),
    "tri_area": _q("SELECT tri, area FROM shape", _SHAPE),
    "tri_min_sine2": _q("SELECT tri, round(sine2, 6) AS sine2 FROM shape", _SHAPE),
    "tri_angles": _q("SELECT tri, round(least(a, b, c), 6) AS min_angle, round(greatest(a, b, c), 6) AS max_angle FROM turned", _CORNERS),
    "tri_elevation": _q("SELECT tri, round((a.z + b.z + c.z) / 3, 6) AS elevation FROM elem JOIN found a ON a.vid = v0 JOIN found b ON b.vid = v1 JOIN found c ON c.vid = v2", _FALLBACK),
    "tri_window": _q("SELECT tri, greatest(trunc(least(gx0, gx1, gx2)), 0)::INTEGER AS px0, (least(trunc(greatest(gx0, gx1, gx2)) + 1, w) - 1)::INTEGER AS px1, greatest(trunc(least(gy0, gy1, gy2)), 0)::INTEGER AS py0, (least(trunc(greatest(gy0, gy1, gy2)) + 1, w) - 1)::INTEGER AS py1 FROM triangle, size"),
    "plane_rmse": _q("SELECT tri, round(coalesce(rmse, 0), 6) AS z_rmse FROM elem LEFT JOIN flat USING (tri)", _PLANE),
    "plane_max_diff": _q("SELECT tri, round(coalesce(most, 0), 6) AS z_max_tol FROM elem LEFT JOIN flat USING (tri)", _PLANE),
    "mean_tolerance": _q("SELECT tri, round(coalesce(abs((coalesce(z0, 0) + coalesce(z1, 0) + coalesce(z2, 0)) / nullif((z0 IS NOT NULL)::INTEGER + (z1 IS NOT NULL)::INTEGER + (z2 IS NOT NULL)::INTEGER, 0) - m), 0), 6) AS z_mean_tol FROM sampled LEFT JOIN (SELECT tri, avg(z) AS m FROM hit GROUP BY tri) USING (tri)"),
    "category_cover": _q("SELECT tri, round(lc_cover, 6) AS lc_cover FROM cover", _COVER),
    "category_histogram": _q("SELECT tri, lc AS category, count(*) AS n FROM hit GROUP BY tri, lc"),
    "report_rmse": _q("SELECT tri, round(rmse, 6) AS rmse FROM elem LEFT JOIN flat USING (tri)", _PLANE),
    "badness_strict": _q("SELECT tri, coalesce(cheap, full_) AS badness FROM judged", _JUDGED),
    "badness_weighted": _q("SELECT tri, coalesce(cheap, CASE WHEN alpha >= 0.75 THEN 'NOT_BAD' ELSE 'BAD' END) AS badness, CASE WHEN cheap IS NULL THEN alpha END AS alpha FROM judged", _JUDGED),
    "badness_uniform": _q("SELECT tri, coalesce(cheap, 'BAD') AS badness FROM judged", _JUDGED),
    "refinement_queue": _q("SELECT tri, area, row_number() OVER (ORDER BY area DESC, round(sine2, 9), tri)::INTEGER AS place FROM judged WHERE coalesce(cheap, full_) <> 'NOT_BAD'", _JUDGED),
    "point_extract": _q("SELECT vid, px, py, z FROM at_vertex"),
    "point_extract_fallback": _q("SELECT vid, round(z, 6) AS z FROM found", _FALLBACK),
    "mesh_neighbors": _q("SELECT tri, max(CASE WHEN slot = 0 THEN n END) AS n0, max(CASE WHEN slot = 1 THEN n END) AS n1, max(CASE WHEN slot = 2 THEN n END) AS n2 FROM near GROUP BY tri", _EDGES),
    "mesh_bandwidth": _q("SELECT greatest(0, max(j - i))::BIGINT AS bandwidth FROM link", _EDGES),
    "mesh_density": _q("SELECT count(*) AS nnz, count(*)::DOUBLE / ((SELECT count(*) FROM elem)::DOUBLE * (SELECT count(*) FROM elem)) AS density FROM link", _EDGES),
    "mesh_adjacency": _q("SELECT i, j, ((row_number() OVER (ORDER BY i, slot) - 1) % 2 + 1)::INTEGER AS value FROM link", _EDGES),
    "partition_order": _q("SELECT tri, (tri % 30 // 10)::INTEGER AS part, row_number() OVER (ORDER BY tri % 30 // 10, tri) - 1 AS position FROM elem"),
    "permuted_bandwidth": _q(
        "SELECT 'before' AS \"when\", greatest(0, max(j - i))::BIGINT AS bandwidth FROM link UNION ALL SELECT 'after', greatest(0, max(b.position - a.position))::BIGINT FROM link JOIN place a ON a.tri = i JOIN place b ON b.tri = j",
        _EDGES + ", place AS (SELECT tri, row_number() OVER (ORDER BY tri % 3, tri) - 1 AS position FROM elem)",
    ),
    "param_merge": _q(f"SELECT tri, mode AS kind, height, amount FROM elem LEFT JOIN {_MODE} USING (tri) LEFT JOIN (SELECT tri, max(z) AS height, max(q) AS amount FROM hit GROUP BY tri) USING (tri)"),
    "param_length_check": _q("SELECT 3::BIGINT AS n_tables, min(n) AS least, max(n) AS most, min(n) = max(n) AS equal FROM (SELECT count(*) AS n FROM elem UNION ALL SELECT count(*) FROM elem WHERE tri % 7 <> 0 UNION ALL SELECT count(*) FROM vertex)"),
    "param_long": _q("SELECT tri, 'height' AS key, height AS value FROM both_ UNION ALL SELECT tri, 'amount', amount FROM both_", "both_ AS (SELECT e.tri, min(z) AS height, max(q) AS amount FROM elem e LEFT JOIN hit h ON e.tri = h.tri GROUP BY e.tri)"),
    "cells_vs_triangles": _q("SELECT c AS n_cells, t AS n_triangles, round(t * 100.0::DOUBLE / c, 2) AS percent FROM (SELECT count(*) AS c FROM dem), (SELECT count(*) AS t FROM elem)"),
    "mesh_report": _q("SELECT tri, round(rmse, 6) AS error, area, round(least(a, b, c), 6) AS min_angle, round(greatest(a, b, c), 6) AS max_angle FROM shape JOIN turned USING (tri) LEFT JOIN flat USING (tri)", _SHAPE + "," + _CORNERS + "," + _PLANE),
    "resample_average": _q("SELECT px, py, round(sum(w * z) / sum(w), 6) AS v FROM part GROUP BY px, py", _COARSE),
    "resample_mode": _q("SELECT px, py, arg_min(lc, (-w, lc))::DOUBLE AS v FROM (SELECT px, py, lc, sum(w) AS w FROM part GROUP BY px, py, lc) GROUP BY px, py", _COARSE),
    "fill_nodata": _q(
        "SELECT px, py, round(z, 6) AS v FROM dem UNION ALL SELECT c.px, c.py, round(sum(d.z / r2) / sum(1.0 / r2), 6) FROM (SELECT c.*, d.z, ((c.px - d.px) ** 2 + (c.py - d.py) ** 2)::DOUBLE AS r2 FROM cell c ANTI JOIN dem USING (px, py) JOIN dem d ON abs(c.px - d.px) <= 2 AND abs(c.py - d.py) <= 2 AND (c.px - d.px) ** 2 + (c.py - d.py) ** 2 <= 4) GROUP BY 1, 2".replace("SELECT c.px, c.py, round(sum(d.z / r2)", "SELECT px, py, round(sum(z / r2)").replace("SELECT c.*, d.z,", "SELECT c.px, c.py, d.z,"),
        _GRIDS,
    ),
    "extent_subset": _q(f"SELECT px, py, z AS v FROM dem WHERE {ULX} + (px + 0.5) * {DX} BETWEEN 1100 AND 1500 AND {ULY} + (py + 0.5) * ({DY}) BETWEEN 89500 AND 89900"),
    "mask_cells": _q("SELECT px, py, 1 AS mask FROM dem"),
    "count_valid": _q("SELECT count(z) AS n_cells FROM dem"),
    "clip_polygon": _q(f"SELECT px, py, z AS v FROM dem WHERE ({_crossed()}) % 2 = 1"),
    "warp_shift": _q(f"SELECT t.px, t.py, d.z AS v FROM target t JOIN dem d ON d.px = floor(({ULX + 8} + (t.px + 0.5) * 40 - {ULX}) / {DX})::INTEGER AND d.py = floor(({ULY - 4} - (t.py + 0.5) * 40 - {ULY}) / ({DY}))::INTEGER", _COARSE),
    "components": _q("SELECT px, py, root AS component FROM runs JOIN reach USING (run)", _regions("lc % 2")),
    "largest_component": _q(f"SELECT component, n_cells, n_cells * {DX * -DY}::DOUBLE AS area FROM (SELECT root AS component, count(*) AS n_cells FROM runs JOIN reach USING (run) GROUP BY root) ORDER BY n_cells DESC, component LIMIT 1", _regions("1")),
    "polygon_areas": _q(f"SELECT root AS component, count(*) * {DX * -DY}::DOUBLE AS area FROM runs JOIN reach USING (run) GROUP BY root", _regions("lc % 2")),
    "longest_line": _q("SELECT l.* FROM line l JOIN (SELECT fid FROM line GROUP BY fid ORDER BY count(*) DESC, fid LIMIT 1) USING (fid)", _LINE),
    "pslg_segments": _q("SELECT vid AS sid, vid AS v0, CASE WHEN vid = (SELECT max(vid) FROM v) THEN 0 ELSE vid + 1 END AS v1 FROM v", _LINE + ", v AS (SELECT (row_number() OVER (ORDER BY fid, seq) - 1)::INTEGER AS vid FROM line)"),
    "constraint_segments": _q("SELECT * FROM (SELECT fid, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM line WINDOW w AS (PARTITION BY fid ORDER BY seq)) WHERE x1 IS NOT NULL", _LINE),
    "merged_constraints": _q("SELECT dense_rank() OVER (ORDER BY fid % 2, fid) - 1 AS fid, seq, round(x, 5) AS x, round(y, 5) AS y FROM line", _LINE),
    "ridge_dem": "SELECT px::INTEGER AS px, py::INTEGER AS py, round(2 * 300.0::DOUBLE / (1 + ((py - 32.0::DOUBLE) / 60.0) ** 2) - 300, 6) AS v FROM range(64) a(px), range(64) b(py)",
    "gauss_dem": "SELECT px::INTEGER AS px, py::INTEGER AS py, round(2 * 1000.0::DOUBLE * exp(-4 * ln(2.0::DOUBLE) * ((px - 32) ** 2 + (py - 24) ** 2) / 256.0) - 1000, 6) AS v FROM range(64) a(px), range(64) b(py)",
    "vegpatch_dem": "SELECT px::INTEGER AS px, py::INTEGER AS py, CASE WHEN py - 37 >= -10 AND py - 37 < 10 AND px - 37 >= -10 AND px - 37 < 10 THEN 100 ELSE 1 END::DOUBLE AS v FROM range(64) a(px), range(64) b(py)",
    "flat_dem": "SELECT px::INTEGER AS px, py::INTEGER AS py, 1000.0::DOUBLE AS v FROM range(16) a(px), range(16) b(py)",
    "projection_round_trip": "SELECT * FROM (VALUES ('albers', 0.0::DOUBLE), ('utm', 0.0::DOUBLE)) t(projection, error)",
}
