"""Polygons and polylines: components, selection, simplification, clipping, planar graphs.

Points are rows ``(fid, part, seq, x, y)`` wherever possible; kernels that walk a
line in order do so over sorted batches of many lines and hold one line at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terratess.functions.projections import between, same
from terratess.model import Grid
from terratess.operators.batched import by_group
from terratess.operators.components import components
from terratess.operators.numbering import numbered
from terratess.operators.offset import offset_rings
from terratess.staging import stage


def exploded(features: DataFrame) -> DataFrame:
    """Features to points: every part of a collection becomes a line of its own, whatever its kind."""
    parts = features.select("fid", F.posexplode("parts").alias("part", "points"))
    return parts.select("fid", "part", F.posexplode("points").alias("seq", "p")).select("fid", "part", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def collected(points: DataFrame, gtype: str) -> DataFrame:
    """Points back to features."""
    rows = points.groupBy("fid", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("points"))
    parts = rows.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "points"))), lambda s: s["points"]).alias("parts"))
    return parts.select("fid", F.lit(gtype).alias("gtype"), "parts", F.create_map().cast("map<string,string>").alias("props"))


def reproject(points: DataFrame, source: str, target: str) -> DataFrame:
    """Points from one coordinate system to another; unchanged where they agree, an error where one is unknown."""
    if same(source, target):
        return points
    x, y = between(source, target)(F.col("x"), F.col("y"))
    return points.withColumns({"x": x, "y": y})


#: Links of runs that one task joins (16 bytes each); more are contracted in distributed rounds.
RUNS_IN_TASK = 2_000_000


def cell_components(cells: DataFrame, value: str = "v", in_task: int = RUNS_IN_TASK) -> DataFrame:
    """``(px, py, value, component)``: 4-connected regions of equal value, named by their smallest cell ``py << 32 | px``.

    Rows of cells are cut into runs of equal value; runs that touch in neighbouring
    rows are links, and links are contracted, so work and links grow with the
    number of runs, not with the size of a region.
    """
    row = Window.partitionBy("py").orderBy("px")
    new = F.coalesce((F.col("px") != F.lag("px").over(row) + 1) | (F.col(value) != F.lag(value).over(row)), F.lit(True))
    start = F.max(F.when(new, F.col("px"))).over(row.rowsBetween(Window.unboundedPreceding, 0))
    runs = stage(cells.where(F.col(value).isNotNull()).select("px", "py", value, (F.shiftleft(F.col("py").cast("long"), 32) + start).alias("run")), "runs")
    up = runs.select("px", (F.col("py") + 1).alias("py"), F.col(value).alias("_v"), F.col("run").alias("above"))
    links = runs.join(up, ["px", "py"]).where(F.col(value) == F.col("_v")).select(F.col("above").alias("a"), F.col("run").alias("b")).distinct()
    label = components(links, in_task).withColumnRenamed("node", "run")
    return runs.join(label, "run", "left").select("px", "py", value, F.coalesce("label", "run").alias("component"))


def component_areas(found: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    return found.groupBy("component").agg(F.first(value).alias(value), F.count("*").alias("n_cells")).withColumn("area", F.col("n_cells") * grid.cell_area)


def largest(table: DataFrame, by: str, key: str) -> DataFrame:
    """The row of the largest ``by``; of equals the first ``key``."""
    return table.orderBy(F.desc(by), key).limit(1)


def rings(found: DataFrame, grid: Grid) -> DataFrame:
    """Outlines of components as closed rings ``(fid, part, seq, x, y)``, the outer ring first (part 0), straight runs merged.

    Sides between a cell and a cell of another component are directed with the
    component on their right; tracing follows them per component. A task holds the
    outline of one component at a time, not its cells.
    """
    # each side of a cell is met once from either hand: a and b are the components left (or above) and right (or below) of it
    cell = found.select("px", "py", F.col("component").cast("long").alias("c"))
    side = lambda kind, i, j, hand: F.struct(F.lit(kind).alias("kind"), (F.col("px") + i).alias("x"), (F.col("py") + j).alias("y"), F.when(F.lit(hand == "a"), F.col("c")).alias("a"), F.when(F.lit(hand == "b"), F.col("c")).alias("b"))
    each = cell.select(F.inline(F.array(side(0, 1, 0, "a"), side(0, 0, 0, "b"), side(1, 0, 1, "a"), side(1, 0, 0, "b"))))
    met = each.groupBy("kind", "x", "y").agg(F.max("a").alias("a"), F.max("b").alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))
    x, y, upright = F.col("x"), F.col("y"), F.col("kind") == 0
    end = lambda component, ax, ay, bx, by: F.struct(F.col(component).alias("fid"), ax.cast("int").alias("ax"), ay.cast("int").alias("ay"), bx.cast("int").alias("bx"), by.cast("int").alias("by"))
    one, none = F.lit(1), F.lit(0)
    first = end("a", F.when(upright, x).otherwise(x + one), y + none, x + none, F.when(upright, y + one).otherwise(y))
    second = end("b", x + none, F.when(upright, y + one).otherwise(y), F.when(upright, x).otherwise(x + one), y + none)
    every = met.select(F.inline(F.array(first, second))).where("fid is not null")

    def trace(group: list[np.ndarray]) -> list[np.ndarray]:
        after: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for ax, ay, bx, by in zip(*(c[::-1].tolist() for c in group[1:])):
            after.setdefault((ax, ay), []).append((bx, by))
        out = []
        for start in sorted(after, key=lambda p: (p[1], p[0])):
            while after.get(start):
                ring, at, came = [start], start, None
                while True:
                    ways = after[at]
                    # where two corners meet, turn right so that 4-connected regions stay apart
                    if came is not None and len(ways) > 1:
                        ways.sort(key=lambda q: came[0] * (q[1] - at[1]) - came[1] * (q[0] - at[0]))
                    to = ways.pop()
                    came, at = (to[0] - at[0], to[1] - at[1]), to
                    if at == start:
                        break
                    ring.append(at)
                n = len(ring)
                ring = [p for k, p in enumerate(ring) if (p[0] - ring[k - 1][0]) * (ring[(k + 1) % n][1] - p[1]) != (p[1] - ring[k - 1][1]) * (ring[(k + 1) % n][0] - p[0])]
                out.append([*ring, ring[0]])
        out.sort(key=lambda r: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))), reverse=True)
        sizes = [len(r) for r in out]
        xy = np.array([p for r in out for p in r], dtype=np.float64)
        seq = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return [np.full(len(xy), group[0][0]), np.repeat(np.arange(len(out), dtype=np.int32), sizes), seq, grid.ulx + xy[:, 0] * grid.dx, grid.uly + xy[:, 1] * grid.dy]

    return by_group(every, ["fid"], ["ax", "ay", "bx", "by"], trace, "fid long, part int, seq int, x double, y double")


def polygonize(cells: DataFrame, grid: Grid, value: str = "v") -> DataFrame:
    return rings(cell_components(cells, value), grid)


def ring_areas(points: DataFrame) -> DataFrame:
    """Area of each ring by the shoelace formula; rings close themselves."""
    w = Window.partitionBy("fid", "part").orderBy("seq")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = F.coalesce(F.lead("x").over(w), F.first("x").over(whole)), F.coalesce(F.lead("y").over(w), F.first("y").over(whole))
    return points.withColumn("cross", F.col("x") * ny - nx * F.col("y")).groupBy("fid", "part").agg((F.abs(F.sum("cross")) / 2).alias("area"))


def longest_line(points: DataFrame) -> DataFrame:
    """The points of the line with most vertices over all parts; of equals the first."""
    sizes = points.groupBy("fid", "part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "fid", "part").limit(1)
    return points.join(F.broadcast(sizes.select("fid", "part")), ["fid", "part"], "left_semi")  # one row


def merged(*features: DataFrame) -> DataFrame:
    """Points of several constraints together; feature ids continue."""
    out = None
    for k, f in enumerate(features):
        f = f.withColumn("source", F.lit(k))
        out = f if out is None else out.unionByName(f)
    ids = numbered(out.select("source", "fid").distinct(), [F.col("source").asc(), F.col("fid").asc()], "id")
    return out.join(ids, ["source", "fid"]).select(F.col("id").cast("long").alias("fid"), "part", "seq", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def boundary_graph(line: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A closed line ``(seq, x, y)`` as vertices ``(vid, x, y)`` and segments ``(sid, v0, v1)``; a repeated last point is dropped and the loop is closed. Points are numbered by ranges of ``seq``."""
    placed = numbered(line.select("seq", "x", "y"), [F.col("seq").asc()], "vid")
    end = lambda f: f(F.struct("vid", "x", "y"))
    ends = placed.agg(end(F.min).alias("a"), end(F.max).alias("b")).first()
    a, b = ends["a"], ends["b"]
    if a is None:
        vertex = placed.select(F.col("vid").cast("int").alias("vid"), "x", "y")
        return vertex, vertex.select(F.col("vid").alias("sid"), F.col("vid").alias("v0"), F.col("vid").alias("v1"))
    last = b["vid"] - (b["vid"] > 0 and (a["x"], a["y"]) == (b["x"], b["y"]))
    vertex = placed.where(F.col("vid") <= last).select(F.col("vid").cast("int").alias("vid"), "x", "y")
    segment = vertex.select(F.col("vid").alias("sid"), F.col("vid").alias("v0"), F.when(F.col("vid") == last, F.lit(0)).otherwise(F.col("vid") + 1).cast("int").alias("v1"))
    return vertex, segment


def constraint_segments(points: DataFrame) -> DataFrame:
    """Open polylines as segments ``(fid, part, seq, x0, y0, x1, y1)``."""
    w = Window.partitionBy("fid", "part").orderBy("seq")
    return points.select("fid", "part", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")


_LINES = "fid long, part int, seq int, x double, y double"


def _points(points: DataFrame) -> DataFrame:
    kinds = {"fid": "long", "part": "int", "seq": "int", "x": "double", "y": "double"}
    return points.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def douglas_peucker(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points stay; the first and last always do. A closed ring is split at the point farthest from its start."""
    keep = np.zeros(len(xy), dtype=bool)
    if not len(xy):
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    if len(xy) > 3 and (xy[0] == xy[-1]).all():
        far = int(((xy - xy[0]) ** 2).sum(axis=1).argmax())
        keep[far] = True
        todo = [(0, far), (far, len(xy) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d, rel = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        t = np.clip(rel @ d / max(d @ d, 1e-300), 0, 1)
        gap = np.sqrt(((rel - t[:, None] * d) ** 2).sum(axis=1))
        k = int(gap.argmax())
        if gap[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return keep


def simplify(points: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on every line; a line that collapses to a point is an error, as no boundary would be left."""

    def run(group: list[np.ndarray]) -> list[np.ndarray]:
        xy = np.column_stack(group[3:5])
        out = xy[douglas_peucker(xy, tolerance)]
        if len(out) > 1 and (out == out[0]).all():
            raise ValueError("the tolerance leaves no geometry")
        return [np.full(len(out), group[0][0]), np.full(len(out), group[1][0]), np.arange(len(out), dtype=np.int32), out[:, 0], out[:, 1]]

    return by_group(_points(points), ["fid", "part"], ["seq"], run, _LINES)


def buffer(points: DataFrame, distance: float) -> DataFrame:
    """Every ring moved outwards by ``distance`` (inwards if negative): ``(fid, part, seq, x, y)`` with the rings that it falls into as parts, the largest first; rings that vanish give no rows."""

    def run(group: list[np.ndarray]) -> list[np.ndarray] | None:
        found = offset_rings(np.column_stack(group[3:5]), distance)
        if not found:
            return None
        sizes = [len(r) for r in found]
        xy = np.vstack(found)
        parts = np.repeat(np.arange(len(found), dtype=np.int32), sizes)
        return [np.full(len(xy), group[0][0]), parts, np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]), xy[:, 0], xy[:, 1], np.full(len(xy), group[1][0])]

    found = by_group(_points(points), ["fid", "part"], ["seq"], run, _LINES + ", source int")
    # parts of one feature are numbered through: those of its first ring before those of its next
    sizes = found.groupBy("fid", "source").agg((F.max("part") + 1).alias("n"))
    before = sizes.select("fid", "source", F.coalesce(F.sum("n").over(Window.partitionBy("fid").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("first"))
    return found.join(before, ["fid", "source"]).select("fid", (F.col("part") + F.col("first")).alias("part"), "seq", "x", "y")


def clip_lines(points: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Lines cut to the inside of one ring (a mesh domain's outline, a bounded list); each inner stretch is a part of its own."""
    r = np.array(ring, dtype=float)
    if not (r[0] == r[-1]).all():
        r = np.vstack([r, r[:1]])

    def inside(p) -> bool:
        a, b = r[:-1], r[1:]
        up = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
        x = a[up, 0] + (p[1] - a[up, 1]) / (b[up, 1] - a[up, 1]) * (b[up, 0] - a[up, 0])
        return bool((x > p[0]).sum() % 2)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        xy = group.sort_values(["part", "seq"])
        out, n = [], 0
        for _, line in xy.groupby("part", sort=True):
            p = line[["x", "y"]].to_numpy()
            held: list = []
            for a, b in zip(p, p[1:]):
                d, e = b - a, r[1:] - r[:-1]
                cross = d[0] * e[:, 1] - d[1] * e[:, 0]
                ok = cross != 0
                t = np.full(len(e), -1.0)
                s = np.full(len(e), -1.0)
                f = r[:-1] - a
                t[ok] = (f[ok, 0] * e[ok, 1] - f[ok, 1] * e[ok, 0]) / cross[ok]
                s[ok] = (f[ok, 0] * d[1] - f[ok, 1] * d[0]) / cross[ok]
                cuts = np.unique(np.concatenate([[0, 1], t[(t > 0) & (t < 1) & (s >= 0) & (s <= 1)]]))
                for u, v in zip(cuts, cuts[1:]):
                    if inside(a + (u + v) / 2 * d):
                        u_, v_ = a + u * d, a + v * d
                        if held and np.allclose(held[-1], u_, atol=1e-12, rtol=0):
                            held.append(v_)
                        else:
                            if held:
                                out += [(n, k, *q) for k, q in enumerate(held)]
                                n += 1
                            held = [u_, v_]
            if held:
                out += [(n, k, *q) for k, q in enumerate(held)]
                n += 1
        fid = int(group["fid"].iloc[0])
        return pd.DataFrame([(fid, *x) for x in out], columns=["fid", "part", "seq", "x", "y"]).astype({"part": "int32", "seq": "int32"})

    return points.select("fid", "part", "seq", "x", "y").groupBy("fid").applyInPandas(run, "fid long, part int, seq int, x double, y double")
