"""A raster and a mesh made from the test tables, the same in Spark and in SQL.

Cells: ``lineitem`` on (l_orderkey mod W, l_partkey mod W), a whole-number height
and a category; some cells are punched out as nodata. W grows with the square
root of the rows. Mesh: two triangles per 8 x 8 cells, inner vertices moved off the
grid by multiples of a quarter cell, so that all coordinates are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.model import Grid
from terratess.shipping import ship

BLOCK = 8
ULX, DX, ULY, DY = 1000.0, 16.0, 90000.0, -16.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def width(spark: SparkSession, sf_dir: str) -> int:
    """W; the count comes from file footers."""
    n = read(spark, sf_dir, "lineitem").count()
    return BLOCK * max(1, -int(-(n**0.5) // 32))


def grid(w: int) -> Grid:
    return Grid(ULX, DX, ULY, DY, w, w, "+proj=utm +zone=8 +datum=NAD83 +units=m")


def dem(spark: SparkSession, sf_dir: str, w: int) -> DataFrame:
    """``(px, py, z, lc, q)``: height, category, a second surface."""
    items = read(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    cells = items.groupBy((F.col("l_orderkey") % w).cast("int").alias("px"), (F.col("l_partkey") % w).cast("int").alias("py")).agg(
        (F.sum(cents) % 100000).cast("double").alias("z"), F.min("l_linenumber").alias("lc"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("q")
    )
    return cells.where((F.col("px") * 7 + F.col("py") * 13) % 11 != 0)


def vertices(spark: SparkSession, w: int) -> DataFrame:
    n = w // BLOCK
    bx, by = F.col("id") % (n + 1), F.floor(F.col("id") / (n + 1)).cast("long")
    move = lambda a, b: F.when((bx > 0) & (bx < n) & (by > 0) & (by < n), ((bx * a + by * b) % 5 - 2) * 0.75).otherwise(F.lit(0.0))
    x, y = F.lit(ULX) + (bx * BLOCK + move(37, 17)) * DX, F.lit(ULY) + (by * BLOCK + move(11, 29)) * DY
    return spark.range((n + 1) * (n + 1)).select(F.col("id").cast("int").alias("vid"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))


def elements(spark: SparkSession, w: int) -> DataFrame:
    n = w // BLOCK
    block = F.floor(F.col("id") / 2).cast("long")
    a = (F.floor(block / n).cast("long") * (n + 1) + block % n).cast("int")
    lower = F.col("id") % 2 == 1
    pick = lambda even, odd: F.when(lower, a + odd).otherwise(a + even).cast("int")
    return spark.range(2 * n * n).select(F.col("id").cast("int").alias("tri"), pick(0, n + 2).alias("v0"), pick(n + 1, 1).alias("v1"), pick(1, n + 1).alias("v2"))


#: The same tables for DuckDB.
CTES = f"""
size AS (SELECT ({BLOCK} * greatest(1, ceil(sqrt(count(*)) / 32)))::BIGINT AS w FROM lineitem),
dem AS (
    SELECT * FROM (
        SELECT (l_orderkey % w)::INTEGER AS px, (l_partkey % w)::INTEGER AS py, (sum(round(l_extendedprice * 100)::BIGINT) % 100000)::DOUBLE AS z,
            min(l_linenumber) AS lc, sum(l_quantity::BIGINT)::DOUBLE AS q
        FROM lineitem, size GROUP BY 1, 2)
    WHERE (px * 7 + py * 13) % 11 <> 0),
nodes AS (SELECT id, w // {BLOCK} AS n, id % (w // {BLOCK} + 1) AS ci, id // (w // {BLOCK} + 1) AS cj FROM size, (SELECT unnest(range((w // {BLOCK} + 1) * (w // {BLOCK} + 1))) AS id FROM size)),
moved AS (
    SELECT *, CASE WHEN ci > 0 AND ci < n AND cj > 0 AND cj < n THEN ((ci * 37 + cj * 17) % 5 - 2) * 0.75::DOUBLE ELSE 0 END AS mx,
        CASE WHEN ci > 0 AND ci < n AND cj > 0 AND cj < n THEN ((ci * 11 + cj * 29) % 5 - 2) * 0.75::DOUBLE ELSE 0 END AS my FROM nodes),
vertex AS (SELECT id::INTEGER AS vid, {ULX}::DOUBLE + (ci * {BLOCK} + mx) * {DX}::DOUBLE AS x, {ULY}::DOUBLE + (cj * {BLOCK} + my) * ({DY})::DOUBLE AS y FROM moved),
blocks AS (SELECT n, unnest(range(2 * n * n)) AS id FROM (SELECT w // {BLOCK} AS n FROM size)),
elem AS (
    SELECT id::INTEGER AS tri, CASE WHEN id % 2 = 1 THEN a + n + 2 ELSE a END::INTEGER AS v0, CASE WHEN id % 2 = 1 THEN a + 1 ELSE a + n + 1 END::INTEGER AS v1,
        CASE WHEN id % 2 = 1 THEN a + n + 1 ELSE a + 1 END::INTEGER AS v2
    FROM (SELECT id, n, (id // 2 // n) * (n + 1) + (id // 2) % n AS a FROM blocks)),
triangle AS (
    SELECT tri, v0, v1, v2, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, c.x AS x2, c.y AS y2,
        (a.x - {ULX}) / {DX} AS gx0, (a.y - {ULY}) / ({DY}) AS gy0, (b.x - {ULX}) / {DX} AS gx1, (b.y - {ULY}) / ({DY}) AS gy1, (c.x - {ULX}) / {DX} AS gx2, (c.y - {ULY}) / ({DY}) AS gy2
    FROM elem JOIN vertex a ON a.vid = v0 JOIN vertex b ON b.vid = v1 JOIN vertex c ON c.vid = v2),
side AS (SELECT *, sign((gx1 - gx0) * (gy2 - gy0) - (gx2 - gx0) * (gy1 - gy0)) AS s FROM triangle),
hit AS (
    SELECT t.tri, d.* FROM side t JOIN dem d
    ON d.px < greatest(gx0, gx1, gx2) AND d.px + 1 > least(gx0, gx1, gx2) AND d.py < greatest(gy0, gy1, gy2) AND d.py + 1 > least(gy0, gy1, gy2)
    AND {" AND ".join(f"greatest({', '.join(f's * ((gx{j} - gx{i}) * (d.py + {q} - gy{i}) - (gy{j} - gy{i}) * (d.px + {p} - gx{i}))' for p in (0, 1) for q in (0, 1))}) > 0" for i, j in ((0, 1), (1, 2), (2, 0)))}),
at_vertex AS (
    SELECT vid, x, y, px, py, z, lc, q FROM (
        SELECT vid, x, y, least(trunc((x - {ULX}) / {DX})::INTEGER, w::INTEGER - 1) AS px, least(trunc((y - {ULY}) / ({DY}))::INTEGER, w::INTEGER - 1) AS py FROM vertex, size)
    LEFT JOIN dem USING (px, py)),
sampled AS (
    SELECT e.*, {", ".join(f"{v}.{c} AS {c}{k}" for k, v in enumerate("abc") for c in ("px", "py", "z", "lc", "q"))}
    FROM elem e JOIN at_vertex a ON a.vid = v0 JOIN at_vertex b ON b.vid = v1 JOIN at_vertex c ON c.vid = v2)
"""


def sql(body: str) -> str:
    return f"WITH {CTES.strip()}, {body}" if not body.lstrip().upper().startswith("SELECT") else f"WITH {CTES.strip()} {body}"
