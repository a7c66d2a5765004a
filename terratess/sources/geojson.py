"""GeoJSON features."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.functions.projections import Geographic
from terratess.sources.files import ordered, write_file

#: How deep coordinates are nested.
DEPTH = {"LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features ``(fid, gtype, parts, props)``; rings and lines are parts, polygons of a collection follow one another."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("fid", "f"))
    c = F.col("f.geometry.coordinates")
    deep = {n: F.from_json(c, "array<" * (n + 1) + "double" + ">" * (n + 1)) for n in (1, 2, 3)}
    by = F.when(F.col("f.geometry.type") == "LineString", F.array(deep[1]))
    by = by.when(F.col("f.geometry.type").isin("MultiLineString", "Polygon"), deep[2]).when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(deep[3]))
    parts = F.transform(by, lambda line: F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.select(F.col("fid").cast("long").alias("fid"), F.col("f.geometry.type").alias("gtype"), parts.alias("parts"), F.col("f.properties").alias("props"))


def read_crs(spark: SparkSession, path: str) -> str:
    """The coordinate system that the file names, else geographic degrees, as the format has it."""
    named = spark.read.schema("crs struct<properties: struct<name: string>>").json(path, multiLine=True).select("crs.properties.name").first()
    return (named and named["name"]) or Geographic().crs


def write_geojson(path: str, features: DataFrame, crs: str = "") -> None:
    """Lines and polygons as a feature collection, in order of id."""

    def parts():
        named = f'"crs": {json.dumps({"type": "name", "properties": {"name": crs}})}, ' if crs else ""
        yield f'{{"type": "FeatureCollection", {named}"features": [\n'.encode()
        for k, r in enumerate(ordered(features, "fid")):
            lines = [[[p.x, p.y] for p in part] for part in r.parts]
            shape = lines[0] if DEPTH[r.gtype] == 1 else lines if DEPTH[r.gtype] == 2 else [[x] for x in lines]
            yield (",\n" if k else "").encode() + json.dumps({"type": "Feature", "properties": dict(r.props or {}), "geometry": {"type": r.gtype, "coordinates": shape}}).encode()
        yield b"\n]}\n"

    write_file(features.sparkSession, path, parts())
