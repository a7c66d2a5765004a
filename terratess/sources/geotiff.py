"""Single-band GeoTIFF: uncompressed or deflated strips and tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terratess.functions.projections import known
from terratess.model import NODATA, RASTER_CELLS, Grid
from terratess.sources.files import ordered, ranges, write_file
from terratess.staging import release, stage

Window = tuple[int, int, int, int]
_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


class Tiff:
    """One raster; ``read`` gives the bytes of a range of its file, so the header costs a few kilobytes."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 8)
        self.order = "<" if head[:2] == b"II" else ">"
        if struct.unpack_from(self.order + "H", head, 2)[0] != 42:
            raise ValueError("not a classic TIFF")
        at = struct.unpack_from(self.order + "I", head, 4)[0]
        count = struct.unpack(self.order + "H", read(at, 2))[0]
        table = read(at + 2, 12 * count)
        self.tags: dict[int, tuple] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(self.order + "HHI", table, 12 * k)
            if kind not in _SIZES:
                continue
            form = self.order + _SIZES[kind] * n if kind != 2 else f"{n}s"
            size = struct.calcsize(form)
            raw = table[12 * k + 8 : 12 * k + 12]
            self.tags[tag] = struct.unpack(form, raw[:size] if size <= 4 else read(struct.unpack(self.order + "I", raw)[0], size))
        self.width, self.height = self.tags[256][0], self.tags[257][0]
        text = lambda tag: self.tags[tag][0].split(b"\0")[0].decode("latin-1") if tag in self.tags else ""
        self.nodata = float(text(42113)) if text(42113).strip() else None
        self.crs = self._crs(text(34737).split("|")[0])
        scale, tie = self.tags.get(33550, (1.0, 1.0, 0.0)), self.tags.get(33922, (0.0,) * 6)
        self.grid = Grid(tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1], self.width, self.height, self.crs)
        if 34264 in self.tags:
            m = self.tags[34264]
            self.grid = Grid.of((m[3], m[0], m[1], m[7], m[4], m[5]), self.width, self.height, self.crs)

    def _crs(self, named: str) -> str:
        """The coded system of a projected or geographic raster where its name says nothing that is known."""
        keys = self.tags.get(34735, ())
        coded = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        code = next((coded[k] for k in (3072, 2048) if 0 < coded.get(k, 0) < 32767), None)
        return f"EPSG:{code}" if code and not known(named) else named

    def blocks(self, window: Window | None = None) -> Iterator[tuple[int, int, np.ndarray]]:
        """(px, py, values) of each strip or tile, in order; with a window (px0, py0, w, h) only of those that it meets."""
        if self.tags.get(277, (1,))[0] != 1:
            raise ValueError("only rasters of one band")
        kind = np.dtype(self.order + _KINDS[(self.tags.get(339, (1,))[0], self.tags[258][0])])
        packed = self.tags.get(259, (1,))[0]
        if packed not in (1, 8, 32946) or self.tags.get(317, (1,))[0] not in (1, 2):
            raise ValueError("only uncompressed or deflated TIFF")
        tiled = 322 in self.tags
        w, h = (self.tags[322][0], self.tags[323][0]) if tiled else (self.width, min(self.tags.get(278, (self.height,))[0], self.height))
        across = -(-self.width // w)
        for k, (at, n) in enumerate(zip(self.tags[324 if tiled else 273], self.tags[325 if tiled else 279])):
            x, y = k % across * w, k // across * h
            if window and not (x < window[0] + window[2] and window[0] < x + w and y < window[1] + window[3] and window[1] < y + h):
                continue
            raw = self.read(at, n)
            v = np.frombuffer(zlib.decompress(raw) if packed != 1 else raw, dtype=kind)
            v = v[: len(v) // w * w].reshape(-1, w)
            if self.tags.get(317, (1,))[0] == 2:
                v = np.cumsum(v, axis=1, dtype=kind)
            yield x, y, v[: self.height - y, : self.width - x]


def read_grid(spark: SparkSession, path: str, require_crs: bool = True) -> Grid:
    """The grid of one file; its header is read, not its cells."""
    grid = Tiff(ranges(spark, path)).grid
    return grid.require_crs() if require_crs else grid


def read_cells(spark: SparkSession, path: str, window: Window | None = None) -> DataFrame:
    """Valid cells of all files at ``path``: ``(raster_id, px, py, v)``; with a window (px0, py0, w, h) only its cells, and only the blocks that it meets are decoded.

    A file is one task's and at most 2 GB, as Spark reads it whole; large rasters are kept as many files.
    """

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(content.as_buffer())
                t = Tiff(lambda at, n, data=data: bytes(data[at : at + n]))
                for x, y, v in t.blocks(window):
                    v = v.astype(np.float64)
                    ok = ~np.isnan(v) & (v != NODATA)
                    if t.nodata is not None:
                        ok &= v != t.nodata
                    if window:
                        px, py = np.arange(v.shape[1]) + x, np.arange(v.shape[0]) + y
                        ok &= ((px >= window[0]) & (px < window[0] + window[2]))[None, :] & ((py >= window[1]) & (py < window[1] + window[3]))[:, None]
                    rows, columns = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array((columns + x).astype(np.int32)), pa.array((rows + y).astype(np.int32)), pa.array(v[ok])], ["raster_id", "px", "py", "v"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RASTER_CELLS)


def read_window(cells: DataFrame, px0: int, py0: int, w: int, h: int) -> DataFrame:
    """Cells of one window; on stored cells the filter reaches the scan."""
    return cells.where(F.col("px").between(px0, px0 + w - 1) & F.col("py").between(py0, py0 + h - 1))


def _packed(width: int, kind: str):
    """Rows of cells sorted by (py, px) as deflated strips."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        at, row = None, np.zeros(0)

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(row.astype("<" + kind).tobytes())], pa.binary())], ["py", "strip"])

        for batch in batches:
            px, py, v = (np.asarray(c) for c in batch.columns)
            cuts = np.flatnonzero(np.diff(py)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(py)]):
                if a == b:
                    continue
                if at != py[a]:
                    if at is not None:
                        yield done()
                    at, row = int(py[a]), np.full(width, NODATA)
                row[px[a:b]] = v[a:b]
        if at is not None:
            yield done()

    return run


def write_geotiff(path: str, cells: DataFrame, grid: Grid, value: str = "v", kind: str = "f4") -> None:
    """Cells as one deflated file, a strip per row; missing cells hold nodata.

    Strips are packed in tasks; the driver passes them on one by one and holds their sizes.
    """
    spark = cells.sparkSession
    rows = cells.where(F.col(value).isNotNull()).select("px", "py", F.col(value).cast("double").alias("v"))
    strips = stage(rows.repartition("py").sortWithinPartitions("py", "px").mapInArrow(_packed(grid.width, kind), "py int, strip binary"), "strips")
    blank = zlib.compress(np.full(grid.width, NODATA).astype("<" + kind).tobytes())
    held = strips.agg(F.coalesce(F.sum(F.octet_length("strip")), F.lit(0)).alias("n"), F.count("*").alias("rows")).first()
    start = 8 + held["n"] + (grid.height - held["rows"]) * len(blank)
    sizes: list[int] = []

    def parts() -> Iterator[bytes]:
        yield struct.pack("<2sHI", b"II", 42, start)
        for r in ordered(strips, "py"):
            while len(sizes) < r.py:
                sizes.append(len(blank))
                yield blank
            sizes.append(len(r.strip))
            yield bytes(r.strip)
        while len(sizes) < grid.height:
            sizes.append(len(blank))
            yield blank
        yield _directory(grid, kind, sizes, start)

    write_file(spark, path, parts())
    release(strips)


def _directory(grid: Grid, kind: str, sizes: list[int], start: int) -> bytes:
    """The directory that stands behind the strips."""
    at = 8 + np.concatenate([[0], np.cumsum(sizes)])
    crs = (grid.crs + "|").encode("latin-1", "replace") + b"\0"
    keys = (1, 1, 0, 2, 1024, 0, 1, 2 if grid.geographic else 1, 1026, 34737, len(crs) - 1, 0)
    tags = [
        (256, 4, (grid.width,)), (257, 4, (grid.height,)), (258, 3, (8 * np.dtype(kind).itemsize,)), (259, 3, (8,)), (262, 3, (1,)), (273, 4, tuple(int(x) for x in at[:-1])),
        (277, 3, (1,)), (278, 4, (1,)), (279, 4, tuple(sizes)), (339, 3, ({"u": 1, "i": 2, "f": 3}[kind[0]],)),
        (33550, 12, (grid.dx, -grid.dy, 0.0)), (33922, 12, (0.0, 0.0, 0.0, grid.ulx, grid.uly, 0.0)), (34735, 3, keys), (34737, 2, (crs,)), (42113, 2, (b"-9999\0",)),
    ]
    extra_at, table, extra = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, t, values in tags:
        raw = values[0] if t == 2 else struct.pack("<" + _SIZES[t] * len(values), *values)
        n = len(raw) if t == 2 else len(values)
        if len(raw) <= 4:
            table += struct.pack("<HHI", tag, t, n) + raw.ljust(4, b"\0")
        else:
            table += struct.pack("<HHII", tag, t, n, extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<H", len(tags)) + table + struct.pack("<I", 0) + extra
