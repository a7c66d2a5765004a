"""Depressions and flow over rasters, tile by tile.

A tile is solved in one task with a ring of cells of its neighbours around it, and
tells them its own rim. Rounds go on until no rim changes; a round carries water one
tile further, so their number is that of tiles which the longest path crosses. A tile
bounds a task's memory, and between rounds tiles lie in the shared folder.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terratess.model import Grid
from terratess.staging import release, stage

TILE = 128
#: What a filled cell stands above the one it drains to.
EPSILON = 1e-5
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
#: Eight facets around a cell: a straight neighbour and the diagonal one beside it, as (row, column).
FACETS = [((0, 1), (-1, 1)), ((-1, 0), (-1, 1)), ((-1, 0), (-1, -1)), ((0, -1), (-1, -1)), ((0, -1), (1, -1)), ((1, 0), (1, -1)), ((1, 0), (1, 1)), ((0, 1), (1, 1))]

_STATE = "tx int, ty int, z binary, w binary"
_RIM = "tx int, ty int, i int, j int, strip binary"


def _array(raw: bytes, *shape: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.float64).reshape(shape)


def _strip(w: np.ndarray, i: int, j: int) -> np.ndarray:
    """The rim of a tile that its neighbour in direction (i, j) sees."""
    side = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}
    return w[side[i], side[j]]


def _ringed(w: np.ndarray, rims: pd.DataFrame, tile: int, missing: float = math.nan) -> np.ndarray:
    """A tile with the rims of its neighbours around it; ``missing`` where there is none. A rim sent in direction (i, j) lies on the other side."""
    out = np.full((tile + 2, tile + 2), missing)
    out[1:-1, 1:-1] = w
    place = {-1: slice(tile + 1, tile + 2), 0: slice(1, tile + 1), 1: slice(0, 1)}
    for i, j, raw in rims[["i", "j", "strip"]].itertuples(index=False, name=None):
        out[place[i], place[j]] = _array(raw, *out[place[i], place[j]].shape)
    return out


def tiles(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """``(tx, ty, z)``: square blocks of cells, row by row, NaN where a cell is missing."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        z = np.full((tile, tile), np.nan)
        z[group["py"].to_numpy() % tile, group["px"].to_numpy() % tile] = group["v"]
        return pd.DataFrame({"tx": [int(group["tx"].iloc[0])], "ty": [int(group["ty"].iloc[0])], "z": [z.tobytes()]}).astype({"tx": "int32", "ty": "int32"})

    placed = cells.where(F.col("v").isNotNull() & ~F.isnan("v")).select(F.floor(F.col("px") / tile).cast("int").alias("tx"), F.floor(F.col("py") / tile).cast("int").alias("ty"), "px", "py", F.col("v").cast("double").alias("v"))
    return placed.groupBy("tx", "ty").applyInPandas(run, "tx int, ty int, z binary")


def untiled(state: DataFrame, column: str, tile: int) -> DataFrame:
    """Cells ``(px, py, v)`` of tiles, missing ones left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tx, ty, raw in batch.itertuples(index=False, name=None):
                v = _array(raw, tile, tile)
                py, px = np.nonzero(~np.isnan(v))
                yield pd.DataFrame({"px": (px + tx * tile).astype(np.int32), "py": (py + ty * tile).astype(np.int32), "v": v[py, px]})

    return state.select("tx", "ty", column).mapInPandas(run, "px int, py int, v double")


def _rims(state: DataFrame, column: str, cut: Callable[[np.ndarray, int, int], np.ndarray], shape: tuple[int, int]) -> DataFrame:
    """What each tile tells its eight neighbours."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(tx + j, ty + i, i, j, cut(_array(raw, *shape), i, j).tobytes()) for tx, ty, raw in batch.itertuples(index=False, name=None) for i, j in AROUND]
            yield pd.DataFrame(rows, columns=["tx", "ty", "i", "j", "strip"])

    return state.select("tx", "ty", column).mapInPandas(run, _RIM)


def _rounds(state: DataFrame, rims: Callable[[DataFrame], DataFrame], solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Solves all tiles against their neighbours' rims until none changes."""
    while True:
        told = rims(state).groupBy("tx", "ty")
        fresh = stage(state.groupBy("tx", "ty").cogroup(told).applyInPandas(solve, f"{schema}, changed boolean"), "tiles")
        release(state)
        if fresh.where("changed").isEmpty():
            return fresh.drop("changed")
        state = fresh.drop("changed")
        state._staged_path = fresh._staged_path


def filled_tile(z: np.ndarray, ring: np.ndarray, epsilon: float) -> np.ndarray:
    """The lowest surface over ``z`` on which every cell drains to an outlet or into the ring. Outlets stand beside missing cells; ring cells of infinite height are not yet reached."""
    n = len(z)
    w = np.where(np.isnan(z), np.nan, np.inf)
    queue: list[tuple[float, int, int]] = []
    gap = np.isnan(ring)
    beside = np.zeros((n, n), dtype=bool)
    for i, j in AROUND:
        beside |= gap[1 + i : n + 1 + i, 1 + j : n + 1 + j]
    for y, x in zip(*np.nonzero(beside & ~np.isnan(z))):
        w[y, x] = z[y, x]
        queue.append((float(z[y, x]), int(y), int(x)))
    for y in range(-1, n + 1):
        for x in range(-1, n + 1) if y in (-1, n) else (-1, n):
            if math.isfinite(h := ring[y + 1, x + 1]):
                queue.append((float(h), y, x))
    heapq.heapify(queue)
    heights, out = z.tolist(), w.tolist()
    while queue:
        h, y, x = heapq.heappop(queue)
        if 0 <= y < n and 0 <= x < n and out[y][x] < h:
            continue
        for i, j in AROUND:
            a, b = y + i, x + j
            if 0 <= a < n and 0 <= b < n and out[a][b] == math.inf:
                level = max(heights[a][b], h + epsilon)
                out[a][b] = level
                heapq.heappush(queue, (level, a, b))
    return np.array(out)


def fill_depressions(cells: DataFrame, epsilon: float = EPSILON, tile: int = TILE) -> DataFrame:
    """``cells (px, py, v)`` raised to where each drains, by steps of at least ``epsilon``, over the rim of the valid cells. Missing cells stay missing."""

    def solve(state: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
        if not len(state):  # a neighbour that has no valid cell
            return pd.DataFrame(columns=["tx", "ty", "z", "w", "changed"])
        z, w = (_array(state[c].iloc[0], tile, tile) for c in "zw")
        new = filled_tile(z, _ringed(w, rims, tile), epsilon)
        return state[["tx", "ty", "z"]].assign(w=[new.tobytes()], changed=[not np.array_equal(new, w, equal_nan=True)])

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(w=[np.where(np.isnan(_array(z, tile, tile)), np.nan, np.inf).tobytes() for z in batch["z"]])

    state = stage(tiles(cells, tile).mapInPandas(start, _STATE), "tiles")
    done = _rounds(state, lambda s: _rims(s, "w", _strip, (tile, tile)), solve, _STATE)
    return untiled(done, "w", tile)


def directions(w: np.ndarray, dx: float, dy: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each inner cell of a ringed tile the steepest way down over eight facets: places of its two receivers in the ringed tile, and the share of the first; -1 where nothing is lower or a facet lacks a cell."""
    m = len(w)
    e0 = w[1:-1, 1:-1]
    best, share = np.zeros_like(e0), np.ones_like(e0)
    first, second = np.full(e0.shape, -1), np.full(e0.shape, -1)
    own = np.arange(m * m).reshape(m, m)[1:-1, 1:-1]
    for (i1, j1), (i2, j2) in FACETS:
        e1, e2 = w[1 + i1 : m - 1 + i1, 1 + j1 : m - 1 + j1], w[1 + i2 : m - 1 + i2, 1 + j2 : m - 1 + j2]
        d1, d2 = (dx, dy) if i1 == 0 else (dy, dx)
        s1, s2 = (e0 - e1) / d1, (e1 - e2) / d2
        wide = math.atan2(d2, d1)
        r = np.arctan2(s2, s1)
        slope = np.hypot(s1, s2)
        slope = np.where(r < 0, s1, np.where(r > wide, (e0 - e2) / math.hypot(d1, d2), slope))
        r = np.clip(r, 0, wide)
        better = slope > best  # False for NaN
        best = np.where(better, slope, best)
        share = np.where(better, 1 - r / wide, share)
        first = np.where(better, own + i1 * m + j1, first)
        second = np.where(better, own + i2 * m + j2, second)
    return first, second, share


def accumulated(w: np.ndarray, inflow: np.ndarray, dx: float, dy: float) -> np.ndarray:
    """Cells that drain through each cell of a ringed tile, itself included, and in the ring what flows out of the tile; ``inflow`` comes from its neighbours."""
    m = len(w)
    first, second, share = directions(w, dx, dy)
    out = np.zeros((m, m))
    out[1:-1, 1:-1] = np.where(np.isnan(w[1:-1, 1:-1]), 0, 1 + inflow)
    flow = out.ravel().tolist()
    inner = np.arange(m * m).reshape(m, m)[1:-1, 1:-1].ravel()
    height = w[1:-1, 1:-1].ravel()
    order = np.argsort(-height, kind="stable")[: int((~np.isnan(height)).sum())]
    for k, a, b, p in zip(inner[order].tolist(), first.ravel()[order].tolist(), second.ravel()[order].tolist(), share.ravel()[order].tolist()):
        if a >= 0:
            flow[a] += flow[k] * p
            flow[b] += flow[k] * (1 - p)
    return np.array(flow).reshape(m, m)


def flow_accumulation(cells: DataFrame, grid: Grid, tile: int = TILE) -> DataFrame:
    """``(px, py, v)``: how many cells drain through each, itself included, by the two-receiver rule of infinite directions.

    ``cells`` should have no depressions (``fill_depressions``): water that reaches a
    cell without a lower neighbour stays there.
    """
    dx, dy = abs(grid.dx), abs(grid.dy)

    def ringed(state: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=["tx", "ty", "z", "w"])
        ring = _ringed(_array(state["z"].iloc[0], tile, tile), rims, tile)
        return state[["tx", "ty"]].assign(z=[ring.tobytes()], w=[np.zeros((tile + 2, tile + 2)).tobytes()])

    def solve(state: pd.DataFrame, rims: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame(columns=["tx", "ty", "z", "w", "changed"])
        z, old = (_array(state[c].iloc[0], tile + 2, tile + 2) for c in "zw")
        inflow = np.zeros((tile, tile))
        side = {-1: slice(-1, None), 0: slice(None), 1: slice(0, 1)}
        for i, j, raw in rims.sort_values(["i", "j"])[["i", "j", "strip"]].itertuples(index=False, name=None):
            inflow[side[i], side[j]] += _array(raw, *inflow[side[i], side[j]].shape)
        new = accumulated(z, inflow, dx, dy)
        return state[["tx", "ty", "z"]].assign(w=[new.tobytes()], changed=[not np.array_equal(new, old)])

    def outflow(w: np.ndarray, i: int, j: int) -> np.ndarray:
        side = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
        return w[side[i], side[j]]

    plain = stage(tiles(cells, tile), "tiles")
    state = stage(plain.groupBy("tx", "ty").cogroup(_rims(plain, "z", _strip, (tile, tile)).groupBy("tx", "ty")).applyInPandas(ringed, _STATE), "tiles")
    release(plain)
    done = _rounds(state, lambda s: _rims(s, "w", outflow, (tile + 2, tile + 2)), solve, _STATE)

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tx, ty, z, w in batch.itertuples(index=False, name=None):
                v = np.where(np.isnan(_array(z, tile + 2, tile + 2)), np.nan, _array(w, tile + 2, tile + 2))[1:-1, 1:-1]
                yield pd.DataFrame({"tx": [tx], "ty": [ty], "w": [v.tobytes()]}).astype({"tx": "int32", "ty": "int32"})

    return untiled(done.mapInPandas(inner, "tx int, ty int, w binary"), "w", tile)
