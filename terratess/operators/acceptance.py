"""Acceptance of triangles: cheap geometry first, raster errors for the survivors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terratess.functions.geometry import area_on, min_sine2
from terratess.model import Grid
from terratess.operators.metrics import errors
from terratess.operators.spatial import TILE, corners

IMPERATIVELY_BAD, BAD, NOT_BAD = "IMPERATIVELY_BAD", "BAD", "NOT_BAD"
#: Least squared sine of the smallest angle, about 20.7 degrees.
LEAST_SINE2 = 0.125


@dataclass(frozen=True)
class Layer:
    """A raster constraint: ``metric`` at most ``tolerance``, or ``cover`` at least ``tolerance``; None accepts every value."""

    metric: str
    tolerance: float | None
    weight: float = 0.0


@dataclass(frozen=True)
class Criteria:
    max_area: float
    min_area: float
    layers: dict[str, Layer] = field(default_factory=dict)
    #: Refine every triangle to ``min_area``.
    uniform: bool = False
    #: With weights a triangle passes if its satisfied layers weigh at least this.
    weight_threshold: float | None = None

    @property
    def tested(self) -> dict[str, Layer]:
        return {n: x for n, x in self.layers.items() if x.tolerance is not None}


def topography_weight(weights: dict[str, float]) -> float:
    """What the other layers leave for the surface: 1 less their sum."""
    rest = 1 - sum(weights.values())
    if rest < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must be positive and sum to at most 1")
    return rest


def measured(elem: DataFrame, vertex: DataFrame, grid: Grid) -> DataFrame:
    """Triangles with corners, ``area`` in square metres and ``sine2``."""
    t = corners(elem, vertex)
    xy = [F.col(c) for k in range(3) for c in (f"x{k}", f"y{k}")]
    return t.withColumns({"area": area_on(grid)(*xy), "sine2": F.coalesce(min_sine2(*xy), F.lit(0.0))})


def cheap(criteria: Criteria) -> Column:
    """What area and angle decide; null if the rasters must."""
    rest = F.lit(BAD) if criteria.uniform else F.lit(None).cast("string")
    return F.when(F.col("area") > criteria.max_area, IMPERATIVELY_BAD).when(F.col("sine2") < LEAST_SINE2, BAD).when(F.col("area") <= criteria.min_area, NOT_BAD).otherwise(rest)


def strict(criteria: Criteria) -> Column:
    """Every layer must hold; a value equal to its tolerance fails."""
    ok = F.lit(True)
    for n, x in criteria.tested.items():
        v = F.col(f"{n}_{x.metric}")
        ok = ok & ((v > x.tolerance) if x.metric == "cover" else (v < x.tolerance))
    return F.when(ok, NOT_BAD).otherwise(BAD)


def score(criteria: Criteria) -> Column:
    """The weight of satisfied layers; a value equal to its tolerance holds, a layer without one counts in full."""
    total = F.lit(0.0)
    for n, x in criteria.layers.items():
        if x.tolerance is None:
            total = total + F.lit(float(x.weight))
        else:
            v = F.col(f"{n}_{x.metric}")
            total = total + F.when((v >= x.tolerance) if x.metric == "cover" else (v <= x.tolerance), F.lit(float(x.weight))).otherwise(F.lit(0.0))
    return total


def badness(elem: DataFrame, vertex: DataFrame, cells: DataFrame, grid: Grid, criteria: Criteria, tile: int = TILE) -> DataFrame:
    """``(tri, area, sine2, badness)`` and, for triangles that area and angle leave open, their errors (and ``alpha`` with weights)."""
    t = measured(elem, vertex, grid).select("tri", "v0", "v1", "v2", "area", "sine2").withColumn("_cheap", cheap(criteria))
    layers = {n: x.metric for n, x in criteria.tested.items()}
    slim = t.select("tri", "area", "sine2", "_cheap")
    if criteria.uniform or not layers:
        return slim.select("tri", "area", "sine2", F.coalesce("_cheap", F.lit(NOT_BAD)).alias("badness"))
    open_ = t.where("_cheap is null").select("tri", "v0", "v1", "v2")
    found = errors(open_, vertex, cells, grid, layers, tile)
    if criteria.weight_threshold is None:
        found = found.withColumn("_full", strict(criteria))
    else:
        found = found.withColumn("alpha", score(criteria)).withColumn("_full", F.when(F.col("alpha") >= criteria.weight_threshold, NOT_BAD).otherwise(BAD))
    return slim.join(found, "tri", "left").withColumn("badness", F.coalesce("_cheap", "_full")).drop("_cheap", "_full")


def refinement_order(bad: DataFrame, metrics: list[str]) -> DataFrame:
    """Worst first: largest area, then smallest angle, then largest error; ties by id."""
    worst = [F.col(m) for m in metrics]
    most = F.coalesce(F.greatest(*worst) if len(worst) > 1 else worst[0], F.lit(0.0)) if worst else F.lit(0.0)
    return bad.orderBy(F.desc("area"), "sine2", most.desc(), "tri")
