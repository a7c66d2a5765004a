"""Settings of a mesh run, checked before anything runs."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from terratess.functions.projections import Albers
from terratess.operators.acceptance import topography_weight
from terratess.operators.refine import MOST_VERTICES
from terratess.operators.zonal import METHODS

ERROR_METRICS = ("rmse", "mean_tol", "max_tol")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Parameter:
    """A raster, or several with a classifier, that gives a value per triangle."""

    file: str | tuple[str, ...]
    method: str | Callable | tuple = "mean"
    classifier: Callable | None = None
    tolerance: float | None = None
    weight: float | None = None
    drop: bool = False

    @property
    def files(self) -> tuple[str, ...]:
        return (self.file,) if isinstance(self.file, str) else tuple(self.file)

    @property
    def methods(self) -> tuple:
        return tuple(self.method) if isinstance(self.method, (tuple, list)) else (self.method,)

    @property
    def categorical(self) -> bool:
        return self.methods == ("mode",)

    def check(self, name: str) -> None:
        several = not isinstance(self.file, str)
        listed = isinstance(self.method, (tuple, list))
        rules = (
            (several and len(self.files) < 2, "a list of files needs at least two"),
            (several and self.classifier is None, "a list of files needs a classifier"),
            (several and self.tolerance is not None, "a list of files cannot have a tolerance"),
            (several and not listed, "a list of files needs a list of methods"),
            (not several and listed, "a single file has a single method"),
            (several and listed and len(self.files) != len(self.methods), "files and methods differ in number"),
            (any(not callable(m) and m not in METHODS for m in self.methods), f"unknown method; known are {', '.join(sorted(METHODS))}"),
            (self.weight is not None and self.weight < 0, "a weight must not be negative"),
            (self.categorical and self.tolerance is not None and not 0 <= self.tolerance <= 1, "the tolerance of a category is a fraction"),
        )
        for broken, what in rules:
            if broken:
                raise ConfigError(f"{name}: {what}")


@dataclass(frozen=True)
class Constraint:
    """Lines; ``crs`` where the file does not say its own."""

    file: str
    simplify: float | None = None
    crs: str | None = None


@dataclass(frozen=True)
class Config:
    dem_filename: str
    max_area: float
    max_tolerance: float | None = None
    min_area: float | None = None
    errormetric: str = "rmse"
    parameter_files: dict[str, Parameter] = field(default_factory=dict)
    initial_conditions: dict[str, Parameter] = field(default_factory=dict)
    constraints: dict[str, Constraint] = field(default_factory=dict)
    simplify: bool = False
    simplify_tol: float = 10.0
    simplify_buffer: float = -10.0
    no_simplify_buffer: bool = False
    lloyd_itr: int = 0
    most_vertices: int = MOST_VERTICES
    reuse_mesh: bool = False
    fill_holes: bool = False
    fill_radius: int = 5
    do_smoothing: bool = False
    smoothing_scaling_factor: float = 2.0
    max_smooth_iter: int = 1
    do_cell_resize: bool = True
    use_input_prj: bool = True
    wkt_out: str = Albers().crs
    use_weights: bool | None = None
    weight_threshold: float = 0.5
    extent: tuple[float, float, float, float] | None = None
    clip_to_shp: str | None = None
    user_output_dir: str | None = None
    write_shp: bool = True
    write_vtu: bool = True
    verbose: bool = False

    def __post_init__(self) -> None:
        rules = (
            (not self.dem_filename, "dem_filename is required"),
            (not self.max_area or self.max_area <= 0, "max_area must be positive"),
            (self.min_area is not None and self.min_area <= 0, "min_area must be positive"),
            (self.max_tolerance is None, "max_tolerance is required; -1 refines every triangle to min_area"),
            (self.errormetric not in ERROR_METRICS, f"errormetric must be one of {', '.join(ERROR_METRICS)}"),
            (self.extent is not None and self.clip_to_shp is not None, "extent and clip_to_shp exclude each other"),
            (self.simplify_buffer > 0, "simplify_buffer must not be positive"),
            (self.lloyd_itr < 0 or self.max_smooth_iter < 0, "iterations must not be negative"),
            (self.most_vertices < 3, "most_vertices must be 3 at least"),
            (not 0 <= self.weight_threshold <= 1, "weight_threshold is a fraction"),
            (not self.use_input_prj and not self.wkt_out, "wkt_out is required without use_input_prj"),
        )
        for broken, what in rules:
            if broken:
                raise ConfigError(what)
        for name, p in (self.parameter_files | self.initial_conditions).items():
            if name in ("area", "id", "tri"):
                raise ConfigError(f"{name} is a reserved name")
            p.check(name)
        if self.weighted:
            self.topo_weight  # noqa: B018  fails if weights exceed 1

    @property
    def uniform(self) -> bool:
        return self.max_tolerance == -1

    @property
    def weights(self) -> dict[str, float]:
        return {n: p.weight for n, p in self.parameter_files.items() if p.weight is not None}

    @property
    def weighted(self) -> bool:
        return bool(self.weights) if self.use_weights is None else self.use_weights

    @property
    def topo_weight(self) -> float:
        """What the parameters' weights leave for the surface."""
        try:
            return topography_weight(self.weights)
        except ValueError as e:
            raise ConfigError(str(e)) from e

    @property
    def output_dir(self) -> str:
        return self.user_output_dir or os.path.splitext(os.path.basename(self.dem_filename))[0]


def from_mapping(settings: dict[str, Any]) -> Config:
    """A config from plain values; unknown names are errors, and no file is executed."""
    known = {f.name for f in fields(Config)}
    if strange := sorted(set(settings) - known):
        raise ConfigError(f"unknown settings: {', '.join(strange)}")
    given = dict(settings)
    for key in ("parameter_files", "initial_conditions"):
        given[key] = {n: p if isinstance(p, Parameter) else Parameter(**{k: tuple(v) if isinstance(v, list) else v for k, v in p.items()}) for n, p in given.get(key, {}).items()}
    given["constraints"] = {n: c if isinstance(c, Constraint) else Constraint(**c) for n, c in given.get("constraints", {}).items()}
    missing = [f for f in ("dem_filename", "max_area") if f not in given]
    if missing:
        raise ConfigError(f"{missing[0]} is required")
    return Config(**given)
