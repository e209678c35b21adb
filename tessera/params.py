"""Checked parameters of the joins. Everything is checked on the driver, before any job starts."""

from __future__ import annotations

import math
import operator
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from numbers import Real
from typing import Any

import numpy as np

PRECISIONS = ("single", "double", "ultra")
#: Fixed by the semantics: a window with no more variation than this (sum of squared deviations) is flat.
FLAT = 1e-13
LEAST_TILE = 1024
KINDS = ("1nn_index", "1nn", "sum", "knn", "matrix")


def integer(value: Any, name: str) -> int:
    try:
        return operator.index(value)
    except TypeError:
        raise TypeError(f"{name} must be an integer") from None


def flag(value: Any, name: str) -> bool:
    if value is None:
        return False
    if not isinstance(value, (Real, np.bool_)):
        raise TypeError(f"{name} must be a boolean, a number or None")
    return bool(value)


def exclusion_radius(m: int) -> int:
    """A quarter of the window, rounded up: pairs of windows closer than that match trivially."""
    return -(-m // 4)


def one_of(*allowed: str) -> Callable[[Any, str], str]:
    def check(value: Any, name: str) -> str:
        if not isinstance(value, str):
            raise TypeError(f"{name} must be a string")
        if value not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        return value

    return check


def correlation(value: Any, name: str) -> float:
    if not isinstance(value, Real):
        raise TypeError(f"{name} must be a real number")
    if not (math.isfinite(value) and -1 <= value <= 1):
        raise ValueError(f"{name} must be finite and between -1 and 1")
    return float(value)


def no_devices(value: Any, name: str) -> None:
    try:
        devices = [integer(x, "a GPU's number") for x in value]
    except TypeError:
        raise TypeError(f"{name} must be a sequence of integers") from None
    if devices:
        raise ValueError("no GPU is available to Spark here")


def call(value: Any, name: str) -> Callable | None:
    if value is not None and not callable(value):
        raise TypeError(f"{name} must be callable")
    return value


@dataclass(frozen=True)
class Option:
    """What an option may be: its reader, its least value, and the joins that take it."""

    name: str
    default: Any
    read: Callable[[Any, str], Any]
    least: int | None = None
    kinds: tuple[str, ...] = KINDS
    two_series: bool = False
    or_none: bool = False

    def check(self, value: Any) -> Any:
        if self.or_none and value is None:
            return None
        value = self.read(value, self.name)
        if self.least is not None and value < self.least:
            raise ValueError(f"{self.name} must be at least {self.least}")
        return value


WINDOW, COUNT = Option("m", None, integer, 3), Option("k", None, integer, 1)
OPTIONS = (
    Option("pearson", False, flag),
    Option("precision", "double", one_of(*PRECISIONS)),
    Option("plan", "auto", one_of("auto", "catalyst", "tiles")),
    Option("verbose", False, flag),
    Option("progress", None, call),
    Option("gpus", None, no_devices),
    Option("threads", 0, integer, 0),
    Option("max_tile_size", None, integer, LEAST_TILE),
    Option("exclusion_zone", None, integer, 0, or_none=True),
    Option("threshold", 0.0, correlation, kinds=("sum", "knn", "matrix")),
    Option("mheight", 50, integer, 1, ("matrix",)),
    Option("mwidth", 50, integer, 1, ("matrix",)),
    Option("allow_trivial_match", True, flag, two_series=True),
    Option("col_offset", 0, integer, two_series=True),
    Option("row_offset", 0, integer, two_series=True),
)


@dataclass(frozen=True)
class JoinParams:
    kind: str
    m: int
    self_join: bool
    pearson: bool = False
    precision: str = "double"
    threshold: float = 0.0
    k: int = 0
    mheight: int = 50
    mwidth: int = 50
    aligned: bool = False
    exclusion: int = 0
    col_offset: int = 0
    row_offset: int = 0
    max_tile_size: int | None = None
    verbose: bool = False
    plan: str = "auto"
    both_axes: bool = False
    progress: Callable[[int, int], None] | None = field(default=None, compare=False)

    @staticmethod
    def of(kind: str, m: Any, self_join: bool, options: dict[str, Any], k: Any = None) -> JoinParams:
        if self_join and "allow_trivial_match" in options:
            raise ValueError("allow_trivial_match is for joins of two series; a self join never matches trivially")
        open_to = {o.name for o in OPTIONS if kind in o.kinds and not (self_join and o.two_series)}
        for name in sorted(options):
            if name not in open_to:
                raise ValueError(f"unknown argument: {name}")
        given: dict[str, Any] = {"m": WINDOW.check(m)}
        if k is not None:
            given["k"] = COUNT.check(k)
        for o in OPTIONS:
            given[o.name] = o.check(options[o.name]) if o.name in options else o.default
        tile, zone = given["max_tile_size"], given.pop("exclusion_zone")
        if tile is not None and tile < 2 * given["m"]:
            raise ValueError("max_tile_size must be at least twice the window")
        aligned = not (given.pop("allow_trivial_match") or self_join)
        given["exclusion"] = zone if zone is not None else exclusion_radius(given["m"]) if self_join or aligned else 0
        for accepted in ("gpus", "threads"):
            del given[accepted]
        return JoinParams(kind, self_join=self_join, aligned=aligned, **given)

    def with_(self, **changes: Any) -> JoinParams:
        return replace(self, **changes)
