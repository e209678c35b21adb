"""Choosing the block length by measurement, and a small file that remembers what was best.

For each workload (kind of profile, one series or two, length, window, precision) every candidate length runs a few
times; its result must equal that of a plain evaluation of the definition, and the one with the smallest median time is
stored under the session's cores and versions, of which each has at most ``MOST_OF_ONE`` records.
"""

from __future__ import annotations

import fcntl
import json
import os
import statistics
import tempfile
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict, dataclass

import numpy as np
import pyspark
from pyspark.sql import SparkSession

from .plans import tiles
from .params import JoinParams
from .sources.series import Series

MOST_RECORDS, MOST_OF_ONE, MOST_BYTES = 1024, 256, 4 << 20
TOLERANCE = {"single": 5e-4, "double": 1e-9}


@dataclass(frozen=True)
class AutotuneWorkload:
    kind: str
    windows: int
    m: int
    self_join: bool = True
    precision: str = "double"


@dataclass(frozen=True)
class AutotunePlan:
    mode: str
    workloads: tuple[AutotuneWorkload, ...]
    warm_ups: int
    trials: int


@dataclass(frozen=True)
class CandidateMeasurement:
    strategy: str
    seconds: tuple[float, ...]
    equal: bool

    @property
    def median(self) -> float:
        return statistics.median(self.seconds)


@dataclass(frozen=True)
class StrategyDescription:
    name: str
    tile: int
    text: str


def strategy_descriptions() -> tuple[StrategyDescription, ...]:
    return tuple(StrategyDescription(f"tiles-{n}", n, f"blocks of {n} windows") for n in (256, 512, 1024, 2048, 4096, 8192))


def autotune_plan(mode: str = "quick") -> AutotunePlan:
    if mode not in ("quick", "full"):
        raise ValueError("mode must be quick or full")
    kinds = ("1nn_index", "1nn", "sum", "knn", "matrix")
    sizes = ((512, 48),) if mode == "quick" else ((2000, 64), (8000, 64), (8000, 256))
    loads = tuple(AutotuneWorkload(k, n, m, one, p) for n, m in sizes for k in kinds for one in (True, False) for p in ("single", "double"))
    return AutotunePlan(mode, loads, 1, 3) if mode == "quick" else AutotunePlan(mode, loads, 2, 5)


def _path(cache_path: str) -> str:
    return cache_path or os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), "tessera", "tuning.json")


def _environment(spark: SparkSession) -> str:
    return f"cores={spark.sparkContext.defaultParallelism} spark={pyspark.__version__} numpy={np.__version__}"


@contextmanager
def _locked(path: str):
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(f"{path}.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def _read(path: str) -> dict:
    try:
        if os.path.getsize(path) > MOST_BYTES:
            return {}
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) and isinstance(found.get("records"), dict) else {}
    except (OSError, ValueError):
        return {}


def save_record(path: str, key: str, record: dict) -> None:
    """Adds a record; the file is replaced as a whole, under a lock, and keeps the newest records."""
    with _locked(path):
        records = _read(path).get("records", {})
        records.pop(key, None)
        records[key] = record
        own = [k for k in records if k.partition(" numpy")[0] == key.partition(" numpy")[0]]
        for old in own[:-MOST_OF_ONE]:
            del records[old]
        records = dict(list(records.items())[-MOST_RECORDS:])
        handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump({"version": 1, "records": records}, f)
        os.replace(name, path)


def lookup(spark: SparkSession, kind: str, windows: int, m: int, cache_path: str = "") -> int | None:
    """The stored block length for a workload of this size, by powers of two."""
    key = f"{_environment(spark)} {kind} n={windows.bit_length()} m={m.bit_length()}"
    record = _read(_path(cache_path)).get("records", {}).get(key)
    return record["tile"] if record else None


def autotune_status(cache_path: str = "") -> dict:
    path = _path(cache_path)
    return {"path": path, "exists": os.path.exists(path), "records": len(_read(path).get("records", {}))}


def reset_autotune(cache_path: str = "") -> bool:
    path = _path(cache_path)
    with _locked(path):
        if os.path.exists(path):
            os.unlink(path)
            return True
    return False


def _series(load: AutotuneWorkload) -> list[np.ndarray]:
    rng = np.random.default_rng(load.windows)
    made = [rng.normal(size=load.windows + load.m - 1).cumsum() for _ in range(1 if load.self_join else 2)]
    return [x.astype(np.float32).astype(float) if load.precision == "single" else x for x in made]


def _params(load: AutotuneWorkload) -> JoinParams:
    options = {"precision": load.precision} | ({"mheight": 10, "mwidth": 10} if load.kind == "matrix" else {})
    return JoinParams.of(load.kind, load.m, load.self_join, options, 3 if load.kind == "knn" else None)


def _execute(spark: SparkSession, load: AutotuneWorkload, tile: int) -> list[tuple]:
    """The result: tuples whose last entry is a correlation or None."""
    a, *b = (Series.from_values(spark, x).rows for x in _series(load))
    out = tiles.profile(a, b[0] if b else a, _params(load), tile, max(1, spark.sparkContext.defaultParallelism))
    value = "corr_sum" if load.kind == "sum" else "corr"
    keys = {"1nn_index": ("col_idx", "row_idx"), "1nn": ("col_idx",), "sum": ("col_idx",), "knn": ("col_idx", "rank", "row_idx"), "matrix": ("bin_row", "bin_col")}[load.kind]
    return sorted(out.select(*keys, value).toPandas().itertuples(index=False, name=None), key=lambda r: r[:-1])


def reference(load: AutotuneWorkload) -> list[tuple]:
    """The same by the definition: every pair's correlation, one column at a time, without tiles or recurrence."""
    p, (a, *b) = _params(load), _series(load)
    windows = [np.lib.stride_tricks.sliding_window_view(x, p.m) for x in (a, *b)]
    centred = [w - w.mean(1, keepdims=True) for w in windows]
    unit = [w / np.sqrt((w * w).sum(1, keepdims=True)) for w in centred]
    cols, rows = unit[0], unit[-1]
    out: list[tuple] = []
    cells = np.full((p.mheight, p.mwidth), np.nan)
    place = np.arange(len(rows))
    for i, z in enumerate(cols):
        c = np.clip(rows @ z, -1, 1)
        far = np.abs(place - i) >= p.exclusion if p.exclusion else np.ones(len(rows), bool)
        if load.kind == "matrix":
            far &= (place <= i) | (not p.self_join)
            if far.any():
                bins, j = place[far] * p.mheight // len(rows), i * p.mwidth // len(cols)
                np.fmax.at(cells[:, j], bins, c[far])
            continue
        order = place[far][np.lexsort((place[far], -np.round(c[far], 10)))]
        if load.kind == "sum":
            out.append((i, float(c[far][c[far] > p.threshold].sum())))
        elif load.kind == "knn":
            out += [(i, k + 1, int(r), float(c[r])) for k, r in enumerate(order[: p.k]) if c[r] > p.threshold]
        else:
            out.append((i, *([int(order[0])] if load.kind == "1nn_index" else []), float(c[order[0]])))
    if load.kind == "matrix":
        out = [(r, c, float(x)) if x >= p.threshold else (r, c, None) for (r, c), x in np.ndenumerate(cells)]
    return sorted(out, key=lambda r: r[:-1])


def agree(found: list[tuple], expected: list[tuple], tolerance: float) -> bool:
    """Equal keys, and values within ``tolerance``."""
    none = lambda x: x is None or x != x
    return len(found) == len(expected) and all(
        tuple(f[:-1]) == tuple(e[:-1]) and (none(f[-1]) == none(e[-1])) and (none(f[-1]) or abs(f[-1] - e[-1]) <= tolerance * max(1, abs(e[-1]))) for f, e in zip(found, expected, strict=True)
    )


def run_autotune(
    spark: SparkSession, cache_path: str = "", *, mode: str = "quick", plan: AutotunePlan | None = None, executor: Callable = _execute, expected: Callable = reference,
    clock: Callable[[], float] = time.perf_counter, record_writer: Callable = save_record,
) -> dict[AutotuneWorkload, list[CandidateMeasurement]]:
    """Measures every candidate of every workload; the best of those with the right result is stored, if there is one."""
    plan, found = plan or autotune_plan(mode), {}
    best: dict[str, tuple[float, dict]] = {}
    for load in plan.workloads:
        right, measured = expected(load), []
        for s in strategy_descriptions():
            if s.tile > 2 * load.windows:
                continue
            for _ in range(plan.warm_ups):
                executor(spark, load, s.tile)
            seconds, equal = [], True
            for _ in range(plan.trials):
                began = clock()
                result = executor(spark, load, s.tile)
                seconds.append(clock() - began)
                equal &= agree(result, right, TOLERANCE[load.precision])
            measured.append(CandidateMeasurement(s.name, tuple(seconds), equal))
        found[load] = measured
        if good := [x for x in measured if x.equal]:
            top = min(good, key=lambda x: x.median)
            key = f"{_environment(spark)} {load.kind} n={load.windows.bit_length()} m={load.m.bit_length()}"
            record = {"tile": int(top.strategy.split("-")[1]), "median": top.median, "workload": asdict(load)}
            if key not in best or top.median < best[key][0]:
                best[key] = top.median, record
    for key, (_, record) in best.items():
        record_writer(_path(cache_path), key, record)
    return found


def autotune(spark: SparkSession, cache_path: str = "") -> int:
    """Runs the quick plan; the number of records written."""
    return len(run_autotune(spark, cache_path))
