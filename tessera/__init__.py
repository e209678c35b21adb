"""Time-series similarity joins (matrix profiles) on Spark."""

from .operators.profiles import (
    abjoin,
    abjoin_1nn,
    abjoin_bidirectional,
    abjoin_knn,
    abjoin_matrix,
    abjoin_sum,
    gpu_supported,
    merge_slices,
    selfjoin,
    selfjoin_1nn,
    selfjoin_knn,
    selfjoin_matrix,
    selfjoin_sum,
)
from .plans.tiles import plan_tiles, working_set_bytes
from .sources.series import Series
from .tuning import AutotunePlan, AutotuneWorkload, CandidateMeasurement, StrategyDescription, autotune, autotune_plan, autotune_status, reset_autotune, run_autotune, strategy_descriptions

__all__ = [
    "Series", "abjoin", "abjoin_1nn", "abjoin_bidirectional", "abjoin_knn", "abjoin_matrix", "abjoin_sum", "gpu_supported",
    "AutotunePlan", "AutotuneWorkload", "CandidateMeasurement", "StrategyDescription", "autotune", "autotune_plan", "autotune_status", "merge_slices", "plan_tiles",
    "reset_autotune", "run_autotune", "strategy_descriptions", "working_set_bytes", "selfjoin", "selfjoin_1nn", "selfjoin_knn", "selfjoin_matrix", "selfjoin_sum",
]
