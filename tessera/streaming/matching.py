"""Matching of streamed windows against a fixed series (beyond the joins that have a counterpart elsewhere).

Every arriving window is compared with all windows of B and gets its best match, as ``abjoin`` would give it. B is
normalised once; it is sent to the tasks while its windows take at most ``MOST_BYTES``, and refused beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernel import EXCLUDED, Tile, normalise
from ..params import JoinParams
from ..sources.series import Series

MOST_BYTES = 128 << 20


def match_stream(windows: DataFrame, samples: str, b: Series, m: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` with corr and row_idx for each row of a batch or streaming DataFrame whose ``samples`` (an array) has m
    numbers; null and -1 for windows that are incomplete or flat."""
    p = JoinParams.of("1nn_index", m, False, {})
    n = b.rows.count()
    if 8 * m * n > MOST_BYTES:
        raise ValueError("B is too long to be sent to every task")
    values = np.array([np.nan if r.value is None else r.value for r in b.rows.orderBy("idx").select("value").collect()], float)
    zb, okb = normalise(values, m)
    shared = b.rows.sparkSession.sparkContext.broadcast((zb, okb))
    given = windows.select(*keep, F.col(samples).cast("array<double>").alias("__samples"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in given.dtypes[:-1]), "corr double, row_idx long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z_rows, ok_rows = shared.value
        for batch in batches:
            z, ok = np.zeros((batch.num_rows, m)), np.zeros(batch.num_rows, bool)
            for i, w in enumerate(batch.column(len(keep)).to_pylist()):
                if w is not None and len(w) == m:
                    one, valid = normalise(np.array([np.nan if x is None else x for x in w], float), m)
                    z[i], ok[i] = one[0], valid[0]
            (top, at), _ = Tile(z, ok, z_rows, ok_rows, 0, 0, p).best()
            none = top == EXCLUDED
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(top, mask=none), pa.array(np.where(none, -1, at))], names=[*keep, "corr", "row_idx"])

    return given.mapInArrow(run, schema)
