"""Profiles as SQL table functions. A partition is one series, or a pair of series; its rows arrive in the order of the
call.

    SELECT * FROM self_profile(TABLE(s) PARTITION BY (series_id) ORDER BY (idx), 24)
    SELECT * FROM self_values(TABLE(s) PARTITION BY (series_id) ORDER BY (idx), 24)
    SELECT * FROM self_sums(TABLE(s) PARTITION BY (series_id) ORDER BY (idx), 24, 0.3)
    SELECT * FROM self_neighbours(TABLE(s) PARTITION BY (series_id) ORDER BY (idx), 24, 3, 0.3)
    SELECT * FROM self_matrix(TABLE(s) PARTITION BY (series_id) ORDER BY (idx), 24, 4, 5, 0.3)
    SELECT * FROM ab_profile(TABLE(t) PARTITION BY (pair) ORDER BY (side, idx), 24)     and so on; and both ways
    SELECT * FROM ab_both(TABLE(t) PARTITION BY (pair) ORDER BY (side, idx), 24)

The table needs a column ``value``, and for pairs ``side``, which is 'a' (columns) or 'b' (rows). A partition is
evaluated by one task; for long series use the DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.kernel import EXCLUDED, Tile, normalise
from ..params import JoinParams


def _nearest(top: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    for i, (c, r) in enumerate(zip(top.tolist(), at.tolist(), strict=True)):
        yield i, None if c == EXCLUDED else c, -1 if c == EXCLUDED else r


def profile_rows(t: Tile) -> Iterator[tuple]:
    return _nearest(*t.best()[0])


def value_rows(t: Tile) -> Iterator[tuple]:
    return ((i, c) for i, c, _ in _nearest(*t.best(index=False)[0]))


def both_rows(t: Tile) -> Iterator[tuple]:
    for axis, side in zip("ab", t.best(True), strict=True):
        yield from ((axis, *row) for row in _nearest(*side))


def sum_rows(t: Tile) -> Iterator[tuple]:
    return enumerate(t.sums()[0].tolist())


def neighbour_rows(t: Tile) -> Iterator[tuple]:
    return zip(*(x.tolist() for x in t.nearest()[0]), strict=True)


def matrix_rows(t: Tile) -> Iterator[tuple]:
    cells = t.cells()
    for r in range(t.p.mheight):
        for c in range(t.p.mwidth):
            x = float(cells.get((r, c), EXCLUDED))
            yield r, c, x if x > EXCLUDED and x >= t.p.threshold else None


#: Name, kind, what rows are made of a tile, their type, and the parameters after the window.
FUNCTIONS = (
    ("profile", "1nn_index", profile_rows, "col_idx: bigint, corr: double, row_idx: bigint", ()),
    ("values", "1nn", value_rows, "col_idx: bigint, corr: double", ()),
    ("both", "1nn_index", both_rows, "axis: string, idx: bigint, corr: double, match_idx: bigint", ()),
    ("sums", "sum", sum_rows, "col_idx: bigint, corr_sum: double", ("threshold",)),
    ("neighbours", "knn", neighbour_rows, "col_idx: bigint, row_idx: bigint, corr: double", ("k", "threshold")),
    ("matrix", "matrix", matrix_rows, "bin_row: bigint, bin_col: bigint, corr: double", ("mheight", "mwidth", "threshold")),
)


def _table_function(kind: str, rows, returns: str, names: tuple[str, ...], two: bool):
    """A table function over a table's rows, a window length and the parameters ``names``."""

    class Function:
        def __init__(self):
            self.sides, self.given = {}, None

        def eval(self, row, m: int, *parameters):
            value = row["value"]
            self.sides.setdefault(row["side"] if two else "a", []).append(np.nan if value is None else float(value))
            self.given = m, parameters

        def terminate(self):
            if self.given is None:
                return
            m, options = self.given[0], dict(zip(names, self.given[1], strict=True))
            k = options.pop("k", None)
            if "threshold" in options:
                options["threshold"] = float(options["threshold"])
            p = JoinParams.of(kind, m, not two, options, k)
            sides = [normalise(np.array(self.sides.get(x, []), float), m) for x in ("ab" if two else "aa")]
            (za, oa), (zb, ob) = sides
            if len(oa) and len(ob):
                yield from rows(Tile(za, oa, zb, ob, 0, 0, p, len(oa), len(ob), kind == "matrix" and not two))

    return udtf(Function, returnType=returns)


def register(spark: SparkSession) -> None:
    for name, kind, rows, returns, names in FUNCTIONS:
        for prefix, two in (("self", False), ("ab", True)):
            if two or name != "both":
                spark.udtf.register(f"{prefix}_{name}", _table_function(kind, rows, returns, names, two))
