"""Evaluation of one tile: all pairs of a block of columns (windows of A) and a block of rows (windows of B).

Windows are z-normalised. In large tiles a covariance follows from the one before it on its diagonal, by adding the
sample that comes and taking off the one that goes (two products a pair, whatever the window's length); every
``REFRESH`` rows it is computed anew, and a tile whose samples differ too much in size for that uses matrix products.
Correlations are reduced in bounded chunks, so a tile never holds all its pairs. Ties within ``TIE`` count as exact,
and the correlations of reported matches are computed anew from their windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..functions.bins import bin_of
from ..params import FLAT, JoinParams

EXCLUDED = -2.0
TIE = 1e-10
CHUNK = 1 << 18  # pairs held at once
#: Pairs from which on a tile uses the recurrence, rows between exact ones, and the largest error that it may make.
LARGE, REFRESH, DRIFT = 1 << 20, 256, 2e-11


def normalise(samples: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit windows, a row each, and which are valid: complete and not flat.

    Every window is taken relative to its first sample, so a large common offset costs no digits, and scaled by its own
    largest deviation, so neither huge nor tiny samples lose others' digits. (Quarters keep differences finite.)
    """
    n = len(samples) - m + 1
    if n <= 0:
        return np.zeros((0, m)), np.zeros(0, bool)
    finite = np.isfinite(samples)
    clean = np.where(finite, samples, 0.0)
    windows = np.lib.stride_tricks.sliding_window_view(clean, m)
    gaps = np.concatenate([[0], np.cumsum(~finite)])
    z = windows / 4 - windows[:, :1] / 4
    scale = np.maximum(np.abs(z).max(1), 1e-300)
    z /= scale[:, None]
    z -= z.mean(1, keepdims=True)
    norm = np.sqrt(np.einsum("ij,ij->i", z, z))
    valid = (gaps[m:] == gaps[:-m]) & (norm > np.sqrt(FLAT) / 4 / scale)
    z /= np.where(valid, norm, 1.0)[:, None]
    return z, valid


@dataclass(frozen=True)
class Recurrence:
    """Of the windows of a block: its centred samples (missing ones 0), what a step along a diagonal adds to
    covariances (the sum over both sides of gain times lean), norms, and the largest sample."""

    samples: np.ndarray
    m: int
    gain: np.ndarray
    lean: np.ndarray
    norm: np.ndarray
    most: float

    @staticmethod
    def of(samples: np.ndarray, m: int) -> Recurrence | None:
        """None if there is no finite sample, or numbers are too large to multiply."""
        finite = np.isfinite(samples)
        if not finite.any():
            return None
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.where(finite, samples - samples[finite].mean(), 0.0)
            windows = np.lib.stride_tricks.sliding_window_view(x, m)
            mean = windows.mean(1)
            centred = windows - mean[:, None]
            norm = np.sqrt(np.einsum("ij,ij->i", centred, centred))
        most = np.abs(x).max(initial=0.0)
        if not (most < 1e100 and np.isfinite(norm).all()):
            return None
        gain, lean = np.zeros(len(mean)), np.zeros(len(mean))
        gain[1:] = (x[m:] - x[: len(mean) - 1]) / 2
        lean[1:] = x[m:] - mean[1:] + x[: len(mean) - 1] - mean[:-1]
        return Recurrence(x, m, gain, lean, norm, float(most))

    @staticmethod
    def drift(a: Recurrence, ok_a: np.ndarray, b: Recurrence, ok_b: np.ndarray) -> float:
        """A bound of the error of a correlation after ``REFRESH`` steps."""
        if not (ok_a.any() and ok_b.any()):
            return np.inf
        least = a.norm[ok_a].min() * b.norm[ok_b].min()
        if not least > 1e-200:
            return np.inf
        return np.finfo(float).eps * ((8 * REFRESH + a.m) * a.most * b.most + REFRESH * a.norm.max() * b.norm.max()) / least

    def covariances(self, other: Recurrence, i: int) -> np.ndarray:
        """Of all windows with window ``i`` of ``other``."""
        window = other.samples[i : i + self.m]
        return np.correlate(self.samples, window - window.mean(), "valid")


@dataclass
class Tile:
    """``col0`` and ``row0`` are the first windows' indices, ``nb`` and ``na`` the series' numbers of windows."""

    z_cols: np.ndarray
    ok_cols: np.ndarray
    z_rows: np.ndarray
    ok_rows: np.ndarray
    col0: int
    row0: int
    p: JoinParams
    na: int = 0
    nb: int = 0
    upper: bool = False  # keep pairs with row <= col only
    cols: Recurrence | None = None
    rows: Recurrence | None = None

    def products(self, step: int):
        """Runs of rows with their correlations, by matrix products."""
        for r in range(0, len(self.ok_rows), step):
            yield r, self.z_rows[r : r + step] @ self.z_cols.T

    def steps(self, step: int):
        """The same along the diagonals."""
        a, b, n = self.cols, self.rows, len(self.ok_rows)
        first = b.covariances(a, 0)
        by_col = np.divide(1.0, a.norm, out=np.zeros_like(a.norm), where=self.ok_cols)
        by_row = np.divide(1.0, b.norm, out=np.zeros_like(b.norm), where=self.ok_rows)
        gain, lean, term = a.gain[1:], a.lean[1:], np.empty(len(self.ok_cols) - 1)
        cov, last = np.empty((step, len(self.ok_cols))), None
        for r in range(0, n, step):
            some = min(step, n - r)
            for i in range(some):
                row, now = r + i, cov[i]
                if row % REFRESH == 0:
                    now[:] = a.covariances(b, row)
                else:
                    now[0] = first[row]
                    np.multiply(gain, b.lean[row], out=now[1:])
                    np.multiply(lean, b.gain[row], out=term)
                    now[1:] += term
                    now[1:] += last[:-1]
                last = now
            last = last.copy()
            c = cov[:some] * by_col
            c *= by_row[r : r + some, None]
            yield r, c

    def chunks(self):
        """Runs of rows with their correlations (rows by columns); pairs that don't count are EXCLUDED."""
        p, cols = self.p, len(self.ok_cols)
        step = max(1, min(len(self.ok_rows), CHUNK // max(1, cols)))
        shift = self.row0 + p.row_offset - self.col0 - p.col_offset
        quick = self.cols and self.rows and cols * len(self.ok_rows) >= LARGE and Recurrence.drift(self.cols, self.ok_cols, self.rows, self.ok_rows) <= DRIFT
        no_col, no_row = np.flatnonzero(~self.ok_cols), np.flatnonzero(~self.ok_rows)
        for r, c in (self.steps if quick else self.products)(step):
            np.clip(c, -1.0, 1.0, out=c)
            if len(no_col):
                c[:, no_col] = EXCLUDED
            if len(no_row):
                c[no_row[(no_row >= r) & (no_row < r + len(c))] - r] = EXCLUDED
            rows = np.arange(r, r + len(c)) + shift
            if p.exclusion and rows[0] - p.exclusion < cols and rows[-1] + p.exclusion > 0:
                for i, x in enumerate(rows):
                    c[i, max(0, x - p.exclusion + 1) : max(0, x + p.exclusion)] = EXCLUDED
            if self.upper:
                for i, x in enumerate(np.arange(r, r + len(c)) + self.row0 - self.col0):
                    c[i, : max(0, x)] = EXCLUDED
            yield r, c

    def best(self, rows_too: bool = False, index: bool = True):
        """For each column its largest correlation and the first row that has it (EXCLUDED and -1 without any); with
        ``rows_too`` the same for each row."""
        n = len(self.ok_cols)
        top, at = np.full(n, EXCLUDED), np.full(n, -1, np.int64)
        row_top, row_at = np.full(len(self.ok_rows), EXCLUDED), np.full(len(self.ok_rows), -1, np.int64)
        for r, c in self.chunks():
            high = c.max(0)
            better = high > top + (TIE if index else 0)
            if index and better.any():
                some = np.flatnonzero(better)
                first = (c[:, some] >= high[some] - TIE).argmax(0) if len(some) < n else (c >= high - TIE).argmax(0)
                at[some] = first + r + self.row0
            if index:
                better |= high > top
            top = np.where(better, high, top)
            if rows_too:
                high = c.max(1)
                row_top[r : r + len(c)] = high
                if index:
                    first = (c >= high[:, None] - TIE).argmax(1) + self.col0
                    row_at[r : r + len(c)] = np.where(high > EXCLUDED, first, -1)
        if index:
            found, row_found = np.flatnonzero(at >= 0), np.flatnonzero(row_at >= 0)
            top[found] = self.exact(found, at[found] - self.row0)
            row_top[row_found] = self.exact(row_at[row_found] - self.col0, row_found)
        return (top, at), (row_top, row_at)

    def exact(self, cols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Correlations of given pairs, from their windows."""
        return np.clip(np.einsum("ij,ij->i", self.z_cols[cols], self.z_rows[rows]), -1.0, 1.0)

    def sums(self, rows_too: bool = False):
        total, row_total = np.zeros(len(self.ok_cols)), np.zeros(len(self.ok_rows))
        for r, c in self.chunks():
            c *= c > self.p.threshold
            total += c.sum(0)
            if rows_too:
                row_total[r : r + len(c)] = c.sum(1)
        return total, row_total

    def nearest(self, rows_too: bool = False):
        """(column, row, corr) of at most k pairs for each column, and (row, column, corr) of at most k for each row."""
        k, found, row_found = self.p.k, [], []
        for r, c in self.chunks():
            found.append(_top(c, k, self.p.threshold, self.col0, r + self.row0))
            if rows_too:
                row_found.append(_top(c.T, k, self.p.threshold, r + self.row0, self.col0))
        keep = lambda parts: _keep(*(np.concatenate(x) for x in zip(*parts, strict=True)), k) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        (col, row, _), (turned_row, turned_col, _) = keep(found), keep(row_found)
        return (col, row, self.exact(col - self.col0, row - self.row0)), (turned_row, turned_col, self.exact(turned_col - self.col0, turned_row - self.row0))

    def cells(self):
        """(row bin, column bin, largest corr) of the cells that this tile touches."""
        p, cols = self.p, len(self.ok_cols)
        col_bin = bin_of(np.arange(cols) + self.col0, p.mwidth, self.na)
        starts = np.flatnonzero(np.concatenate([[True], col_bin[1:] != col_bin[:-1]])) if cols else np.zeros(0, int)
        best: dict[tuple[int, int], float] = {}
        for r, c in self.chunks():
            row_bin = bin_of(np.arange(r, r + len(c)) + self.row0, p.mheight, self.nb)
            row_starts = np.flatnonzero(np.concatenate([[True], row_bin[1:] != row_bin[:-1]]))
            pooled = np.maximum.reduceat(np.maximum.reduceat(c, row_starts, 0), starts, 1)
            for i, a in enumerate(row_bin[row_starts]):
                for j, b in enumerate(col_bin[starts]):
                    if pooled[i, j] > best.get((a, b), EXCLUDED):
                        best[a, b] = pooled[i, j]
        return best


def _top(c: np.ndarray, k: int, threshold: float, col0: int, row0: int):
    """Candidates for the k best rows of each column, ties included."""
    if len(c) > k:
        least = np.partition(c, len(c) - k, 0)[len(c) - k] - TIE
        row, col = np.nonzero((c >= least) & (c > threshold))
    else:
        row, col = np.nonzero(c > threshold)
    return _keep(col + col0, row + row0, c[row, col], k)


def _keep(col: np.ndarray, row: np.ndarray, corr: np.ndarray, k: int):
    order = np.lexsort((row, -np.round(corr, 10), col))
    col, row, corr = col[order], row[order], corr[order]
    start = np.concatenate([[True], col[1:] != col[:-1]]) if len(col) else np.zeros(0, bool)
    rank = np.arange(len(col)) - np.maximum.accumulate(np.where(start, np.arange(len(col)), 0)) if len(col) else col
    return col[rank < k], row[rank < k], corr[rank < k]
