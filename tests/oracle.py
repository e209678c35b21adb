"""Brute force, written from the semantics: all windows, all pairs, in float64."""

import numpy as np

MISS = -2.0


def units(x, m):
    x = np.array([np.nan if v is None else v for v in x], float)
    out = []
    for i in range(len(x) - m + 1):
        w = x[i : i + m]
        if not np.isfinite(w).all():
            out.append(None)
            continue
        scale = max(np.abs(w).max(), 1e-300)
        c = w / scale - (w / scale).mean()
        norm = np.sqrt((c * c).sum())
        out.append(c / norm if norm > np.sqrt(1e-13) / scale else None)
    return out


def pairs(a, b, m, exclusion=0, col_offset=0, row_offset=0):
    """Correlations, rows by columns; MISS where a pair does not count."""
    ua, ub = units(a, m), units(b, m)
    out = np.full((len(ub), len(ua)), MISS)
    for r, y in enumerate(ub):
        for c, x in enumerate(ua):
            if x is not None and y is not None and abs(c + col_offset - r - row_offset) >= exclusion:
                out[r, c] = np.clip(x @ y, -1, 1)
    return out


def best(p):
    """(value or None, smallest row with it or -1) of each column."""
    out = []
    for c in p.T:
        top = c.max(initial=MISS)
        out.append((None, -1) if top == MISS else (top, int(np.flatnonzero(c >= top - 1e-10)[0])))
    return out


def sums(p, threshold):
    return [float(c[c > threshold].sum()) for c in p.T]


def nearest(p, k, threshold):
    out = []
    for i, c in enumerate(p.T):
        rows = sorted(range(len(c)), key=lambda r: (-round(c[r], 10), r))[:k]
        out += [(i, r, n + 1, c[r]) for n, r in enumerate(rows) if c[r] > threshold]
    return out


def grid(p, height, width, threshold, upper=False):
    nb, na = p.shape
    out = {}
    for i in range(height):
        for j in range(width):
            cell = [p[r, c] for r in range(nb) if r * height // nb == i for c in range(na) if c * width // na == j and (not upper or r <= c)]
            top = max(cell, default=MISS)
            out[i, j] = top if top > MISS and top >= threshold else None
    return out
