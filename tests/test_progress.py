import numpy as np
import pytest

import tessera as T
from tessera.functions.bins import bin_bounds, bin_of
from tessera.operators import kernel as K
from tessera.params import JoinParams
from tessera.plans.tiles import tile_length, working_set_bytes

A = np.sin(np.arange(300) / 3) + np.arange(300) % 7


def test_reports(spark, capsys):
    T.selfjoin(A, 12, verbose=True).count()
    lines = capsys.readouterr().out.splitlines()
    assert [x.split(" ")[3].rstrip(":") for x in lines] == ["start", "plan=tiles", "planned", "completed"]
    assert all(x.startswith("tessera op=") and " self/1nn_index " in x for x in lines)
    with pytest.raises(ValueError):
        T.selfjoin_matrix(A, 12, mheight=1000, verbose=True)
    assert "error: ValueError" in capsys.readouterr().out
    T.selfjoin(A, 12).count()
    assert capsys.readouterr().out == ""


def test_progress(spark):
    seen = []
    rows = T.abjoin_sum(A, A[:200], 12, progress=lambda done, known: seen.append((done, known))).collect()
    assert len(rows) == 289 and seen and seen[-1][0] == seen[-1][1] > 0
    assert all(a <= b for (a, _), (b, _) in zip(seen, seen[1:], strict=False)) and all(a <= b for a, b in seen)
    with pytest.raises(TypeError):
        T.selfjoin(A, 12, progress=3)

    def broken(done, known):
        raise RuntimeError("stop")

    with pytest.raises(RuntimeError, match="stop"):
        T.selfjoin(A, 12, progress=broken)


def test_bins(spark):
    for n, bins in ((23, 7), (32, 32), (130, 11), (3, 5)):
        found = {r.bin: (r.start, r.stop) for r in bin_bounds(spark.createDataFrame([(n,)], "n long"), bins).collect()}
        of = bin_of(np.arange(n), bins, n)
        assert found == {int(b): (int(np.flatnonzero(of == b)[0]), int(np.flatnonzero(of == b)[-1]) + 1) for b in np.unique(of)}


def test_working_set_bounds_the_block():
    for m in (8, 500, 5000, 100_000):
        n = tile_length(10_000_000, m, 8, budget=64 << 20)
        assert n == 256 or working_set_bytes(max(1, K.CHUNK // n), n, m) <= 64 << 20
    with pytest.raises(ValueError):
        working_set_bytes(0, 10, 5)


@pytest.mark.parametrize("name", ["noise", "walk", "repeated", "gaps"])
def test_recurrence_equals_products(monkeypatch, name):
    monkeypatch.setattr(K, "LARGE", 1)
    monkeypatch.setattr(K, "REFRESH", 50)
    rng = np.random.default_rng(3)
    x = {"noise": rng.normal(size=900) + 1e5, "walk": rng.normal(size=900).cumsum(), "repeated": np.tile(rng.normal(size=60), 15), "gaps": rng.normal(size=900)}[name]
    if name == "gaps":
        x[300], x[500:540], x[700] = np.nan, 2.0, np.inf
    m, y = 24, x[::-1].copy()
    (zc, oc), (zr, orow) = K.normalise(x, m), K.normalise(y, m)
    for kind, k in (("1nn_index", None), ("1nn", None), ("sum", None), ("knn", 3)):
        p = JoinParams.of(kind, m, True, {}, k)
        sides = K.Recurrence.of(x, m), K.Recurrence.of(y, m)
        assert K.Recurrence.drift(sides[0], oc, sides[1], orow) <= K.DRIFT or name == "gaps"
        quick, plain = K.Tile(zc, oc, zr, orow, 0, 5, p, 900, 900, False, *sides), K.Tile(zc, oc, zr, orow, 0, 5, p, 900, 900)
        run = {"1nn_index": lambda t: t.best(True), "1nn": lambda t: t.best(True, False), "sum": lambda t: t.sums(True), "knn": lambda t: t.nearest(True)}[kind]
        for a, b in zip(run(quick), run(plain), strict=True):
            for u, v in zip(a, b, strict=True) if isinstance(a, tuple) else [(a, b)]:
                assert np.allclose(u, v, atol=1e-9 if kind == "sum" else 1e-11, rtol=0)


def test_recurrence_leaves_unequal_sizes_to_products():
    x = np.ones(300)
    x[10] = 1e30
    x[100:] += np.random.default_rng(1).normal(size=200) * 1e-3
    _, ok = K.normalise(x, 8)
    r = K.Recurrence.of(x, 8)
    assert K.Recurrence.drift(r, ok, r, ok) > K.DRIFT
    assert K.Recurrence.of(np.full(20, np.nan), 4) is None
