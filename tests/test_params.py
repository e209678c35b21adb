import numpy as np
import pytest

import tessera as T
from tessera.params import exclusion_radius

A = list(range(20))


@pytest.mark.parametrize(
    "call,error",
    [
        (lambda: T.selfjoin(A, 2), ValueError),
        (lambda: T.selfjoin(A, 4.0), TypeError),
        (lambda: T.selfjoin(A, 21), ValueError),
        (lambda: T.abjoin(A, A[:5], 6), ValueError),
        (lambda: T.selfjoin(A, 4, colour=1), ValueError),
        (lambda: T.selfjoin(A, 4, allow_trivial_match=True), ValueError),
        (lambda: T.selfjoin(A, 4, threshold=0.1), ValueError),
        (lambda: T.selfjoin(A, 4, precision="mixed"), ValueError),
        (lambda: T.selfjoin(A, 4, precision=1), TypeError),
        (lambda: T.selfjoin(A, 4, pearson="yes"), TypeError),
        (lambda: T.selfjoin(A, 4, gpus=None), TypeError),
        (lambda: T.selfjoin(A, 4, gpus=[0]), ValueError),
        (lambda: T.selfjoin(A, 4, threads=1.5), TypeError),
        (lambda: T.selfjoin(A, 4, threads=-1), ValueError),
        (lambda: T.selfjoin(A, 4, max_tile_size=1000), ValueError),
        (lambda: T.selfjoin(A, 4, max_tile_size=2048.0), TypeError),
        (lambda: T.selfjoin(A, 600, max_tile_size=1024), ValueError),
        (lambda: T.selfjoin_sum(A, 4, threshold=1.5), ValueError),
        (lambda: T.selfjoin_sum(A, 4, threshold=float("nan")), ValueError),
        (lambda: T.selfjoin_sum(A, 4, threshold="0"), TypeError),
        (lambda: T.selfjoin_knn(A, 4, 0), ValueError),
        (lambda: T.selfjoin_knn(A, 4, 1.0), TypeError),
        (lambda: T.selfjoin_matrix(A, 4, mheight=0), ValueError),
        (lambda: T.selfjoin_matrix(A, 4, mwidth=18, mheight=2), ValueError),
        (lambda: T.selfjoin([], 4), ValueError),
        (lambda: T.selfjoin(A, 4, exclusion_zone=-1), ValueError),
        (lambda: T.selfjoin(A, 4, plan="other"), ValueError),
    ],
)
def test_refused(spark, call, error):
    with pytest.raises(error):
        call()


def test_accepted(spark):
    found = T.abjoin(A, A, np.int64(4), pearson=np.bool_(True), gpus=[], threads=np.int32(2), max_tile_size=2048, allow_trivial_match=None, verbose=None)
    assert found.columns == ["col_idx", "corr", "row_idx"] and found.count() == 17
    assert T.gpu_supported() is False
    assert [exclusion_radius(m) for m in (3, 4, 5, 8, 33)] == [1, 1, 2, 2, 9]


def test_verbose(spark, capsys):
    T.selfjoin_sum(A, 4, verbose=True)
    shown = capsys.readouterr().out
    assert "self/sum start: m=4" in shown and "self/sum plan=" in shown and "self/sum completed: " in shown
