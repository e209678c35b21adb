import os

import numpy as np
import pytest

from tessera import cli
from tessera.sources import text

from . import oracle as O


@pytest.fixture()
def files(tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=40), rng.normal(size=33)
    (tmp_path / "a.txt").write_text(" ".join(map(repr, a.tolist()[:20])) + "\n\n" + "\n".join(map(repr, a.tolist()[20:])))
    (tmp_path / "b.txt").write_text("\t".join(map(repr, b.tolist())))
    monkeypatch.chdir(tmp_path)
    return a, b


def lines(name):
    return open(name).read().splitlines()


def test_index_profile(spark, files):
    a, _ = files
    assert cli.main(["--window=6", "-input_a_file_name=a.txt", "--output_pearson", "--nokeep_rows"]) == 0
    best = O.best(O.pairs(a, a, 6, 2))
    assert [float(x) for x in lines("mp_columns_out")] == pytest.approx([v for v, _ in best], abs=1e-9)
    assert [int(x) for x in lines("mp_columns_out_index")] == [r for _, r in best]
    assert not os.path.exists("mp_rows_out") and not [x for x in os.listdir() if x.startswith(".tessera")]


def test_keep_rows_and_aligned(spark, files):
    a, b = files
    assert cli.main(["--window=6", "--input_a_file_name=a.txt", "--input_b_file_name=b.txt", "--keep_rows", "--aligned", "--global_col=2", "--output_pearson"]) == 0
    p = O.pairs(a, b, 6, 2, 2, 0)
    assert [int(x) for x in lines("mp_columns_out_index")] == [r for _, r in O.best(p)]
    assert [int(x) for x in lines("mp_rows_out_index")] == [r for _, r in O.best(p.T)]


def test_other_profiles(spark, files):
    a, b = files
    common = ["--window=6", "--input_a_file_name=a.txt", "--output_pearson"]
    assert cli.main([*common, "--profile_type=SUM_THRESH", "--threshold=0.2"]) == 0
    p = O.pairs(a, a, 6, 2)
    assert [float(x) for x in lines("mp_columns_out")] == pytest.approx(O.sums(p, 0.2), rel=1e-8)
    assert cli.main([*common, "--profile_type=ALL_NEIGHBORS", "--max_matches_per_column=2"]) == 0
    assert [tuple(map(int, x.split()[:2])) for x in lines("mp_columns_out")] == [(c, r) for c, r, _, _ in O.nearest(p, 2, 0.0)]
    assert cli.main([*common, "--input_b_file_name=b.txt", "--profile_type=MATRIX_SUMMARY", "--reduced_height=3", "--reduced_width=4", "--threshold=-1"]) == 0
    rows = [[float(x) for x in y.split()] for y in lines("mp_columns_out")]
    expected = O.grid(O.pairs(a, b, 6), 3, 4, -1)
    assert rows == [pytest.approx([expected[i, j] for j in range(4)], abs=1e-9) for i in range(3)]
    assert cli.main([*common, "--profile_type=1NN", "--output_a_file_name=-"]) == 0


@pytest.mark.parametrize(
    "args",
    [
        [], ["--window=2", "--input_a_file_name=a.txt"], ["--window=6", "--input_a_file_name=a.txt", "--keep_rows"], ["--window=6", "--input_a_file_name=a.txt", "--aligned"],
        ["--window=6", "--input_a_file_name=a.txt", "--input_b_file_name=b.txt", "--keep_rows", "--profile_type=MATRIX_SUMMARY"],
        ["--window=6", "--input_a_file_name=a.txt", "--ultra_precision", "--single_precision"], ["--window=6", "--input_a_file_name=a.txt", "--output_a_file_name=a.txt"],
        ["--window=6", "--input_a_file_name=a.txt", "--output_a_file_name=x", "--output_a_index_file_name=x"], ["--window=6", "--input_a_file_name=a.txt", "--gpus=0"],
        ["--window=6", "--input_a_file_name=a.txt", "--profile_type=SUM_THRESH", "--threshold=2"], ["--window=6", "--input_a_file_name=a.txt", "--global_row=1"],
        ["--window=6", "--input_a_file_name=missing.txt"], ["--window=60", "--input_a_file_name=a.txt"], ["--window=x"], ["--colour"],
    ],
)
def test_refused(spark, files, args, capsys):
    assert cli.main(args) == 1
    assert capsys.readouterr().err.startswith("Error: ")
    assert sorted(os.listdir()) == ["a.txt", "b.txt"]


def test_text(spark, tmp_path):
    path = str(tmp_path / "x.txt")
    open(path, "w").write("1 2.5e3 -.5\n\n nan +inf -Infinity 7.\n")
    values = [r.value for r in text.read_series(spark, path).rows.orderBy("idx").collect()]
    assert values[:3] == [1, 2500, -0.5] and np.isnan(values[3]) and values[4:] == [np.inf, -np.inf, 7]
    for bad in ("1 2\n3 x4 5", "1\n2 1e999", "0x10", "1,2"):
        open(path, "w").write(bad)
        with pytest.raises(ValueError, match="line"):
            text.read_series(spark, path)


def test_all_files_or_none(tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    open(one, "w").write("old")

    def fails():
        yield "a"
        raise OSError("no more")

    with pytest.raises(OSError):
        text.write_all({one: iter(["new"]), two: fails()})
    assert open(one).read() == "old" and os.listdir(tmp_path) == ["one"]
    os.mkdir(two)
    open(f"{two}/x", "w").close()
    text.write_all({one: iter(["1", "2"])})
    assert open(one).read() == "1\n2\n"


def test_variants(capsys):
    assert cli.main(["--list_variants"]) == 0 and "blocks of" in capsys.readouterr().out
