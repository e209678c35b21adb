import itertools
import os
import subprocess
import sys

import numpy as np

import tessera as T
from tessera import tuning
from tessera.sources.series import Series
from tessera.streaming.matching import match_stream

from . import oracle as O

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_autotune(spark, tmp_path):
    path = str(tmp_path / "cache" / "t.json")
    ticks = itertools.count()
    plan = tuning.AutotunePlan("quick", (tuning.AutotuneWorkload("1nn", 400, 8),), 0, 1)
    measured = T.run_autotune(spark, path, plan=plan, clock=lambda: next(ticks) ** 2)
    assert all(x.equal for x in measured[plan.workloads[0]]) and len(measured[plan.workloads[0]]) == 2
    assert T.autotune_status(path)["records"] == 1
    assert tuning.lookup(spark, "1nn", 500, 9, path) == 256 and tuning.lookup(spark, "1nn", 5000, 9, path) is None
    assert T.reset_autotune(path) and not T.reset_autotune(path)
    open(path, "w").write("{broken")
    assert T.autotune_status(path)["records"] == 0
    quick, full = T.autotune_plan(), T.autotune_plan("full")
    assert len(quick.workloads) == 20 and len(full.workloads) == 60 and T.strategy_descriptions()[0].tile == 256
    assert {(x.kind, x.self_join, x.precision) for x in quick.workloads} == set(itertools.product(("1nn_index", "1nn", "sum", "knn", "matrix"), (True, False), ("single", "double")))


def test_candidates_are_held_against_the_definition(spark, tmp_path):
    loads = tuple(tuning.AutotuneWorkload(k, 300, 10, one) for k in ("1nn_index", "sum", "knn", "matrix") for one in (True, False))
    found = T.run_autotune(spark, str(tmp_path / "t.json"), plan=tuning.AutotunePlan("quick", loads, 0, 1))
    assert set(found) == set(loads) and all(x.equal for m in found.values() for x in m)
    wrong = lambda s, load, tile: [(*r[:-1], 0.123) for r in tuning.reference(load)]
    written = []
    found = T.run_autotune(spark, "x", plan=tuning.AutotunePlan("quick", loads[:1], 0, 1), executor=wrong, record_writer=lambda *x: written.append(x))
    assert not any(x.equal for m in found.values() for x in m) and not written


def test_records_of_an_environment_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(tuning, "MOST_OF_ONE", 3)
    path = str(tmp_path / "t.json")
    for i in range(6):
        tuning.save_record(path, f"cores=1 spark=4 numpy=2 1nn n={i} m=3", {"tile": i})
        tuning.save_record(path, f"cores=2 spark=4 numpy=2 1nn n={i} m=3", {"tile": i})
    kept = tuning._read(path)["records"]
    assert len(kept) == 6 and "cores=1 spark=4 numpy=2 1nn n=5 m=3" in kept and "cores=1 spark=4 numpy=2 1nn n=2 m=3" not in kept


def test_stream_matches_like_a_join(spark, tmp_path):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=30), rng.normal(size=50)
    windows = [(i, a[i : i + 6].tolist()) for i in range(25)] + [(25, None), (26, [1.0] * 6), (27, [1.0, 2.0])]
    spark.createDataFrame(windows, "i long, w array<double>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, w array<double>").parquet(str(tmp_path / "in"))
    query = match_stream(stream, "w", Series.of(spark, b), 6, ("i",)).writeStream.format("memory").queryName("matched").start()
    query.processAllAvailable()
    query.stop()
    found = {r.i: (r.corr, r.row_idx) for r in spark.table("matched").collect()}
    for i, (v, r) in enumerate(O.best(O.pairs(a, b, 6))):
        assert abs(found[i][0] - v) < 1e-9 and found[i][1] == r
    assert all(found[i] == (None, -1) for i in (25, 26, 27))


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    code = """
import sys
sys.path.insert(0, %r)
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tessera.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "selfjoin_1nn_index" in q and not any(k.startswith("op") or k == "pipeline" for k in q)
assert set(o) <= set(q)
""" % ROOT
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["col_idx", "corr", "row_idx"] and e.entry(spark).count() == 531 - 23
    assert set(e.oracle_sql()) <= set(e.queries())
