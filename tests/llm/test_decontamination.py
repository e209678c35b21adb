import math
import random
from itertools import combinations

import duckdb
import pytest

from tessera.llm import decontamination as D
from tessera.llm import sql

ITEM = "the quick brown fox jumps over the lazy dog while seven grey geese fly south for a long cold winter"
REST = "some other words stand before and after it in a text that nobody took from any test at all really"


def swapped(text, *places):
    words = text.split(" ")
    for p in places:
        words[p] = f"other{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM, "x"), (2, "short item here", "x"), (3, None, "x"), (4, "...", "x"), (5, REST + " plus an ending", "x")], "item_id long, text string, tokens string")


def test_tolerates_substitutions(spark, items):
    docs = spark.createDataFrame(
        [
            (1, f"{REST[:40]} {ITEM.upper()}! {REST[:20]}"),
            (2, f"Lead. {swapped(ITEM, 5)} tail"),
            (3, f"Lead. {swapped(ITEM, 3, 12)} tail"),
            (4, f"Lead. {swapped(ITEM, *range(0, 20, 2))} tail"),
            (5, "Lead. " + " ".join(ITEM.split(" ")[:13]) + " something else entirely follows here"),
            (6, "Lead. " + " ".join(ITEM.split(" ")[:8]) + " something else entirely follows here"),
            (7, "a Short, item here."),
            (8, "a short item there"),
        ],
        "doc_id long, text string",
    )
    found = {(r.doc_id, r.item_id): r for r in D.find_overlaps(docs, items).collect()}
    assert set(found) == {(1, 1), (2, 1), (3, 1), (5, 1), (7, 2)}
    assert found[3, 1].matched == 18 and found[3, 1].doc_start == 1 and found[3, 1].n_item == 20
    shuffled = D.find_overlaps(docs, items, broadcast_bytes=-1)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, found.values()))


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    rows = D.op1_spaced_seed_decontamination(spark, "/root/testdata/sf0.001")
    expected = con.execute(sql.OP1).df()[rows.columns]
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, expected.values.tolist()))
    leaks = con.execute("select distinct doc_id from documents d, benchmark b where contains(d.text, b.text)").fetchall()
    assert {i for (i,) in leaks} <= {r.doc_id for r in rows.collect()}


def test_no_python(spark):
    rows = D.find_overlaps(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))
    plan = rows._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_edges(spark, edge_docs, no_docs, items):
    assert D.find_overlaps(edge_docs, items).count() == 0
    own = edge_docs.filter("doc_id = 6 OR doc_id = 15").selectExpr("doc_id AS item_id", "text").union(edge_docs.limit(1).selectExpr("CAST(NULL AS long)", "'x endoftext y'"))
    found = {(r.doc_id, r.item_id) for r in D.find_overlaps(edge_docs, own).collect()}
    assert {(6, 6), (7, 6), (8, 6), (None, 6), (15, 15), (15, None)} <= found and all(d in (6, 7, 8, None, 15) for d, _ in found)
    left = D.decontaminate(edge_docs, own)
    assert left.columns == edge_docs.columns and left.filter("doc_id IS NULL").count() == 2
    assert {6, 7, 8, 15}.isdisjoint({r.doc_id for r in left.collect()})
    assert D.find_overlaps(no_docs, items).count() == 0
    assert D.find_overlaps(edge_docs, items.limit(0)).count() == 0


def brute(docs, items):
    """{(doc_id, item_id): best, matched, -start} over all diagonals, by the rule of verification alone."""
    found = {}
    for d, t in docs:
        for i, it in items:
            n = min(D.WINDOW, len(it))
            for s in range(1 - len(it), len(t)):
                f = [int(0 <= s + k < len(t) and t[s + k] == w) for k, w in enumerate(it)]
                best = max(sum(f[k : k + n]) for k in range(len(f) - n + 1))
                if best >= math.ceil(D.LEAST * n):
                    found[d, i] = max(found.get((d, i), ()), (best, sum(f), -s))
    return found


@pytest.mark.parametrize("sizes", [(10, 11, 12, 13, 15), (9,), (5,), (1, 2, 3, 4, 6, 7, 8, 14)])
def test_misses_no_diagonal(spark, sizes):
    """Every accepted pattern of substitutions, also cut off by a text's ends. Short items' masks find those of others
    too, so sizes are tested apart."""
    items = [(n, [f"i{n}x{k}" for k in range(n)]) for n in sizes]
    texts = []
    for n, it in items:
        wide = min(n, D.WINDOW)
        for places in combinations(range(wide), wide - math.ceil(D.LEAST * wide)):
            for shift in {0, n - wide}:
                window = [f"other{k}" if k in places else w for k, w in enumerate(it[shift : shift + wide])]
                texts += [["lead", "in", *window, "and", "out"], window[2 if places == (0, 1) else 0 :]]
    r = random.Random(3)
    texts += [[w if r.random() > 0.2 else "other" for w in [*r.choice(items)[1], *r.choice(items)[1]]] for _ in range(100)]
    docs = list(enumerate(texts))
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(t)) for k, t in rows], f"{key} long, text string")
    rows = D.find_overlaps(frame(docs, "doc_id"), frame(items, "item_id")).collect()
    assert {(r.doc_id, r.item_id): (r.best, r.matched, -r.doc_start) for r in rows} == brute(docs, items)
