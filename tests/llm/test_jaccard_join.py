import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import jaccard_join as J
from tessera.llm.common import Scratch
from tessera.llm.components import connected_components

from .conftest import prose


def ngrams(text, n):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


def brute(texts, rule):
    sets, parent, holders = {i: ngrams(t, rule.n) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = defaultdict(int)
        for g in sets[i]:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if rule.linked(n, len(sets[i]), len(sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(count):
    """Families of texts at all degrees of change, many of them around the threshold."""
    rng, texts = np.random.default_rng(5), {}
    for family in range(count):
        words = prose(100 + family, int(rng.integers(3, 200))).split()
        for _ in range(8):
            copy = list(words)
            for _ in range(int(rng.integers(0, max(2, len(words) // 20)))):
                copy[int(rng.integers(len(copy)))] = f"new{rng.integers(1000)}"
            if rng.random() < 0.3:
                copy += [f"tail{rng.integers(1000)}" for _ in range(int(rng.integers(1, 9)))]
            texts[len(texts)] = " ".join(copy)
    return texts


@pytest.mark.parametrize("rule", [J.Rule(), J.Rule(5, 80, 100), J.Rule(3, 60, 100)])
@pytest.mark.parametrize("tile", [J.TILE, 3])
def test_components(spark, rule, tile):
    texts = near_copies(30)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(docs, rule, tile).collect()}
    assert found == brute(texts, rule)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for rule in (J.Rule(), J.Rule(5, 80, 100)):
        for _ in range(400):
            n = int(rng.integers(1, 400))
            a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
            swap = int(rng.integers(0, max(1, n // 8) + 1))
            b = np.unique(np.concatenate([a[swap:], rng.integers(1, 1 << 63, int(rng.integers(0, swap + 1)), dtype=np.uint64)]))
            if len(b) and not np.array_equal(a, b) and rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                assert np.intersect1d(J.signatures(a, rule), J.signatures(b, rule)).size


def test_a_large_group_of_near_copies_makes_few_rows(spark):
    base = prose(7, 200).split()
    texts = {i: " ".join([*base[: i % 190], f"w{i}", *base[i % 190 :]]) for i in range(600)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in J.jaccard_join(docs).collect()} == {0}
    sets = list(J.ngram_sets(list(texts.values()), 3))
    assert len(J.link_tile(list(texts), sets, J.Rule())) == 599


def test_sample(spark, sample):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op8_ngram_jaccard_join(spark, "/root/testdata/sf0.001").collect()}
    assert found == brute({r.doc_id: r.text for r in sample.collect()}, J.Rule())


def test_edges(edge_docs, no_docs):
    found = {r.doc_id: r for r in J.jaccard_join(edge_docs).collect()}
    texts = {r.doc_id: r.text for r in edge_docs.filter("doc_id IS NOT NULL").collect()}
    expected = brute(texts, J.Rule())
    assert {i: (r.n_shingles, r.component_id) for i, r in found.items() if i is not None} == expected
    assert found[None].component_id is None
    assert J.jaccard_join(edge_docs).count() == edge_docs.count()
    assert J.jaccard_join(no_docs).count() == 0
    left = J.one_of_each(edge_docs, J.Rule(5, 80, 100))
    assert left.columns == edge_docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id in (6, 7, 8, 12)) == [6, 12, 12]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 499), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, Scratch(spark)).collect()}
    assert all(found[i] == 0 for i in range(201)) and found[500] == found[499] == 499


def test_random_sets_share_few_signatures():
    """Unrelated sets meet by chance only, whatever their size: far less than one signature in 10,000 sets."""
    rng = np.random.default_rng(2)
    for rule in (J.Rule(), J.Rule(5, 80, 100)):
        for n in (4, 5, 7, 9, 10, 16, 30, 60, 100, 101, 180, 400):
            sets = [np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for _ in range(1500)]
            found = np.concatenate([np.unique(J.signatures(s, rule)) for s in sets])
            assert len(np.unique(found)) == len(found), (rule, n)


@pytest.mark.parametrize("tile", [J.TILE, 5])
def test_every_link(spark, tile):
    texts = near_copies(12)
    rule = J.Rule(5, 80, 100)
    docs = spark.createDataFrame([*texts.items(), (1000, texts[3]), (None, texts[3]), (1001, "")], "doc_id long, text string").repartition(3)
    links, holders = J.jaccard_links(docs, rule, tile)
    sets = {}
    for i, t in sorted(texts.items()):
        sets.setdefault(frozenset(ngrams(t, 5)), i)
    named = list(sets.items())
    expected = {(min(a, b), max(a, b)) for k, (x, a) in enumerate(named) for y, b in named[:k] if rule.linked(len(x & y), len(x), len(y))}
    assert {tuple(r) for r in links.collect()} == expected and len(expected) > 40
    count = defaultdict(int)
    for a, b in expected:
        count[a] += 1
        count[b] += 1
    assert {(r.rep, r.doc_id, r.n_links) for r in holders.collect()} == {(n, i, count[n]) for i, t in [*texts.items(), (1000, texts[3])] for n in [sets[frozenset(ngrams(t, 5))]]}


def test_a_large_group_sends_each_text_a_bounded_number_of_times(spark, monkeypatch):
    base = prose(7, 100).split()
    texts = {i: " ".join([*base[: i % 90], f"w{i}", *base[i % 90 :]]) for i in range(2000)}
    sent, link = [], J.link_tiles
    monkeypatch.setattr(J, "link_tiles", lambda rows, rule, every=False: sent.append(rows.count()) or link(rows, rule, every))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.component_id for r in J.jaccard_join(docs, J.Rule(), 40).collect()} == {0}
    tiles = J._tiles(docs, J.Rule(), 40, Scratch(spark)).members
    assert sum(sent) < 3 * tiles.count() + 60 * tiles.selectExpr("sum(1 / m * k)").first()[0]


def test_only_the_result_is_kept(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x y z")], "doc_id long, text string")
    scratch = Scratch(spark)
    found = J.jaccard_join(docs, scratch=scratch)
    assert scratch.names == ["result"]
    assert sorted(map(tuple, found.collect())) == [(1, 2, 1), (2, 2, 1), (3, 1, 3)]
