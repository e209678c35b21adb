import math
from collections import Counter, defaultdict

import numpy as np

from tessera.llm import quality_model as Q
from tessera.llm.common import Scratch

TRAIN = ["the cat sat on the mat", "the cat ate the fish", "a dog sat on the log.", "the cat sat"]


def brute(train, vocabulary):
    """Interpolated modified Kneser-Ney by its definition."""
    c3 = Counter()
    for t in train:
        w = ["<s>", "<s>", *(x.decode() for x in Q.words(t.encode()))]
        c3.update(zip(w, w[1:], w[2:], strict=False))
    c2, c1 = Counter(g[1:] for g in c3), Counter()
    c1.update(g[1:] for g in c2)

    def model(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(x, 0.1), k + 0.9) for k, x in enumerate(raw)]
        total, left = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += min(d[min(c, 3) - 1], c)
        return (lambda g: max(counts[g] - d[min(counts[g], 3) - 1], 0) / total[g[:-1]] if counts[g] else 0.0), (lambda h: left[h] / total[h] if h in total else 1.0)

    (p3, g3), (p2, g2), (p1, g1) = map(model, (c3, c2, c1))
    size = len(vocabulary) + 1

    def p(a, b, w):
        return p3((a, b, w)) + g3((a, b)) * (p2((b, w)) + g2((b,)) * (p1((w,)) + g1(()) / size))

    return p


def test_probabilities(spark):
    model = Q.train(spark.createDataFrame([(t,) for t in TRAIN], "text string"), Scratch(spark))
    p = brute(TRAIN, model.vocabulary)
    texts = ["the cat sat on the log", "a fish", "unknown words on the mat", "the"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in Q.score(docs, model).collect():
        words = ["<s>", "<s>", *texts[r.doc_id].split()]
        expected = -sum(math.log(p(*words[i : i + 3])) for i in range(len(words) - 2))
        assert math.isclose(r.nll, expected, rel_tol=1e-5), texts[r.doc_id]
    every = [*(w.decode() for w in model.vocabulary), "<unknown>"]
    for context in (("<s>", "<s>"), ("the", "cat"), ("on", "fish"), ("nowhere", "seen")):
        assert math.isclose(sum(p(*context, w) for w in every), 1)


def test_held_out_junk(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = Q.classify(spark.read.parquet(f"{d}/documents.parquet").filter("doc_id < 4000"), labels, train_docs=600).join(labels, "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in rows.groupBy("quality", "kept").count().collect()}
    assert n[1, True] >= 0.97 * (n[1, True] + n.get((1, False), 0))
    assert n[0, False] >= 0.4 * (n[0, False] + n[0, True])


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(6, 1, 0), (6, 1, None), (9, 1, 0), (12, 1, 0), (None, 1, 0), (8, 0, 0), (13, None, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in Q.classify(edge_docs, labels).collect()}
    assert len(found) == edge_docs.select("doc_id").distinct().count()
    assert not found[1].kept and found[1].perplexity is None and found[1].n_words == 0
    assert Q.classify(edge_docs, labels).count() == edge_docs.count()
    assert Q.classify(no_docs, labels).count() == 0
    alone = Q.classify(edge_docs, labels.limit(0)).collect()
    assert all(r.kept == (r.n_words > 0) for r in alone)
    assert np.isfinite([r.perplexity for r in alone if r.n_words]).all()


def test_trains_on_half_of_the_trusted_texts_whole(spark, monkeypatch):
    """At any number of documents and any length: no count of trained documents that stays the same."""
    taken, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda texts, scratch: taken.append(texts.selectExpr("count(*)", "max(length(text))").first()) or train(texts, scratch))
    n = 14_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word ', id, if(id % 10 = 0, repeat(' long text', 2500), '')) AS text", "'en' AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    rows = Q.classify(docs, labels)
    assert 0.48 * n < taken[0][0] < 0.52 * n and taken[0][1] > 25_000
    assert rows.count() == n


def test_tables_stay_in_shards(spark, monkeypatch):
    """No bound on the tables' size, and the scores do not depend on how keys and texts are dealt."""
    monkeypatch.setattr(Q, "MODEL_BYTES", 0, raising=False)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*TRAIN, "", None, "a fish on the log"])], "doc_id long, text string, lang string")
    model = Q.train(docs.limit(4), Scratch(spark))
    found = sorted(map(tuple, Q.score(docs, model).collect()))
    for name, value in (("LEAST_SHARDS", 3), ("SHARD_KEYS", 5), ("BLOCK_WORDS", 4), ("BLOCK_DOCS", 2)):
        monkeypatch.setattr(Q, name, value)
    again = sorted(map(tuple, Q.score(docs, model).collect()))
    assert [r[:3] for r in again] == [r[:3] for r in found] and np.allclose([r[3] for r in again], [r[3] for r in found], atol=1e-5)


def test_slices_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate([*TRAIN, "", None, "a fish on the log"])], "doc_id long, text string, lang string")
    found = sorted(map(tuple, Q.score(docs, Q.train(docs.limit(4), Scratch(spark))).collect()))
    monkeypatch.setattr(Q, "SLICE_BYTES", 10)
    again = sorted(map(tuple, Q.score(docs, Q.train(docs.limit(4), Scratch(spark))).collect()))
    assert [r[:3] for r in again] == [r[:3] for r in found] and np.allclose([r[3] for r in again], [r[3] for r in found], atol=1e-5)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(1)
    values = {"a": np.round(np.exp(rng.normal(8, 1, 500)), 4), "b": np.full(40, 3.5), "": np.round(rng.uniform(7, 7.0001, 101), 4), "c": np.array([2.0])}
    rows = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v], "lang_key string, perplexity double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = dict(Q.quantiles(rows, q).collect())
        expected = {k: np.quantile(v, q) for k, v in values.items()} | {None: np.quantile(np.concatenate(list(values.values())), q)}
        assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], rel_tol=1e-12) for k in got)
    assert Q.quantiles(rows.limit(0), 0.5).count() == 0


def test_words_of_long_texts_are_hashed_in_pieces(monkeypatch):
    texts = [b"", b" \n ", b"one two, two (three)\x0bfour\x0cfive", b"x" * 300, b"a b  c\td " * 50, b"\xc3\xa9t\xc3\xa9 . ; 'don't'", b"one"]
    hashes, n = Q.hashed(texts)
    assert n.tolist() == [len(Q.words(t)) for t in texts]
    every = [w for t in texts for w in Q.words(t)]
    assert len(set(zip(every, hashes.tolist(), strict=True))) == len(set(every)) == len(set(hashes.tolist()))
    monkeypatch.setattr(Q, "_PIECE", 37)
    cut, m = Q.hashed(texts)
    assert np.array_equal(cut, hashes) and np.array_equal(m, n)
    assert [x.tolist() for x in Q.hashed([])] == [[], []]


def test_model_lies_still_while_documents_are_scored(spark):
    """The model is written in buckets of shards: scoring shuffles what documents ask, not the model."""
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TRAIN)], "doc_id long, text string, lang string")
    model = Q.train(docs, Scratch(spark))
    plan = Q._score(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    assert plan.count("hashpartitioning(shard") == 1
