import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import language_id as L


def test_trigrams_are_those_of_each_text():
    texts = ["Ab c", "", "1é2", "x"]
    alphabet, doc, gram, grams = L.trigrams(texts)
    got = sorted((int(d), "".join(chr(alphabet[i]) if i else "_" for i in grams[g])) for d, g in zip(doc, gram, strict=True))
    assert got == sorted([(0, "_ab"), (0, "ab_"), (0, "_c_"), (2, "_é_"), (3, "_x_")])


def test_vectors_are_bundles_of_bound_letters():
    vectors, total = L.document_vectors(["abca"], 64)
    v = lambda c: L.letter_vector(0 if c == "_" else ord(c), 64).astype(int)
    expected = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in ("_ab", "abc", "bca", "ca_"))
    assert total[0] == 4 and np.array_equal(vectors[0], expected)


def test_pieces_of_a_long_text_count_as_one(monkeypatch):
    text = " ".join(["eine", "lange", "straße", "hier"] * 500)
    whole, _ = L.document_vectors([text], 64)
    monkeypatch.setattr(L, "_CHUNK", 333)
    cut, _ = L.document_vectors([text], 64)
    assert np.allclose(whole, cut)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = L.op4_hyperdimensional_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_nothing_but_the_text_is_used(spark, sample):
    prototypes = L.train(sample, ~L.held_out())
    a = L.predict(sample, prototypes).collect()
    b = L.predict(sample.withColumn("lang", F.lit("zz")), prototypes).collect()
    assert a == b


def test_edges(edge_docs, no_docs):
    prototypes = L.train(edge_docs, F.col("doc_id").isNotNull())
    found = {r.doc_id: r for r in L.predict(edge_docs, prototypes).collect()}
    assert set(prototypes) == {"en", "xx", "de"}
    for i in (1, 2, 3, 14):
        assert (found[i].lang_pred, found[i].score) == ("und", 0)
    assert L.predict(no_docs, prototypes).count() == 0
    assert {r.lang_pred for r in L.predict(edge_docs, L.train(no_docs, F.lit(True))).collect()} == {"und"}


def texts_of_many_letters():
    rng = np.random.default_rng(5)
    return ["".join(map(chr, rng.integers(0x4E00, 0x9FA0, 500))) for _ in range(1500)]


def test_memory_is_bounded():
    """A table of the counts of 1,500 such texts would take 8 GB."""
    for texts in (texts_of_many_letters(), ["ab c"[: 2 + i % 3] + chr(97 + i % 26) for i in range(20_000)]):
        L.document_vectors(texts[:1], L.DIM)
        tracemalloc.start()
        L.document_vectors(texts, L.DIM)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 250e6  # vectors of 20,000 texts take 82 MB of it


def test_both_ways_of_bundling_agree(monkeypatch):
    texts = [*texts_of_many_letters()[:20], "ab cd", "", "one two three four"]
    whole, n = L.document_vectors(texts, 64)
    monkeypatch.setattr(L, "_CELLS", 0)
    monkeypatch.setattr(L, "_BLOCK", 77)
    cut, m = L.document_vectors(texts, 64)
    assert np.array_equal(whole, cut) and np.array_equal(n, m)


def test_prediction_is_that_of_a_plain_version(spark, sample):
    """Vectors summed trigram by trigram, prototypes document by document."""
    dim = 256

    def vector(text):
        s = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        s = " ".join(["", *s.split(), ""])
        out, n = np.zeros(dim), 0
        v = lambda c: L.letter_vector(0 if c == " " else ord(c), dim).astype(int)
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            if b != " ":
                out += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
                n += 1
        return out, n

    rows = [r for r in sample.collect() if r.text and len(r.text) < 4000][:60]
    vectors = {r.doc_id: vector(r.text) for r in rows}
    sums: dict = {}
    for r in rows:
        if r.lang and r.doc_id % 3 and vectors[r.doc_id][1]:
            sums[r.lang] = sums.get(r.lang, 0) + vectors[r.doc_id][0] / vectors[r.doc_id][1]
    docs = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.predict(docs, L.train(docs, F.col("doc_id") % 3 != 0, dim), dim).collect()}
    for r in rows:
        v, n = vectors[r.doc_id]
        if n:
            cosine = {x: v @ s / np.linalg.norm(v) / np.linalg.norm(s) for x, s in sums.items()}
            assert abs(got[r.doc_id].score - max(0, max(cosine.values()))) < 1e-4
            assert cosine[got[r.doc_id].lang_pred] > max(cosine.values()) - 1e-5
