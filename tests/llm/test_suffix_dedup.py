import hashlib
import time
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffix_dedup as S

from .conftest import prose


def brute(texts):
    """Removed runs of each of a list of byte strings."""
    count = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        covered = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - 399):
            if count[t[i : i + 400]] > 1:
                covered[i + 1 : i + 401] = True
        edges = np.flatnonzero(covered[1:] != covered[:-1])
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def compare(docs):
    rows = docs.collect()
    expected = Counter()
    texts = [(r.text or "").encode() for r in rows]
    for r, t, spans in zip(rows, texts, brute(texts), strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)], strict=True))
        expected[r.doc_id, len(t), tuple(spans), kept] += 1
    found = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in S.remove_repeats(docs).collect())
    assert found == expected


def test_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


@pytest.mark.parametrize(("split", "large"), [(S.SPLIT, S.LARGE), (1, S.LARGE), (1, 1)])
def test_planted(spark, monkeypatch, split, large):
    monkeypatch.setattr(S, "SPLIT", split)
    monkeypatch.setattr(S, "LARGE", large)
    base, passage = prose(1, 500), prose(2, 120)[:420]
    texts = [base, base, base[:900] + "X" + base[901:], base[:399], "start " + base[50:449], "start " + base[50:450], prose(3, 60) + passage + prose(4, 70), passage + prose(5, 50), prose(6, 40) + passage[:400], "ab" * 500, "z" * 401, "z" * 400, "é" * 201, passage[1:] + "!"]
    texts += [base[k : k + 700] + f" {k}" for k in range(0, 1200, 61)]
    compare(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))


def test_sample(sample):
    compare(sample)


def test_small_blocks_and_segments_change_nothing(spark, monkeypatch):
    base = prose(11, 900)
    texts = [base, prose(12, 300) + base[1000:2200], base[500:1700] + prose(13, 100), base[:3000] + base[200:800], *(prose(20 + i, 30) + base[700:1500] + prose(40 + i, 30) for i in range(12))]
    buckets = [bytes(t, "utf-8") for t in texts]
    data = np.frombuffer(b"".join(buckets), np.uint8)
    place, first, last, h, _ = S.anchors(data, np.cumsum([len(b) for b in buckets]))
    order = np.argsort(h, kind="stable")
    args = ([int(x) for x in h[order].astype(np.int64)], [data[a : b + 400].tobytes() for a, b in zip(first[order], last[order], strict=True)], (place - last)[order].tolist(), (place - first)[order].tolist())
    one = sorted(S.bucket_marks(*args))
    monkeypatch.setattr(S, "BLOCK", 2000)
    spread = {(c, w) for c, a, b in S.bucket_marks(*args) for w in range(a, b + 1)}
    assert spread == {(c, w) for c, a, b in one for w in range(a, b + 1)} and spread
    kept = S.SEGMENT
    try:
        S.SEGMENT = 1500
        parts = list(S._segments([1, 2], buckets[:2]))
        windows = sorted((i, s + k) for g in parts for i, s, t in g for k in range(len(t) - 399))
        assert windows == [(i, k) for i, t in ((1, buckets[0]), (2, buckets[1])) for k in range(len(t) - 399)]
    finally:
        S.SEGMENT = kept


def test_query(spark):
    rows = S.op10_suffix_array_dedup(spark, "/root/testdata/sf0.001")
    assert rows.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    row = rows.filter("n_spans = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(f"doc_id = {row.doc_id}").first().text
    assert row.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(edge_docs, no_docs):
    compare(edge_docs)
    assert S.remove_repeats(no_docs).count() == 0


def test_long_texts_across_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 3000)
    long = prose(31, 4000)
    compare(spark.createDataFrame([(1, long), (2, prose(32, 50) + long[5000:9000] + prose(33, 900)), (3, "y" * 9000), (4, long[2500:3500])], "doc_id long, text string"))


def test_many_rows_without_id(spark):
    """1,500 different texts of 1.5 KB without doc_id that share one passage take no more than with ids of their own."""
    passage = prose(51, 100)[:450]
    texts = [prose(1000 + i, 90)[:500] + passage + prose(5000 + i, 90)[:500] for i in range(1500)]
    start = time.monotonic()
    rows = S.remove_repeats(spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)).collect()
    assert time.monotonic() - start < 60
    assert len(rows) == 1500 and all(sum(s.stop - s.start for s in r.spans) >= 450 for r in rows)
