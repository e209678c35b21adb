import zlib
from collections import defaultdict

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from tessera.llm import packing


def check(rows, texts, capacity=1024):
    """Pieces are cut by the rule, ids are the tokenizer's, places are gapless and within capacity."""
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        n = -(-len(ids) // capacity)
        assert [p["piece"] for p in pieces] == list(range(n))
        assert all(p["length"] == capacity for p in pieces[1:])
        at = 0
        for p in pieces:
            assert p["start"] == at
            assert bytes(p["ids"]) == ids[at : at + p["length"]].tobytes()
            at += p["length"]
        assert at == len(ids)
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity


def test_sample(sample):
    rows = [r.asDict() for r in packing.pack_documents(sample).collect()]
    check(rows, {r.doc_id: r.text for r in sample.collect()})
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= 1.02 * total / 1024 + 1


def test_query_columns(spark):
    rows = packing.op2_sum_of_squares_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r for r in packing.tokenize(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).filter("piece = 0").collect()}
    assert rows[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert all(zlib.crc32(docs[r.doc_id].ids) == r.ids_crc32 for r in rows if r.piece == 0)


def test_edges(edge_docs, no_docs):
    rows = [r.asDict() for r in packing.pack_documents(edge_docs).collect()]
    texts = {r.doc_id: r.text for r in edge_docs.filter("doc_id IS NOT NULL AND doc_id <> 12").collect()}
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r["doc_id"]] += 1
    assert by_doc[1] == by_doc[2] == 1 and by_doc[12] == 2 and by_doc[None] == 2
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    tok = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for i in (9, 10, 15, 16):
        ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]))
        assert np.frombuffer(ids, "<u4").tolist() == [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
    assert packing.pack_documents(no_docs).count() == 0


def test_rule():
    """Each choice is the best by the sum of squares among the open sequences with room."""
    rng = np.random.default_rng(3)
    packer, gaps = packing.SumOfSquares(64), {}
    for size in rng.integers(1, 65, 400).tolist():
        def cost(counts):
            return sum(n * n for g, n in counts.items() if g)

        counts = defaultdict(int)
        for g in gaps.values():
            counts[g] += 1
        options = []
        for g in [g for g in counts if g >= size and counts[g]]:
            after = dict(counts)
            after[g] -= 1
            after[g - size] = after.get(g - size, 0) + 1
            options.append((cost(after), g))
        b, offset = packer.place(size)
        if options and size < 64:
            assert gaps[b] == min(options)[1]
        else:
            assert b not in gaps
        gaps[b] = gaps.get(b, 64) - size
        assert offset == 64 - gaps[b] - size
