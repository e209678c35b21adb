import zlib
from collections import defaultdict

from tessera.llm import sharding as S


def check(rows, shards):
    places, size = defaultdict(list), defaultdict(int)
    for r in rows:
        places[r.shard].append(r.place)
        size[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(places) <= set(range(shards))
    return size


def test_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    placed, slot_map = S.shard(docs, 4)
    rows = placed.collect()
    size = check(rows, 4)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in rows)
    assert max(size.values()) - min(size.values()) < 0.01 * sum(size.values())
    assert all(slot_map.shard_of[r.virtual_slot] == r.shard for r in rows)
    query = S.op9_virtual_slot_sharding(spark, "/root/testdata/sf0.001")
    assert query.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and query.count() == 200


def test_map_versions(spark, tmp_path):
    sizes = [(i * 37) % 101 + 1 for i in range(256)]
    one = S.SlotMap.build(sizes, 8)
    two = one.rebalance(sizes, 9)
    assert two.version == 2 and set(two.moved) == {i for i in range(256) if one.shard_of[i] != two.shard_of[i]}
    assert all(two.shard_of[i] == 8 for i in two.moved)
    load = [sum(b for b, s in zip(sizes, two.shard_of, strict=True) if s == k) for k in range(9)]
    assert max(load) - min(load) <= 0.1 * sum(load) / 9
    grown = list(sizes)
    grown[one.shard_of.index(0)] += 500
    assert len(one.rebalance(grown).moved) < 40
    one.save(spark, str(tmp_path))
    two.save(spark, str(tmp_path))
    assert S.SlotMap.load(spark, str(tmp_path)).shard_of == two.shard_of
    assert S.SlotMap.load(spark, str(tmp_path), 1).shard_of == one.shard_of


def test_edges(edge_docs, no_docs):
    rows = S.shard(edge_docs, 3)[0].collect()
    assert len(rows) == edge_docs.count()
    check(rows, 3)
    assert {r.doc_id: r.size for r in rows}[1] == 1
    assert S.shard(no_docs, 3)[0].count() == 0
