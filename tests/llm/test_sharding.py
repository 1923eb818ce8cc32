import zlib
from collections import defaultdict

import pytest

from spanforge.llm.queries import op8_sampled_splitters
from spanforge.llm.sharding import shard_by_bytes


def assert_sharded(rows, texts, shards, id_of=lambda r: r.doc_id):
    got = sorted((id_of(r), r.size, r.text_crc32) for r in rows)
    assert got == sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in texts)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))
    return [sizes[s] for s in range(shards)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
    out = op8_sampled_splitters(spark, f"/root/testdata/{sf}")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes = assert_sharded(out.collect(), [(d.doc_id, d.text) for d in docs], 8)
    assert max(sizes) - min(sizes) < 2 * max(len(d.text.encode()) + 1 for d in docs)


def test_hot_group_is_subdivided(spark):
    rows = [(i, "copy " * 20 if i % 3 else f"own {i}", "z") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size string").repartition(4)
    sizes = assert_sharded(shard_by_bytes(df, ranges=16, draws=4).collect(), [r[:2] for r in rows], 8)
    assert max(sizes) - min(sizes) < 2 * 102


def test_hostile_rows(spark):
    rows = [(None, None, 1), (1, "", 1), (1, "", 1), (2, "ü" * 5000, 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    assert_sharded(shard_by_bytes(df).collect(), [(-1 if k is None else k, t) for k, t, _ in rows], 8,
                   lambda r: -1 if r.doc_id is None else r.doc_id)
    assert shard_by_bytes(df.limit(0)).count() == 0
