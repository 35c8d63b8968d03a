import zlib

import pytest

from docspark.llm import sharding


def test_sizes_slots_and_checksums(spark, docs):
    texts = [f"text {i % 7} é" for i in range(600)] + [None, "", "x" * 100_000]
    rows = sharding.shard_documents(docs(*texts, lang=["x"] * len(texts))).collect()
    assert len(rows) == len(texts)
    by_shard = {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 5 < sum(r.grown_shard == 24 for r in rows) < 60


def test_repeated_rows_and_no_rows(spark, docs):
    df = docs("a", "b").union(docs("a", "b"))
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == 4 and len({(r.shard, r.slot) for r in rows}) == 4
    assert sharding.shard_documents(df.where("false")).count() == 0


@pytest.mark.parametrize("shards", [24, 25, 30])
def test_one_more_shard_takes_rows_only_into_itself(spark, shards):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    out = sharding.place(sharding.place(df, "doc_id", sharding.tree(shards, 24)), "doc_id", sharding.tree(shards + 1, 24), "grown")
    moved = out.where("shard <> grown").collect()
    assert moved and {r.grown for r in moved} == {shards}


def test_a_changed_weight_moves_rows_to_or_from_its_subtree_only(spark):
    light = sharding.Node("root", 2, (sharding.Node("a", 1, shard=0), sharding.Node("b", 1, shard=1), sharding.Node("c", 1, shard=2)))
    heavy = sharding.Node("root", 3, (light.children[0], sharding.Node("b", 2, shard=1), light.children[2]))
    df = spark.range(2000).withColumnRenamed("id", "doc_id")
    out = sharding.place(sharding.place(df, "doc_id", light), "doc_id", heavy, "later").collect()
    assert {r.later for r in out if r.shard != r.later} == {1}
    assert 900 < sum(r.later == 1 for r in out) < 1100
    with pytest.raises(ValueError):
        sharding.tree(3, 4)
