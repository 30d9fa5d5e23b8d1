import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.common import Scratch

from . import frames


def test_exact_sizes_gapless_slots_and_all_rows(spark):
    rows = frames.corpus(6)
    df = frames.clashing(spark.createDataFrame(rows, frames.DOC_SCHEMA).repartition(5))
    out = sharding.shuffle(df, Scratch(spark, "t"), ["doc_id", "text"], shards=8).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted((r[:2] for r in rows), key=repr)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_small_and_empty_tables(spark):
    df = spark.createDataFrame([(i,) for i in range(3)], "doc_id long")
    assert sorted(r.shard for r in sharding.shuffle(df, Scratch(spark, "t"), ["doc_id"]).collect()) == [0, 1, 2]
    assert sharding.shuffle(df.limit(0), Scratch(spark, "t"), ["doc_id"]).count() == 0


def test_cells_keep_slots_gapless(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL", 7)
    out = sharding.shuffle(spark.range(500), Scratch(spark, "t"), ["id"], shards=3)
    for s, n in ((0, 167), (1, 167), (2, 166)):
        assert [r.slot for r in out.where(F.col("shard") == s).orderBy("slot").collect()] == list(range(n))


def test_matrix_sums_and_law():
    rng = np.random.default_rng(1)
    blocks, sizes = np.array([5, 0, 30, 12]), sharding.shard_sizes(47, 4)
    total = np.zeros((4, 4))
    for _ in range(3000):
        m = sharding.communication_matrix(blocks, sizes, rng)
        assert (m.sum(axis=1) == blocks).all() and (m.sum(axis=0) == sizes).all()
        total += m
    assert np.abs(total / 3000 - np.outer(blocks, sizes) / 47).max() < 0.2
    big = sharding._hypergeometric(3 * 10**9, 10**9, 10_000, rng)
    assert abs(big - 7500) < 300
