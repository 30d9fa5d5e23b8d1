import re

import corpus_pipeline as pipeline
from tidemark.session import fresh_path

from .test_near_dedup import shingle_set

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, texts, before = docs.columns, {}, docs
    folder = fresh_path(spark, "pipeline-test")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        if k < 4:
            assert after.columns == columns, name
            texts[k] = {r.doc_id: r.text for r in after.collect()}
        before = after
    start = {r.doc_id: r.text for r in docs.collect()}
    # Quality: nothing short stays, texts are as they were.
    assert set(texts[0]) < set(start) and all(len(re.findall(r"[^\x20\x09-\x0D]+", t)) >= 50 and start[i] == t for i, t in texts[0].items())
    # Near-duplicates: the first document of every component of near copies stays.
    sets = {i: shingle_set(t) for i, t in texts[0].items()}
    near = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    first = {i: i for i in texts[0]}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near(sets[a], sets[b]) and first[a] != first[b]:
                low, high = sorted((first[a], first[b]))
                first = {i: low if f == high else f for i, f in first.items()}
    assert set(texts[1]) == set(first.values())
    # Repeats: all rows stay; no string of 400 bytes of the input that occurred twice is left.
    assert set(texts[2]) == set(texts[1])
    seen, twice = set(), set()
    for t in texts[1].values():
        b = t.encode()
        for i in range(len(b) - 399):
            h = hash(b[i:i + 400])
            (twice if h in seen else seen).add(h)
    assert not any(hash(t.encode()[i:i + 400]) in twice for t in texts[2].values() for i in range(len(t.encode()) - 399))
    # Decontamination: what goes holds an item.
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = set(texts[2]) - set(texts[3])
    assert all(any(x in texts[2][i] for x in items) for i in gone)
    assert not any(x in t for x in items for t in texts[3].values())
    # Packing: every document that is left, in full sequences.
    packed = before.collect()
    assert {r.doc_id for r in packed} == set(texts[3])
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= 1.02 * -(-sum(used.values()) // 2048) + 1


def test_two_runs_can_both_be_read(spark):
    first = pipeline.run(spark, SF)
    second = pipeline.run(spark, SF)
    rows = [sorted((r.doc_id, r.piece, r.length) for r in out.collect()) for out in (first, second)]
    assert rows[0] == rows[1] and 0 < len({x[0] for x in rows[0]}) <= 200
