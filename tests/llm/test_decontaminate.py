import random

import numpy as np
import pyarrow as pa

from tidemark.llm import decontaminate as d
from tidemark.llm.common import Scratch

from . import frames


def brute_distance(item, text):
    """Least word edits between the item and any part of the text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def planted(seed, edits):
    rng = random.Random(seed)
    items = [frames.words(rng, rng.randint(15, 45)) for _ in range(12)]
    docs = []
    for i in range(60):
        body = frames.words(rng, rng.randint(0, 120)).split()
        if i % 2:
            w = items[i % 12].split()
            for _ in range(edits):
                at = rng.randrange(len(w))
                kind = rng.randrange(3)
                w[at:at + 1] = [["new"], [w[at], "more"], []][kind]
            at = rng.randrange(len(body) + 1)
            body[at:at] = w
        docs.append((i, " ".join(body)))
    return items, docs


def find(spark, items, docs):
    df = frames.clashing(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return d.leaks(df, table, ["doc_id"]).collect()


def test_finds_what_all_pairs_find(spark):
    for edits in (0, 1, 3):
        items, docs = planted(edits, edits)
        got = {(r.row.doc_id, r.item_id): r.edits for r in find(spark, items, docs)}
        want = {}
        for i, text in docs:
            for j, item in enumerate(items):
                w = item.split()
                k = brute_distance(w, text.split())
                if k <= int(0.2 * len(w) + 1e-9):
                    want[i, j] = k
        assert set(got) <= set(want)
        assert len(got) >= (1.0 if edits == 0 else 0.95) * len(want)
        assert all(got[p] == want[p] for p in got)


def test_case_punctuation_and_spans(spark):
    item = "The quick brown fox jumps over the lazy dog near the old Élan river"
    docs = [(1, "Before, «THE QUICK — brown fox»\n jumps over; the lazy dog near the old ÉLAN river! After"), (2, None), (3, ""), (None, item)]
    rows = find(spark, [item, None, "", "too short"], docs)
    assert sorted((r.row.doc_id or 0, r.item_id, r.edits) for r in rows) == [(0, 0, 0), (1, 0, 0)]
    hit = next(r for r in rows if r.row.doc_id == 1)
    assert docs[0][1].encode()[hit.start:hit.end].decode().startswith("THE QUICK") and docs[0][1].encode()[hit.start:hit.end].endswith(b"river")


def test_clean_keeps_whole_rows(spark):
    items, docs = planted(9, 0)
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(0, docs[0][1], "en", "s", 1), (None, None, None, None, None)]
    df = frames.clashing(spark.createDataFrame(rows, frames.DOC_SCHEMA))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = d.clean(df, table, Scratch(spark, "t"))
    assert out.columns == df.columns and out.count() == 32
    assert d.clean(df.limit(0), table, Scratch(spark, "t")).count() == 0
    assert d.clean(df, table.limit(0), Scratch(spark, "t")).count() == len(rows)


def test_benchmark_in_blocks(spark):
    items, _ = planted(3, 0)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    parts = list(d.blocks(table, "item_id", "text", block_bytes=300))
    assert len(parts) > 2 and sorted(i for p in parts for i in p.ids) == list(range(12))


def test_many_blocks_in_one_scan(spark):
    items, docs = planted(31, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    many = d.leaks(df, table, ["doc_id"], block_bytes=300)
    found = [sorted((r.row.doc_id, r.item_id, r.edits, r.start) for r in out.collect()) for out in (d.leaks(df, table, ["doc_id"]), many)]
    assert found[0] == found[1] and len(found[0]) >= 28
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_walk_is_equal_for_equal_windows_and_misses_few_edited():
    rng = np.random.default_rng(2)
    items = [rng.integers(1, 1 << 63, 40, dtype=np.uint64) for _ in range(40)]
    n, hard = d.repetitions(items, [8] * 40)
    assert not hard
    walk = d.Walk(n)
    copies = np.stack([d.edited(x, 8, rng) for x in items])
    a, b = walk.keys(np.stack(items)), walk.keys(copies)
    assert (walk.keys(np.stack(items)) == a).all()
    assert ((a == b).any(axis=0)).mean() >= 0.9


def test_recall_of_the_worst_class_of_lengths():
    rng = np.random.default_rng(4)
    items = [rng.integers(1, 1 << 63, size, dtype=np.uint64) for size in (6, 10, 20, 45, 80) for _ in range(60 if size == 45 else 6)]
    allowed = [len(x) // 5 for x in items]
    n, hard = d.repetitions(items, allowed)
    walk = d.Walk(n)
    for size in (6, 10, 20, 45, 80):
        if d.length_class(size) not in hard:
            own = [x for x in items if len(x) == size] * 40
            copies = np.stack([d.edited(x, size // 5, rng) for x in own[:240]])
            assert (walk.keys(np.stack(own[:240])) == walk.keys(copies)).any(axis=0).mean() >= 0.95, size
    assert d.repetitions(items, allowed, most=2)[1] == {d.length_class(x) for x in (6, 10, 20, 45, 80)}


def test_classes_without_keys_lose_nothing():
    for edits in (1, 3):
        items, docs = planted(20 + edits, edits)
        block = d.Items(list(range(len(items))), [d.words(pa.array([x]))[0] for x in items], most=0)
        assert block.keyless.all()
        batch = pa.RecordBatch.from_pylist([{"row": i, "text": t} for i, t in docs])
        got = {(r["row"], r["item_id"]): r["edits"] for b in d._search([lambda: block])([batch]) for r in b.to_pylist()}
        want = {(i, j): k for i, t in docs for j, x in enumerate(items) if (k := brute_distance(x.split(), t.split())) <= int(0.2 * len(x.split()) + 1e-9)}
        assert got == want


def test_folding_keeps_positions():
    text = "Ärger «Ω ЖИ» ÀÞ … x"
    out = d.folded(np.frombuffer(text.encode(), np.uint8)).tobytes()
    assert len(out) == len(text.encode()) and out.decode().split() == ["ärger", "ω", "жи", "àþ", "x"]
    assert len(d.words(pa.array([None, "", "a-b"]))[0]) == 2


def test_short_items_are_found_as_whole_words(spark):
    items = ["Blue Whale", "Paris", "to be or not"]
    docs = [
        (0, "The blue, whale sings"), (1, "blue old whale"), (2, "Comparison of parishes"), (3, "In PARIS."), (4, "be or not to be"),
        (5, "whale blue"), (6, "To be, or not")]
    assert sorted((r.row.doc_id, r.item_id, r.edits) for r in find(spark, items, docs)) == [(0, 0, 0), (3, 1, 0), (6, 2, 0)]


def test_scripts_without_word_spaces(spark):
    items = ["水在标准大气压下的沸点是多少摄氏度", "富士山の高さは何メートルですか", "ประเทศไทยมีกี่จังหวัด", "北京"]
    changed = items[0].replace("沸点", "冰点")
    docs = [
        (0, f"我们想知道，{items[0]}？请回答。"), (1, f"前文里说{changed}就这样"), (2, f"問題「{items[1]}」です"), (3, f"ก่อน{items[2]}หลัง"),
        (4, "我住在北京市"), (5, "完全不同的一段中文文字没有题目"), (6, "水在标准，大气压下的沸点是多少摄氏度abc")]
    rows = find(spark, items, docs)
    assert sorted((r.row.doc_id, r.item_id, r.edits) for r in rows) == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 2, 0), (4, 3, 0), (6, 0, 0)]
    hit = next(r for r in rows if r.row.doc_id == 2)
    assert docs[2][1].encode()[hit.start:hit.end].decode() == items[1]


def test_one_row_per_place_of_a_repeated_item(spark):
    rng = random.Random(6)
    item = frames.words(rng, 20)
    changed = item.split()
    changed[7] = "new"
    docs = [(0, " ".join([item] * 3)), (1, f"start {item} {' '.join(changed)} {item} end"), (2, " ".join([item] * 60)), (3, f"{item} middle {item}")]
    rows = find(spark, [item], docs)
    assert sorted(r.row.doc_id for r in rows) == [0] * 3 + [1] * 3 + [2] * 60 + [3] * 2
    assert sorted(r.edits for r in rows if r.row.doc_id == 1) == [0, 0, 1]
    for r in rows:
        assert docs[r.row.doc_id][1].encode()[r.start:r.end].decode() in (item, " ".join(changed))


def test_places_at_the_end_of_a_part_are_whole():
    item = np.arange(1, 21, dtype=np.uint64)
    worse = item.copy()
    worse[[3, 9]] = 99
    for shift in range(60):
        text = np.concatenate([np.full(shift, 77, np.uint64), *[worse] * 11, item, *[worse] * 3])
        got = d.places(item, text, 4)
        assert [x[0] for x in got] == [2] * 11 + [0] + [2] * 3
        assert [(s, e) for _, s, e in got] == [(shift + 20 * k, shift + 20 * k + 20) for k in range(15)]
