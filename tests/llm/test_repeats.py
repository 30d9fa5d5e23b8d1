import collections
import hashlib
import random

import pytest

from tidemark.llm import repeats
from tidemark.llm.common import Scratch

from . import frames


def brute(texts, window):
    seen = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        seen.update(b[i:i + window] for i in range(len(b) - window + 1))
    out = []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if seen[b[i:i + window]] > 1:
                gone[i:i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, window):
    df = frames.clashing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    out = repeats.remove_repeats(df, Scratch(spark, "t"), ["doc_id"], window=window, with_text=True).collect()
    return {r.row.doc_id: r for r in out}


@pytest.mark.parametrize(("seed", "window", "group"), [(0, 60, 2000), (1, 45, 3), (2, 400, 2)])
def test_matches_every_window(spark, monkeypatch, seed, window, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(window // 2, 3 * window))) for _ in range(5)]
    kinds = [
        lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 2 * window))), lambda: rng.choice(passages),
        lambda: "x" * rng.randint(1, 3 * window), lambda: "ab" * rng.randint(1, window)]
    texts = [None, "", "x"] + ["".join(kinds[rng.choice([0, 0, 0, 1, 1, 2, 3])]() for _ in range(rng.randint(0, 5))) for _ in range(70)]
    got = run(spark, texts, window)
    want = brute(texts, window)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(len(texts)))] == want
    for i, t in enumerate(texts):  # characters stay whole
        assert (t is None and got[i].kept_text is None) or len((got[i].kept_text or "").encode()) >= got[i].n_bytes - got[i].n_removed


def test_contract_window_on_hard_cases(spark):
    texts = [t for _, t, *_ in frames.corpus(2)]
    got = run(spark, texts, 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(len(texts)))] == brute(texts, 400)


def test_passages_are_told_beside_the_byte_windows(spark):
    rng = random.Random(9)
    passage = " ".join(f"{rng.choice('abcd')}{rng.randrange(90)}" for _ in range(55))
    long = frames.words(rng, 120, 10**6)
    assert len(passage) < 400 < len(long)
    texts = [f"{frames.words(rng, 30, 10**6)} {p} {frames.words(rng, 30, 10**6)}" for p in (passage, passage, long, long, "alone")] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r for r in repeats.remove_repeats(df, Scratch(spark, "t"), ["doc_id"], words=51).collect()}
    want = brute(texts, 400)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (got[i] for i in range(len(texts)))] == want
    assert [got[i].n_passages for i in range(7)] == [1, 1, 1, 1, 0, 0, 0]
    assert [got[i].passage_bytes for i in (0, 2, 4)] == [len(passage), len(long), 0] and want[0][1] == 0 < want[2][1]


def test_empty_table(spark):
    assert run(spark, [], 400) == {}


def test_long_text_is_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(repeats.textnum, "PIECE", 300)
    import numpy as np
    import pyarrow as pa
    rng = random.Random(5)
    text = "".join(rng.choice("abc") for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([text])], ["rid", "text"])
    rows = [r for b in repeats._anchors(60, 30)([batch]) for r in b.to_pylist()]
    covered = np.zeros(2000, int)
    for r in rows:
        covered[r["lo"]:r["lo"] + r["n"]] += 1
    assert (covered[:2000 - 59] == 1).all() and not covered[2000 - 59:].any()


def test_matching_statistics():
    texts = [b"banana", b"bandana", b"nab\0nab", b""]
    index = repeats.RunLengthIndex(texts)
    got = index.matching_statistics()
    for t, start in zip(texts, index.first.tolist(), strict=True):
        for i in range(len(t)):
            best = max((k for k in range(len(t) - i + 1) for u, s in zip(texts, index.first.tolist(), strict=True)
                        for j in range(len(u)) if s + j != start + i and u[j:j + k] == t[i:i + k] and len(u) - j >= k), default=0)
            assert got[start + i] == best
    assert index.lengths.sum() == index.n
