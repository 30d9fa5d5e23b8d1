import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemark.llm import packing
from tidemark.llm.common import Scratch
from tidemark.llm.tokens import WordTokenizer

from . import frames

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark):
    rows = frames.corpus(5)
    df = frames.clashing(spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], frames.DOC_SCHEMA).repartition(3))
    got = packing.pack(df, Scratch(spark, "t"), ["doc_id"], VOCABULARY, capacity=64).collect()
    assert check(got, 64) == pytest.approx(-(-sum(r.length for r in got) // 64), rel=0.15)
    model = WordTokenizer(VOCABULARY)
    pieces = {(r.row.doc_id, r.piece): r for r in got}
    assert len(pieces) == len(got)
    for i, (_, text, *_) in enumerate(rows):
        ids = model.whole(text or "") + b"\0" * 4
        for k in range(-(-len(ids) // 256)):
            r, part = pieces.pop((i, k)), ids[256 * k:256 * k + 256]
            assert (r.start, r.length, r.ids_crc32) == (64 * k, len(part) // 4, zlib.crc32(part))
    assert not pieces


def test_empty_table(spark):
    df = spark.createDataFrame([], frames.DOC_SCHEMA)
    assert packing.pack(df, Scratch(spark, "t"), ["doc_id"], VOCABULARY).count() == 0


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(4)
    lengths = np.minimum(2048, np.maximum(1, rng.lognormal(6.3, 1.0, 30_000).astype(int)))
    histogram = {int(n): int(k) for n, k in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan(histogram)
    used = {}
    for kinds, repeats in plan.kinds:
        assert sum(kinds) <= 2048 and repeats > 0
        for n in kinds:
            used[n] = used.get(n, 0) + repeats
    assert used == histogram
    assert plan.sequences <= 1.002 * -(-lengths.sum() // 2048)


def test_fit_recovers_patterns():
    some = packing.patterns(np.array([10, 20, 30, 40, 60]), 80)
    counts = np.zeros(81)
    for p in some[:4]:
        for n in p[p > 0]:
            counts[n] += 1000
    x = packing.fit(some, counts, 3000)
    back = np.bincount(some.ravel(), np.repeat(x, 3), 81)
    assert np.abs(back[1:] - counts[1:]).max() < 20 and (x >= 0).all()


def test_remembered_chunks_give_the_library_s_ids():
    model = WordTokenizer(VOCABULARY)
    rng = random.Random(1)
    signs = [*"abÀéßΣσςİıſ'’ \t\n\x1c\x85\xa0\u2028\u200b0١９<|>.,!£中文あ한ا-_@#", "\u0301", "<|endoftext|>", "'ll", "ﬁ"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 14)))
        assert model.encode(text) == model.whole(text)
