"""What the stages without a contract of their own in the thin queries have to do."""

import random
import re

import corpus_pipeline as pipeline
from tidemark.llm import repeats
from tidemark.llm.common import Scratch

from . import frames
from .test_near_dedup import shingle_set


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], frames.DOC_SCHEMA)


def test_near_copies_from_eighty_percent_are_linked(spark):
    rng = random.Random(4)
    texts, far = [], []
    for k in range(30):
        # Of 180 words, five or more apart, each changed word takes five of 176 shingles.
        base = frames.words(rng, 180, 5000).split()
        copy = list(base)
        for j in range(3 if k % 3 else 6):
            copy[10 + 25 * j] = f"changed{k}"
        if not k % 3:
            far.append(2 * k + 1)
        texts += [" ".join(base), " ".join(copy)]
    sets = [shingle_set(t) for t in texts]
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 60, 2)]
    assert all(0.8 <= x < 0.85 if k % 3 else x < 0.8 for k, x in enumerate(alike))
    left = {r.doc_id for r in pipeline.near_duplicates(spark, documents(spark, texts), "").collect()}
    assert left == {*range(0, 60, 2), *far}


def test_passages_of_over_fifty_words_go(spark):
    rng = random.Random(8)
    passages = ["\n ".join(f"{rng.choice('abcdefgh')}{rng.randrange(100)}" for _ in range(n)) for n in (51, 51, 55, 60, 65)]
    short = " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(100)}" for _ in range(50))
    assert all(len(p) < 400 for p in passages)
    plain, texts = [], []
    for i in range(40):
        head, tail = frames.words(rng, 60, 10**6), frames.words(rng, 60, 10**6)
        inner = passages[i % 5] if i < 30 else short
        plain.append(f"{head}  {tail}" if i < 30 else f"{head} {short} {tail}")
        texts.append(f"{head} {inner} {tail}")
    got = {r.doc_id: r for r in pipeline.repeated_passages(spark, documents(spark, texts), "").collect()}
    assert [got[i].text for i in range(40)] == plain
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_word_runs_match_every_window(spark, monkeypatch):
    monkeypatch.setattr(repeats.textnum, "PIECE", 400)
    rng = random.Random(3)
    passages = [[rng.choice("abc") for _ in range(rng.randint(4, 30))] for _ in range(6)]
    texts = [None, "", "a"] + [" ".join(w for _ in range(rng.randint(1, 6)) for w in rng.choice(
        [rng.choice(passages), [f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 20))], ["x"] * rng.randint(1, 30)])) for _ in range(60)]
    width, seen, want = 9, {}, {}
    for i, t in enumerate(texts):
        w = list(re.finditer(r"\S+", t or ""))
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(x.group() for x in w[k:k + width]), []).append((i, w[k].start(), w[k + width - 1].end()))
    for places in seen.values():
        for i, s, e in places if len(places) > 1 else []:
            want.setdefault(i, []).append((s, e))
    rows = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    got = {}
    for r in repeats.repeated_word_spans(rows, Scratch(spark, "t"), width).collect():
        got.setdefault(r.rid, []).append((r.s, r.e))
    cover = lambda spans: {x for s, e in spans for x in range(s, e)}
    assert {i: cover(s) for i, s in got.items()} == {i: cover(s) for i, s in want.items()}
