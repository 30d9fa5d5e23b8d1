import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import phrases
from tidemark.llm.common import Scratch

from . import frames


def counts_of(rows, max_words):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                f[lang or "und"].update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, threshold, top, max_words=3):
    counts, n = counts_of(rows, max_words)
    out = {}
    for lang, f in counts.items():
        cand = {}
        for p, a in f.items():
            w = p.split(" ")
            if len(w) > 1 and a >= threshold:
                cuts = [(10**6 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
                score, k = min(cuts)
                cand[p] = (a, f[" ".join(w[:k])], f[" ".join(w[k:])], score)
        kept = [p for p in cand if not any(
            len(q.split(" ")) > len(p.split(" ")) and f" {p} " in f" {q} " and 100 * cand[q][0] >= 50 * cand[p][0] for q in cand)]
        kept.sort(key=lambda p: (-cand[p][3], -cand[p][0], p.encode()))
        for rank, p in enumerate(kept[:top], 1):
            a, l, r, score = cand[p]
            out[lang, rank] = (p, a, l, r, n[lang], score)
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [rng.choice(["a", "é", "B", "😀", "zz", "Q", "x-", "ß"]) + rng.choice(["", "1", "b", "ü"]) for _ in range(25)]
    rows = []
    for _ in range(80):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "\x0b"]) for _ in range(rng.choice([0, 1, 9, 60, 200])))
        rows.append((text, rng.choice(["en", "en", "en", "fr", None])))
    return rows + [(None, "en"), ("", None), ("New  York\tcity! " * 30, "en"), ("new york " * 2000, "und"), ("x" * 9000, "en"), (" . ", "de")]


def run(spark, rows, **more):
    df = frames.clashing(spark.createDataFrame([(t, x) for t, x in rows], "text string, lang string").repartition(4)).withColumns(
        {c: F.lit("x") for c in ("p", "n", "phrase", "words", "score", "rank", "a", "w", "total")})
    return {(r.lang, r.rank): tuple(r)[2:] for r in phrases.collocations(df, Scratch(spark, "t"), **more).collect()}


@pytest.mark.parametrize(("seed", "threshold", "top", "flush", "room"), [(0, 10, 2000, 3 << 20, 1 << 16), (1, 3, 7, 500, 1), (2, 10, 40, 2000, 1)])
def test_equals_plain_counting(spark, seed, threshold, top, flush, room):
    rows = corpus(seed)
    got = run(spark, rows, threshold=threshold, top=top, limits=phrases.Limits(partition_bytes=2000, flush=flush, room=room))
    want = brute(rows, threshold, top)
    assert got == want and len({k[0] for k in got}) >= 2


def test_longer_phrases(spark):
    rows = corpus(5)
    assert run(spark, rows, threshold=4, max_words=5) == brute(rows, 4, 2000, 5)


def test_a_full_filter_changes_nothing(spark):
    rows = corpus(3)
    assert run(spark, rows, limits=phrases.Limits(filter_bytes=8)) == brute(rows, 10, 2000)


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert run(spark, [(None, None), ("", "en")]) == {}


@pytest.mark.parametrize("seed", range(20))
def test_no_frequent_key_is_lost_in_merges(seed):
    rng = np.random.default_rng(seed)
    keys = (rng.zipf(1.3, 5000) % 3000).astype(np.uint32)
    threshold = int(rng.integers(2, 40))
    summary = phrases.Summary(phrases.capacity(len(keys), threshold))
    for part in np.array_split(keys, rng.integers(1, 30)):
        local = phrases.Summary(summary.capacity)
        local.merge(part, np.ones(len(part), np.int64))
        summary.merge(local.keys, local.counts)
        summary.taken += local.taken
        assert len(summary.keys) <= summary.capacity
    true = Counter(keys.tolist())
    found = set(summary.frequent(threshold).tolist())
    assert {k for k, n in true.items() if n >= threshold} <= found
    left = dict(zip(summary.keys.tolist(), summary.counts.tolist(), strict=True))
    assert all(n - summary.taken <= left.get(k, 0) <= n for k, n in true.items())


def test_too_small_a_summary_is_refused():
    summary = phrases.Summary(2)
    summary.merge(np.arange(50, dtype=np.uint32), np.full(50, 12))
    with pytest.raises(ValueError):
        summary.frequent(10)


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    found = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 2 * big), ("en", "b", 1, big + 1), ("en", "", 0, 9 * big)], "lang string, phrase string, words long, n long")
    row = phrases.scored(found, Scratch(spark, "t")).first()
    assert row.score == 10**6 * big * big // (2 * big * (big + 1))
