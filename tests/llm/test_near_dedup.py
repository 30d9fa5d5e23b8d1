import re

import numpy as np
import pytest

from tidemark.llm import near_dedup
from tidemark.llm.common import Scratch, components

from . import frames

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute(docs):
    """Component of every row by comparing all pairs; rows are named by position."""
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for i, (_, _) in enumerate(docs):
        ids = [docs[k][0] for k in groups[find(i)] if docs[k][0] is not None]
        out.append((docs[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def run(spark, rows):
    df = frames.clashing(spark.createDataFrame(rows, frames.DOC_SCHEMA).repartition(4))
    out = near_dedup.near_duplicates(df, Scratch(spark, "t"))
    return [(r.id, r.n_shingles, r.component_id, r.first) for r in out.collect()]


def test_matches_all_pairs(spark):
    rows = frames.corpus(1)
    got = run(spark, rows)
    assert sorted((g[:3] for g in got), key=repr) == brute([r[:2] for r in rows])
    # One row of each component; identifiers that repeat may name two components.
    firsts = [g[2] for g in got if g[3] and g[1] and g[2] not in (None, 0, 5)]
    assert len(firsts) == len(set(firsts)) == len({g[2] for g in got if g[1]} - {None, 0, 5})


def test_group_of_near_copies_without_a_common_center(spark):
    # Copies of copies: ends of the chain are not linked with each other, and buckets are large.
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(150)]
    rows = []
    for i in range(120):
        for at in rng.integers(0, 150, 2 if i % 3 else 1):
            base[at] = f"c{i}"
        rows.append((i, " ".join(base if i % 4 else base[:70]), "en", "s", 0))
    old, near_dedup.BLOCK = near_dedup.BLOCK, 16
    try:
        assert sorted((g[:3] for g in run(spark, rows)), key=repr) == brute([r[:2] for r in rows])
    finally:
        near_dedup.BLOCK = old


def test_empty_table(spark):
    assert run(spark, []) == []


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    ka, kb = near_dedup.registers(a), near_dedup.registers(b)
    assert (near_dedup.merge(ka, kb) == near_dedup.registers(np.union1d(a, b))).all()
    est = near_dedup.estimate(ka[None], kb[None], np.array([len(a)]), np.array([len(b)]))[0]
    assert est == pytest.approx(1500 / 2500, abs=0.15)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 200), (200, 7)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 1: 1, 200: 1, 7: 1}
