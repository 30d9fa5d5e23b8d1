import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import filter_audit
from tidemark.llm.common import Scratch

from . import frames

LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", {k for k, v in failed.items() if v}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order, 1):
                lost = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = sum(f in d[1] for d in mine)
                out[part, "".join(order), k] = [
                    len(left), len(lost), fails - len(lost), sum(d[1] == {f} for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost)]
                shapley[part, f] += len(lost)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def corpus():
    rows = [list(r) for r in frames.corpus(3)]
    for k, r in enumerate(rows):
        if k % 4 == 1 and r[1]:
            r[1] = r[1] + " # " + r[1].upper() + " zz" * 200
        if k % 5 == 0 and r[1]:
            r[1] = " ".join(f"v{i}" for i in range(150 + 2 * k)) + r[1][:40]
    return [tuple(r) for r in rows] + [(200, rows[0][1], "fr", "s", 1), (100, rows[0][1], None, "s", 1), (200, rows[0][1], "fr", "s", 1)]


def run(spark, rows, labels):
    docs = frames.clashing(spark.createDataFrame(rows, frames.DOC_SCHEMA).repartition(4)).withColumns(
        {c: F.lit("x") for c in ("part", "failed", "digest", "good", "docs", "state", "_text")})
    return filter_audit.audit(docs, spark.createDataFrame(labels, LABELS), Scratch(spark, "t"))


def test_every_order_step_by_step(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 70, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1), (7, None, 1)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in run(spark, rows, labels).collect()}
    want = brute(rows, labels)
    assert got == want and len(got) == 600 * len({r[2] or "" for r in rows})
    assert any(v[2] for v in want.values()) and any(v[4] for v in want.values()) and any(v[5] for v in want.values())


def test_empty_tables(spark):
    assert run(spark, [], []).count() == 0
    out = run(spark, [(1, None, None, None, None)], []).collect()
    assert len(out) == 600 and all(r.kept == 0 or r.filter_order.index("A") >= r.step for r in out)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_paths_are_all_orders(n):
    through = Counter()
    for order in itertools.permutations(range(n)):
        state = 0
        for f in order:
            through[state, f] += 1
            state |= 1 << f
    assert {(s, f): w for s, f, w in filter_audit.edges(n)} == dict(through)
    assert filter_audit.path_counts(n)[0][-1] == filter_audit.path_counts(n)[1][0] == len(list(itertools.permutations(range(n))))
