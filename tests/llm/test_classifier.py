import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier as c
from tidemark.llm.common import Scratch

from . import frames


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    out = c.classify(docs, labels, Scratch(spark, "t"), ["doc_id"], "source", F.concat_ws("/", "source", "lang"), limit=2500)
    used = labels.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2500)
    held = out.select("row.doc_id", "quality_posterior", "toxic_posterior").join(labels, "doc_id").join(used, "doc_id", "left_anti").agg(
        F.avg(((F.col("quality_posterior") >= 0.5) == (F.col("quality") == 1)).cast("int")).alias("q"),
        F.avg(((F.col("toxic_posterior") >= 0.5) == (F.col("toxic") == 1)).cast("int")).alias("t"), F.count("*").alias("n")).first()
    assert held.n > 1000 and held.q > 0.96 and held.t > 0.96


def test_hard_cases(spark):
    rows = frames.corpus(8)
    df = frames.clashing(spark.createDataFrame(rows, frames.DOC_SCHEMA))
    labels = spark.createDataFrame([(i, i % 2, None if i == 4 else 0) for i in range(40)] + [(2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = c.classify(df, labels, Scratch(spark, "t"), ["doc_id"], "source", "lang").collect()
    assert len(out) == len(rows) and all(0 <= r.quality_posterior <= 1 and r.kept is not None for r in out)
    assert c.classify(df.limit(0), labels, Scratch(spark, "t"), ["doc_id"], "source", "lang").count() == 0
    none = c.classify(df, labels.limit(0), Scratch(spark, "t"), ["doc_id"], "source", "lang").collect()
    assert {round(r.quality_text, 6) for r in none} == {0.5}


def test_an_id_on_very_many_rows_is_one_sample(spark):
    many = spark.range(50_000).selectExpr("1L AS doc_id", "concat('hot text ', id) AS text")
    docs = many.unionByName(spark.range(2, 40).selectExpr("id AS doc_id", "concat('plain text ', id % 7) AS text"))
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality", "0 AS toxic")
    scratch = Scratch(spark, "t")
    c.fit(docs, labels, scratch, "doc_id", "text")
    sample = spark.read.parquet(scratch.paths["sample"])
    assert sample.count() == 39 and sample.where("text LIKE 'hot%'").count() == 1


def test_posteriors_against_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows = [(h, f"{h}/{k % 3}" if k % 11 else None, float(rng.normal(i - 1, 1.5))) for i, h in enumerate(["a", "b", "c", None]) for k in range(40 + 7 * i)]
    scored = spark.createDataFrame(rows, "host string, path string, quality_logit double")
    got = {(r.host, r.path): r for r in c.site_posteriors(scored, "quality").collect()}
    p = 1 / (1 + np.exp(-np.array([r[2] for r in rows])))

    def strength(groups, mids):
        n, s, q = (np.array([f(g) for g in groups]) for f in (len, np.sum, lambda g: (g * g).sum()))
        within = (q - s * s / n).sum() / max(1, n.sum() - len(n))
        between = (n * (s / n - np.array(mids)) ** 2).sum() / max(1, len(n) - 1)
        return min(1e6, max(1.0, within / max((between - within) / (n.sum() / len(n)), 1e-9)))

    of = lambda key, at: [p[[i for i, r in enumerate(rows) if r[:at] == k]] for k in key]
    hosts, paths = sorted({r[:1] for r in rows}, key=repr), sorted({r[:2] for r in rows}, key=repr)
    by_host, by_path, mid = of(hosts, 1), of(paths, 2), p.mean()
    k = strength(by_host, [mid] * len(hosts))
    mean = {h: (k * mid + g.sum()) / (k + len(g)) for h, g in zip(hosts, by_host, strict=True)}
    inner = strength(by_path, [mean[x[:1]] for x in paths])
    for x, g in zip(paths, by_path, strict=True):
        r = got[x]
        want = (mid, mean[x[:1]], inner, g.sum(), len(g))
        assert np.allclose([r.quality_mid, r.quality_mean, r.quality_strength, r.quality_s, r.quality_n], want, rtol=1e-9)
    assert len(got) == len(paths)


def test_sparse_sites_are_shrunk_more(spark):
    rng = np.random.default_rng(1)
    rows = [("good", "a", x) for x in rng.normal(3, 1, 300)] + [("bad", "b", x) for x in rng.normal(-3, 1, 300)]
    rows += [("new", "c", -3.0)] + [(f"h{i}", "d", x) for i in range(20) for x in rng.normal(i % 5 - 2, 1, 30)]
    scored = spark.createDataFrame([(h, p, float(x)) for h, p, x in rows], "host string, path string, quality_logit double")
    got = {r.host: r for r in c.site_posteriors(scored, "quality").collect()}
    raw = 1 / (1 + np.exp(3))
    mid = got["good"].quality_mid
    assert got["good"].quality_mean > 0.9 and got["bad"].quality_mean < 0.1
    assert abs(got["new"].quality_mean - raw) > abs(got["bad"].quality_mean - got["bad"].quality_s / got["bad"].quality_n)
    assert raw < got["new"].quality_mean < mid


def test_regression_separates():
    rng = np.random.default_rng(2)
    x = rng.random((400, 6)) < 0.4
    y = (x[:, 0] | (x[:, 1] & x[:, 2])).astype(float)
    rows, cols = np.nonzero(x)
    w = c.regress(rows, cols, 6, y, ridge=0.01)
    assert w[0] > 3 and w[1] > 0.5 and abs(w[5]) < 1
