"""Quality and toxicity by a text classifier and hierarchical empirical Bayes over sites.

Two logistic regressions give the evidence of a document: one for quality, one for toxicity, over
hashed words, word beginnings and binned text statistics. A site's documents inform each other: the
mean probability of a host is shrunk toward that of the corpus, that of a path toward its host, with
strengths estimated by moments from the spread between hosts and between paths. The document's
logit is then shifted by that of its path, from which its own share is taken out. Site figures come
from grouped sums over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch
from tidemark.llm.decontaminate import _SEPARATOR, folded
from tidemark.llm.quality_rules import repeat_words

TRAIN_DOCS = 12_000  # labelled documents the regressions are fitted on, at most
FEATURES = 4_000  # hashed features of each regression
MIN_DOCS = 5  # labelled documents that a feature occurs in, at least
SLOTS = 1 << 22  # values of a hashed feature
BINS = 12
HEADS = (4, 5, 6, 7, 8)
DENSE = ("log_words", "symbols", "upper", "digits", "marks", "word_bytes", "distinct", "repeats", "top_word", "equal_lines")
TASKS = ("quality", "toxic")


def features(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text its distinct hashed words and word beginnings, and its statistics (DENSE)."""
    raw, offsets = textnum.buffer(texts)
    raw, offsets = raw[offsets[0]:offsets[-1]], offsets - offsets[0]
    hashes, starts, ends, counts, *begins = textnum.word_hashes(folded(raw), offsets, _SEPARATOR, heads=HEADS)
    last = np.cumsum(counts)
    classes = np.zeros((256, 4), bool)
    for k, chars in enumerate((b"#*$%&|<>@^~_=+{}[]\\", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?\"'()-")):
        classes[list(chars), k] = True
    sums = [np.concatenate([[0], np.cumsum(classes[:, k][raw])]) for k in range(4)]
    sparse, dense = [], np.zeros((len(counts), len(DENSE)))
    pylines = texts.to_pylist()
    for i, n in enumerate(counts.tolist()):
        at = slice(last[i] - n, last[i])
        own = np.concatenate([hashes[at], *(b[at] for b in begins)])
        sparse.append(np.unique(own[own != 0] >> np.uint64(64 - 22)).astype(np.int64))
        size = max(1, int(offsets[i + 1] - offsets[i]))
        dense[i, 0] = np.log1p(n)
        dense[i, 1:5] = [(s[offsets[i + 1]] - s[offsets[i]]) / size for s in sums]
        if n:
            distinct, times = np.unique(hashes[at], return_counts=True)
            dense[i, 5] = (ends[at] - starts[at]).mean()
            dense[i, 6] = len(distinct) / n * np.log1p(n)
            dense[i, 7] = repeat_words(hashes[at]) / n
            dense[i, 8] = times.max() / n
        lines = [x for x in (pylines[i] or "").split("\n") if x.strip()]
        dense[i, 9] = 1 - len(set(lines)) / len(lines) if lines else 0
    return sparse, dense


def _small(batches, rows=500):
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents, good ones and toxic ones each hashed feature occurs in, per task."""
    counts = np.zeros((SLOTS, 3), np.int32)
    for batch in _small(batches):
        good, toxic = batch.column("quality").to_pylist(), batch.column("toxic").to_pylist()
        for s, g, t in zip(features(batch.column("text"))[0], good, toxic, strict=True):
            counts[s, 0] += 1
            counts[s, 1] += int(g)
            counts[s, 2] += int(t)
    there = np.flatnonzero(counts[:, 0])
    yield pa.RecordBatch.from_arrays(
        [pa.array(there, pa.int64()), *(pa.array(counts[there, k].astype(np.int64)) for k in range(3))], ["slot", "n", "good", "bad"])


def _rows(wanted: list[np.ndarray]):
    def run(batches):
        for batch in _small(batches):
            sparse, dense = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("quality"), batch.column("toxic"),
                *(pa.array([np.flatnonzero(np.isin(w, s, assume_unique=True)).tolist() for s in sparse], pa.list_(pa.int32())) for w in wanted),
                pa.array(dense.tolist(), pa.list_(pa.float64()))], ["quality", "toxic", "s0", "s1", "dense"])
    return run


def regress(rows: np.ndarray, cols: np.ndarray, width: int, y: np.ndarray, ridge: float = 0.3, steps: int = 120) -> np.ndarray:
    """Ridge logistic regression over a 0/1 matrix given by its places, by limited-memory BFGS; the
    last weight is the intercept."""
    n = len(y)
    decay = np.append(np.full(width, ridge), 1e-6)

    def loss(w):
        z = np.bincount(rows, w[cols], n) + w[-1]
        miss = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        value = np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (decay * w * w).sum()
        return value, np.append(np.bincount(cols, miss[rows], width), miss.sum()) + decay * w

    w = np.zeros(width + 1)
    value, grad = loss(w)
    memory: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        step, kept = grad.copy(), []
        for s, g, r in reversed(memory):
            a = r * (s @ step)
            step -= a * g
            kept.append(a)
        if memory:
            s, g, _ = memory[-1]
            step *= (s @ g) / (g @ g)
        for (s, g, r), a in zip(memory, reversed(kept), strict=True):
            step += (a - r * (g @ step)) * s
        rate, slope = (1.0 if memory else 1 / max(1.0, np.abs(grad).sum())), grad @ step
        while True:
            new = w - rate * step
            new_value, new_grad = loss(new)
            if new_value <= value - 1e-4 * rate * slope or rate < 1e-10:
                break
            rate /= 2
        s, g = new - w, new_grad - grad
        if s @ g > 1e-12:
            memory = [*memory[-9:], (s, g, 1 / (s @ g))]
        done = value - new_value < 1e-5 * max(1.0, abs(new_value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


@dataclass
class Model:
    """Weights of both regressions; applied to texts by `scores`."""

    wanted: list[np.ndarray]
    edges: np.ndarray
    weights: list[np.ndarray]

    def binned(self, dense: np.ndarray) -> np.ndarray:
        """The one place of each statistic that is set, counted from 0."""
        return np.stack([
            np.searchsorted(self.edges[k], dense[:, k], side="right") + k * BINS for k in range(len(DENSE))], axis=1)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Logits of quality and toxicity."""
        sparse, dense = features(texts)
        places = self.binned(dense)
        out = np.zeros((len(sparse), 2))
        for t, (wanted, w) in enumerate(zip(self.wanted, self.weights, strict=True)):
            out[:, t] = w[-1] + w[len(wanted) + places].sum(axis=1)
            for i, s in enumerate(sparse):
                at = np.searchsorted(wanted, s)
                ok = at < len(wanted)
                ok[ok] = wanted[at[ok]] == s[ok]
                out[i, t] += w[at[ok]].sum()
        return out


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str, text_col: str, limit: int = TRAIN_DOCS) -> Model:
    """Fit both regressions on at most `limit` labelled documents, the first by a hash of their id.

    Several labels of a document are averaged; of rows with one id that with the least hash of its
    text counts; a document without text counts as empty. The sample is written once, so the texts of all
    documents are read once for it. Without labels all weights are zero.
    """
    votes = labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(
        (F.avg("quality") >= 0.5).cast("int").alias("quality"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic")).where(
            "quality is not null and toxic is not null")
    chosen = scratch.write(votes.orderBy(F.xxhash64(id_col), id_col).limit(limit), "chosen")
    # At most `limit` rows of three numbers are broadcast. The least row per id is kept in the scan already,
    # so an id that very many rows share arrives as one row a task.
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id").groupBy("_id", "quality", "toxic").agg(
            F.min(F.struct(F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))).alias("one"))
    sample = scratch.write(sample.select("one.text", "quality", "toxic"), "sample")
    counted = sample.mapInArrow(_count, "slot long, n long, good long, bad long").groupBy("slot").agg(
        *(F.sum(c).alias(c) for c in ("n", "good", "bad"))).where(F.col("n") >= MIN_DOCS)
    totals = chosen.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good"), F.sum("toxic").alias("bad")).first()
    n = totals["n"]
    if not n:
        return Model([np.zeros(0, np.int64)] * 2, np.zeros((len(DENSE), BINS - 1)), [np.zeros(len(DENSE) * BINS + 1)] * 2)
    wanted = []
    for c in ("good", "bad"):
        share = (totals[c] or 0) / n
        # How far the feature's documents are from the share of all, in standard deviations.
        z = F.abs(F.col(c) - share * F.col("n")) / F.sqrt(F.col("n") * max(1e-9, share * (1 - share)))
        top = counted.orderBy(z.desc(), "slot").limit(FEATURES).select("slot").collect()
        wanted.append(np.sort(np.array([r["slot"] for r in top], np.int64)))
    table = sample.mapInArrow(
        _rows(wanted), "quality int, toxic int, s0 array<int>, s1 array<int>, dense array<double>").toArrow()
    dense = np.array(table.column("dense").to_pylist(), float).reshape(-1, len(DENSE))
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    model = Model(wanted, np.stack([np.quantile(dense[:, k], cuts) if len(dense) else np.zeros(len(cuts)) for k in range(len(DENSE))]), [])
    places = model.binned(dense)
    for t, task in enumerate(TASKS):
        lists = table.column(f"s{t}").combine_chunks()
        sizes = np.array([len(x) for x in lists.to_pylist()], np.int64)
        rows = np.concatenate([np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), len(DENSE))])
        cols = np.concatenate([np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64), (len(wanted[t]) + places).ravel()])
        y = np.asarray(table.column(task).to_pylist(), float)
        model.weights.append(regress(rows, cols, len(wanted[t]) + len(DENSE) * BINS, y))
    return model


def _scorer(shared):
    def run(batches):
        for batch in _small(batches):
            logits = np.clip(shared.value.scores(batch.column("text")), -12, 12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("host"), batch.column("path"), *(pa.array(logits[:, k]) for k in (0, 1))],
                ["row", "host", "path", "quality_logit", "toxic_logit"])
    return run


def site_posteriors(scored: DataFrame, task: str) -> DataFrame:
    """(host, path, mid, mean, strength, sum, n): the shrunken mean of each path's host, how strongly a
    path is drawn to it, the path's own sum and count, and the mean of the corpus.

    Method of moments: the variance between host means beyond that expected from the spread of their
    documents gives the strength of the corpus for a host, and likewise that of a host for its paths.
    """
    p = 1 / (1 + F.exp(-F.col(f"{task}_logit")))
    paths = scored.groupBy("host", "path").agg(F.sum(p).alias("s"), F.sum(p * p).alias("q"), F.count(F.lit(1)).alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum("n").alias("hn"), F.count(F.lit(1)).alias("k"))

    def strength(s, q, n, mid):
        # Weighted between-group variance, less the part that documents within groups explain.
        within = F.sum(q - s * s / n) / F.greatest(F.lit(1), F.sum(n) - F.count(F.lit(1)))
        between = F.sum(n * F.pow(s / n - mid, 2)) / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)
        typical = F.sum(n) / F.count(F.lit(1))
        spread = F.greatest((between - within) / typical, F.lit(1e-9))
        return F.least(F.lit(1e6), F.greatest(F.lit(1.0), within / spread))

    # Scalar subqueries: one figure each.
    with_mid = hosts.withColumn("mid", hosts.agg(F.sum("hs") / F.sum("hn")).scalar())
    host_strength = with_mid.agg(strength(F.col("hs"), F.col("hq"), F.col("hn"), F.col("mid")))
    posterior = with_mid.withColumn("hk", host_strength.scalar()).select(
        "host", "mid", ((F.col("hk") * F.col("mid") + F.col("hs")) / (F.col("hk") + F.col("hn"))).alias("mean"))
    joined = paths.alias("p").join(
        posterior.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.*", "h.mid", "h.mean")
    path_strength = joined.agg(strength(F.col("s"), F.col("q"), F.col("n"), F.col("mean")))
    return joined.withColumn("strength", path_strength.scalar()).select(
        "host", "path", *(F.col(c).alias(f"{task}_{c}") for c in ("mid", "mean", "strength", "s", "n")))


def classify(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, carry: list[str], host: Column | str, path: Column | str,
    id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_DOCS,
) -> DataFrame:
    """`row`, a struct of the columns in `carry`, host, path, and for both tasks the probability by the
    text alone, that of the site and the posterior; kept if quality is at least and toxicity below 0.5.

    Null hosts and paths form sites of their own. A null text is empty. Repeated rows are judged
    alike and each counts for its site. Columns not carried are ignored, whatever their names. An
    empty table gives no rows; without labels every probability is 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, scratch, id_col, text_col, limit))
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    source = docs.select(
        F.struct(*carry).alias("row"), as_column(host).cast("string").alias("host"), as_column(path).cast("string").alias("path"),
        F.col(text_col).alias("text"))
    row = source.schema["row"].dataType.simpleString()
    scored = scratch.write(source.mapInArrow(
        _scorer(model), f"row {row}, host string, path string, quality_logit double, toxic_logit double"), "scored")
    keys = [F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("host", "path")]
    keyed = scored.withColumns({"hk": keys[0], "pk": keys[1]})
    sites = None
    for task in TASKS:
        s = site_posteriors(scored, task).withColumns({"hk": keys[0], "pk": keys[1]}).drop("host", "path")
        sites = s if sites is None else sites.join(s, ["hk", "pk"])
    # One site may hold a third of the documents; adaptive execution splits it, as sites are a written table.
    joined = keyed.join(scratch.write(sites, "sites"), ["hk", "pk"])
    out = joined
    for task in TASKS:
        p = 1 / (1 + F.exp(-F.col(f"{task}_logit")))
        strength, n = F.col(f"{task}_strength"), F.col(f"{task}_n")
        site = (strength * F.col(f"{task}_mean") + F.col(f"{task}_s") - p) / (strength + n - 1)
        site = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), site))
        mid = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(f"{task}_mid")))
        logit = F.col(f"{task}_logit") + F.log(site / (1 - site)) - F.log(mid / (1 - mid))
        out = out.withColumns({f"{task}_text": p, f"{task}_site": site, f"{task}_posterior": 1 / (1 + F.exp(-logit))})
    return out.select(
        "row", "host", "path", *(f"{t}_{c}" for t in TASKS for c in ("text", "site", "posterior")),
        ((F.col("quality_posterior") >= 0.5) & (F.col("toxic_posterior") < 0.5)).alias("kept"))
