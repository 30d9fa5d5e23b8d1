"""Collocations: phrases of a language whose words meet far more often than their parts would.

Frequent phrases are found in two passes over the texts. The first keeps mergeable Misra-Gries
summaries, one for each hash partition of the phrases: tasks send summaries of what they have seen, and a
partition merges them into at most `capacity` counters. With a capacity above the partition's mass (its
occurrences) divided by the threshold, what is subtracted from any counter stays under the threshold, so
every frequent phrase survives; counter plus subtractions is an upper bound that drops most others. The
survivors set bits in a filter of bounded size. The second pass counts what passes the filter exactly, by
text. False positives of hashes and filter cost time and no more.

Phrases that a task alone sees as often as the threshold are frequent for certain. They leave the summary
at once, so common words add nothing to the mass. A text is read piece by piece, a phrase never
crosses pieces, and no array grows with the longest text, as long as it has pieces.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch
from tidemark.operators.aggregate import top_per

THRESHOLD = 10
MAX_WORDS = 3
SHARE = 50  # a phrase goes if a longer one around it has so many percent of its occurrences
TOP = 2000


@dataclass(frozen=True)
class Limits:
    """Sizes that bound memory and do not change the result."""

    partition_bytes: int = 8 << 20  # text for each hash partition
    filter_bytes: int = 32 << 20  # the filter that all tasks read
    flush: int = 1 << 19  # occurrences that a task holds before it sends a summary
    room: int = 1 << 16  # counters that a partition may keep in any case


CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = CUT.copy()
SEPARATOR[[0x20, 0x09]] = True
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Lower case, and a blank for a tab.
PLAIN = textnum.LOWER.copy()
PLAIN[0x09] = 0x20


class Summary:
    """Misra-Gries counters of 32-bit keys. `taken` is the most that any counter may have lost."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add counters; over capacity, every counter loses the value of the first one that has no room."""
        keys, counts = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[at], np.add.reduceat(counts, at)
        if len(keys) > self.capacity:
            lost = int(np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1])
            self.taken += lost
            counts = counts - lost
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts = keys, counts

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may have occurred `threshold` times, all that have among them."""
        if self.taken >= threshold:
            raise ValueError("the capacity of a summary is under its mass divided by the threshold")
        return self.keys[self.counts + self.taken >= threshold]


def capacity(mass: int, threshold: int) -> int:
    """Counters with which less than `threshold` is subtracted: each subtraction takes as much from
    capacity + 1 counters, and no more than the mass can be taken."""
    return mass // threshold + 1


def _grams(batch: pa.RecordBatch, max_words: int) -> Iterator[tuple]:
    """(language hash, plain bytes, word starts, word ends, [(first word, phrase hash) for 1, 2, ... words])
    of parts of a batch, with the language of every word."""
    data, offsets = textnum.buffer(batch.column("text"))
    langs = batch.column("lang").to_pylist()
    seeds = {x: np.uint64(xxhash.xxh3_64_intdigest(x) | 1) for x in dict.fromkeys(langs)}
    seed = np.array([seeds[x] for x in langs], np.uint64)
    for first, last, start, end in textnum.pieces(data, offsets, CUT):
        part = data[start:end]
        bounds = np.clip(offsets[first:last + 1], start, end) - start
        hashes, s, e, counts = textnum.word_hashes(part, bounds, SEPARATOR, textnum.LOWER)
        doc = np.repeat(np.arange(first, last), counts)
        piece = np.concatenate([[0], np.cumsum(CUT[part])])[s]
        joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        out, whole = [], np.ones(len(hashes), bool)
        for k in range(1, max_words + 1):
            if k > 1:
                whole = whole[:-1] & joined[k - 2:]
            at = np.flatnonzero(whole).astype(np.int32)
            grams = textnum.shingles(hashes, k)[at] if len(hashes) >= k else np.zeros(0, np.uint64)
            out.append((at, textnum.mix(grams * seed[doc[at]] + np.uint64(k))))
        yield doc, part, s, e, out


def _release() -> None:
    """Give freed memory back to the system, where its C library can; workers of a task share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _held(batches: Iterator[pa.RecordBatch], max_words: int, flush: int) -> Iterator[list[tuple]]:
    """Parts until their occurrences exceed `flush`."""
    held, size = [], 0
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for doc, part, s, e, grams in _grams(batch, max_words):
            held.append((langs, doc, part, s, e, grams))
            size += sum(len(h) for _, h in grams)
            if size > flush:
                yield held
                held, size = [], 0
                _release()
    if held:
        yield held


def _place(h: np.ndarray, parts: int) -> np.ndarray:
    """The hash partition: consecutive stretches of hashes, so that sorted hashes have sorted partitions."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _summarise(parts: int, threshold: int, max_words: int, flush: int):
    """Per hash partition a row with the mass alone (what = 0) and one with the counters (what = 1)."""
    small = "<u1" if threshold <= 256 else "<u4"

    def run(batches):
        for held in _held(batches, max_words, flush):
            h, n = np.unique(np.concatenate([g for x in held for _, g in x[5]]), return_counts=True)
            at = np.searchsorted(_place(h, parts), np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(at)).tolist():
                key, count = h[at[p]:at[p + 1]].astype(np.uint32), n[at[p]:at[p + 1]]
                sure = count >= threshold
                mass = int(count[~sure].sum())
                rows.append((p, 0, mass, None, None, None))
                rows.append((p, 1, mass, key[sure].tobytes(), key[~sure].tobytes(), count[~sure].astype(small).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["p", "what", "mass", "sure", "keys", "counts"])
    return run


def _merge(threshold: int, room: int):
    """Merge the summaries of each partition, whose masses come first: p and the keys that may be frequent."""
    small = "<u1" if threshold <= 256 else "<u4"

    def run(batches):
        now, mass, summary, sure, waiting = None, 0, None, [], []

        def merge():
            summary.merge(*(np.concatenate(x) for x in zip(*waiting, strict=True)))
            waiting.clear()

        def done():
            if waiting:
                merge()
            keys = np.unique(np.concatenate([summary.frequent(threshold), *sure])) if summary else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([keys.tobytes()], pa.binary()), pa.array([len(keys)], pa.int64())], ["p", "keys", "n"])

        for batch in (whole.slice(i, 64) for whole in batches for i in range(0, whole.num_rows, 64)):
            for p, what, m, some, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("p", "what", "mass", "sure", "keys", "counts")), strict=True):
                if p != now:
                    if now is not None:
                        yield done()
                    now, mass, summary, sure = p, 0, None, []
                if what == 0:
                    mass += m
                    continue
                summary = summary or Summary(max(capacity(mass, threshold), room))
                sure.append(np.frombuffer(some, np.uint32))
                if len(sure) > 64:
                    sure = [np.unique(np.concatenate(sure))]
                waiting.append((np.frombuffer(keys, np.uint32), np.frombuffer(counts, small).astype(np.int64)))
                # Summaries are merged when they are as large as what is there: each counter is sorted a few times only.
                if sum(len(k) for k, _ in waiting) > max(room, len(summary.keys)):
                    merge()
        if now is not None:
            yield done()
    return run


def _slices(bits: int):
    """The stretch of the filter that belongs to a partition: bit `key` modulo `bits`."""
    def run(batches):
        for batch in batches:
            out = []
            for keys in batch.column("keys").to_pylist():
                stretch = np.zeros(bits, bool)
                stretch[np.frombuffer(keys, np.uint32) & np.uint32(bits - 1)] = True
                out.append(np.packbits(stretch, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("p"), pa.array(out, pa.binary())], ["p", "stretch"])
    return run


def _count(parts: int, bits: int, filter_of, max_words: int, flush: int):
    """lang, phrase, words, n of the phrases that pass the filter; words = 0 counts all words."""
    def run(batches):
        passes = np.frombuffer(filter_of.value, np.uint8)
        for held in _held(batches, max_words, flush):
            owner = np.repeat(np.arange(len(held), dtype=np.int32), [sum(len(g) for _, g in x[5]) for x in held])
            h = np.concatenate([g for x in held for _, g in x[5]])
            word = np.concatenate([at for x in held for at, _ in x[5]])
            width = np.concatenate([np.full(len(at), k, np.int8) for x in held for k, (at, _) in enumerate(x[5], 1)])
            bit = _place(h, parts) * bits + (h & np.uint64(bits - 1)).astype(np.int64)
            ok = np.flatnonzero(passes[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            del bit
            _, one, n = np.unique(h[ok], return_index=True, return_counts=True)
            one = ok[one]
            order = np.argsort(owner[one], kind="stable")
            one, n = one[order], n[order]
            ends = np.searchsorted(owner[one], np.arange(len(held) + 1))
            for i, (langs, doc, part, s, e, grams) in enumerate(held):
                own = slice(ends[i], ends[i + 1])
                a, k = word[one[own]].astype(np.int64), width[one[own]].astype(np.int64)
                plain, z = PLAIN[part].tobytes(), a + k - 1
                length = np.concatenate([[0], np.cumsum(e - s)])
                tight = (length[z + 1] - length[a] + k - 1 == e[z] - s[a]).tolist()
                texts = [
                    plain[x:y] if t else b" ".join(plain[s[w]:e[w]] for w in range(u, v + 1))
                    for x, y, t, u, v in zip(s[a].tolist(), e[z].tolist(), tight, a.tolist(), z.tolist(), strict=True)]
                known = doc[a].tolist()
                total = np.bincount(doc - doc[0], minlength=1) if len(doc) else np.zeros(0, np.int64)
                words = np.flatnonzero(total)
                per_lang: dict[str, int] = {}
                for d in words.tolist():
                    lang = langs[d + int(doc[0])]
                    per_lang[lang] = per_lang.get(lang, 0) + int(total[d])
                yield pa.RecordBatch.from_arrays([
                    pa.array([*(langs[d] for d in known), *per_lang], pa.string()), pa.array([*texts, *([b""] * len(per_lang))], pa.binary()).cast(pa.string()),
                    pa.array(np.concatenate([k, np.zeros(len(per_lang), np.int64)])),
                    pa.array(np.concatenate([n[own], np.array(list(per_lang.values()), np.int64)]))], ["lang", "phrase", "words", "n"])
    return run


def frequent(
    texts: DataFrame, scratch: Scratch, threshold: int = THRESHOLD, max_words: int = MAX_WORDS, limits: Limits = Limits(),
) -> DataFrame:
    """(lang, phrase, words, n): exact occurrences of every phrase of up to `max_words` words that occurs
    `threshold` times or more in a language, and with words = 0 (an empty phrase) all words of a language.

    `texts` has lang and text, neither null. The number of partitions follows the bytes of text. The
    filter has 16 bits for each survivor, up to `filter_bytes`; beyond that more phrases pass
    it and are counted in vain. Only the filter is gathered and sent to all tasks.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, min(-(-size // limits.partition_bytes), limits.filter_bytes // 8))
    sent = texts.mapInArrow(_summarise(parts, threshold, max_words, limits.flush), "p long, what int, mass long, sure binary, keys binary, counts binary")
    survivors = scratch.write(sent.repartition(parts, "p").sortWithinPartitions("p", "what").mapInArrow(
        _merge(threshold, limits.room), "p long, keys binary, n long"), "survivors")
    most = survivors.agg(F.max("n")).first()[0] or 0
    bits = 1 << max(6, min((16 * most).bit_length(), (limits.filter_bytes * 8 // parts).bit_length() - 1))
    passes = np.zeros(parts * bits // 8, np.uint8)
    for row in survivors.select("p", "keys").mapInArrow(_slices(bits), "p long, stretch binary").toLocalIterator():
        passes[row.p * bits // 8:(row.p + 1) * bits // 8] = np.frombuffer(row.stretch, np.uint8)
    counted = texts.mapInArrow(
        _count(parts, bits, spark.sparkContext.broadcast(passes.tobytes()), max_words, limits.flush), "lang string, phrase string, words long, n long")
    return scratch.write(counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where(f"words = 0 OR n >= {threshold}"), "frequent")


def _run(first: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.col("w"), first, size), " ")


def scored(found: DataFrame, scratch: Scratch) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases of two words or more in `found`, by their lowest cut.

    Parts of a frequent phrase are frequent, so the joins lose none. The products are decimals of 38 digits.
    """
    several = found.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = several.withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("words") - 1).cast("int")))).select(
        "lang", "phrase", "words", "a", "k", _run(F.lit(1), F.col("k")).alias("first"), _run(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    # Both sides are written tables: a word in very many phrases is split by adaptive execution.
    cuts = scratch.write(cuts, "cuts")
    parts = found.where("words >= 1")
    left = scratch.write(cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]), "left")
    both = left.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) "
                   "DIV (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0))) AS BIGINT)")
    return both.select("*", score.alias("score")).groupBy("lang", "phrase", "words", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def maximal(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that no longer candidate around them accounts for."""
    w = candidates.select("lang", "a", "words", F.split("phrase", " ").alias("w")).where("words > 2")
    inside = w.withColumn("size", F.explode(F.sequence(F.lit(2), (F.col("words") - 1).cast("int")))).withColumn(
        "at", F.explode(F.sequence(F.lit(1), (F.col("words") - F.col("size") + 1).cast("int"))))
    longer = inside.groupBy("lang", _run(F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    return candidates.join(longer, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a").drop("longer")


def collocations(
    docs: DataFrame, scratch: Scratch, text_col: str = "text", lang_col: str = "lang", threshold: int = THRESHOLD, max_words: int = MAX_WORDS,
    top: int = TOP, limits: Limits = Limits(),
) -> DataFrame:
    """The first `top` phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends and those into words at
    blanks and tabs. a, l and r are occurrences of the phrase and of its two parts at the lowest-scoring
    cut, n those of all words. Ties go to the more frequent phrase, then by its bytes. A null text is
    empty, a null language `und`; repeated rows count again; other columns are ignored; an empty table
    gives no rows. Counts are sums over equal strings; within one task's part of some 2 MB, phrases
    with equal 64-bit hashes count as equal.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = frequent(texts, scratch, threshold, max_words, limits)
    candidates = scratch.write(scored(found, scratch), "scored")
    words = found.where("words = 0").select("lang", F.col("n").alias("total"))
    best = top_per(maximal(candidates), ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()], top)
    return best.join(words, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
