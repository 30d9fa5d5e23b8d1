"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are compared as sequences of words. The CGK random walk copies a word sequence to one of three
times its length: at each step it writes the word under its pointer and moves on if a random bit of
(step, word) says so. A few edits change a few written places, so edit distance becomes Hamming
distance, and sampled places of the walk are an LSH key. Windows of the length of an item whose key
equals the item's in any repetition are candidates, and the exact edit distance decides. The number
of repetitions is the least that finds the target share of copies with as many edits as are allowed
in every class of item lengths, measured on edited copies of the items themselves; an unchanged copy
is always found. A class that would take more repetitions than are worth it goes without keys: all its
windows that share enough word runs are compared, which loses none.

Only windows that can match are embedded. A window within k edits of an item of n words shares at
least n - q + 1 - k * q of its q-word runs, or one if that is less; with q at most n / (k + 1) this
loses nothing. Benchmark items lie in blocks of bounded size, in files that tasks load in turn, so one
pass over the corpus does for a benchmark of any size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch, with_row_ids
from tidemark.session import fresh_path

SIMILARITY = 0.8  # an item of n words may differ by n * (1 - SIMILARITY) word edits
RECALL = 0.98
SAMPLED = 4  # places of the walk in one key
REPETITIONS = 1024  # beyond so many, a class of items is compared without keys
PROBES = 24  # items of a class that are edited to measure it
STRETCH = 3  # steps of the walk for each word
BLOCK_BYTES = 4 << 20  # benchmark text that a task compares at a time
BLOOM_BITS = 24

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII, Latin-1, Greek and Cyrillic letters, and spaces for Unicode punctuation,
    byte for byte, so that positions stay those of the text."""
    out = textnum.LOWER[data]
    if not len(out) or out.max() < 128:
        return out
    first, second = out[:-1], out[1:]
    lead = np.flatnonzero(first >= 0xC2)
    a, b = first[lead], second[lead]

    def at(condition):
        return lead[condition]
    latin = at((a == 0xC3) & (b >= 0x80) & (b <= 0x9E) & (b != 0x97))
    greek1, greek2 = at((a == 0xCE) & (b >= 0x91) & (b <= 0x9F)), at((a == 0xCE) & (b >= 0xA0) & (b <= 0xA9))
    cyr1, cyr2 = at((a == 0xD0) & (b >= 0x90) & (b <= 0x9F)), at((a == 0xD0) & (b >= 0xA0) & (b <= 0xAF))
    wide = at(((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80)))
    narrow = at((a == 0xC2) & (b <= 0xBF))
    for where in (latin, greek1, cyr1):
        out[where + 1] += 0x20
    out[greek2], out[greek2 + 1] = 0xCF, out[greek2 + 1] - 0x20
    out[cyr2], out[cyr2 + 1] = 0xD1, out[cyr2 + 1] - 0x20
    out[narrow], out[narrow + 1] = 0x20, 0x20
    for k in range(3):
        out[np.minimum(wide + k, len(out) - 1)] = 0x20
    return out


#: First and last code points of scripts that put no space between words, and of full-width punctuation.
_UNSEGMENTED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
    (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_WIDE_SIGNS = ((0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def unsegmented(data: np.ndarray) -> np.ndarray | None:
    """The borders around every letter of a script without word spaces: such a letter is a word.
    Full-width punctuation in `data` becomes spaces, byte for byte."""
    if not len(data) or data.max() < 0xE0:
        return None
    lead = np.flatnonzero(data >= 0xE0)
    tail = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F for k in (1, 2, 3)]
    head = data[lead].astype(np.int64)
    size = np.where(head >= 0xF0, 4, 3)
    three = (head & 0x0F) << 12 | tail[0] << 6 | tail[1]
    point = np.where(size == 4, (head & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], three)

    def among(ranges):
        return np.any([(point >= a) & (point <= b) for a, b in ranges], axis=0)
    signs, letters = among(_WIDE_SIGNS), among(_UNSEGMENTED)
    for k in range(3):
        data[lead[signs] + k] = 0x20
    letters &= ~signs
    if not letters.any():
        return None
    borders = np.zeros(len(data) + 4, bool)
    borders[lead[letters]] = True
    borders[lead[letters] + size[letters]] = True
    return borders[:len(data)]


def words(column: pa.Array):
    data, offsets = textnum.buffer(column)
    data, offsets = folded(data[offsets[0]:offsets[-1]]), offsets - offsets[0]
    return (*textnum.word_hashes(data, offsets, _SEPARATOR, borders=unsegmented(data)), offsets)


# --- the walk ---------------------------------------------------------------------------------

@dataclass
class Walk:
    """Random bits and sampled places of all repetitions, for any number of words."""

    repetitions: int
    seed: int = 5

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        self.salt = rng.integers(1, 1 << 63, (self.repetitions, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.share = rng.random((self.repetitions, SAMPLED))

    def bits(self, step: int, symbols: np.ndarray) -> np.ndarray:
        h = (symbols ^ np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * self.salt
        return (h >> np.uint64(63)).astype(np.int64)

    def written(self, windows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(step, word under the pointer) per repetition and window; zero past the end."""
        count, n = windows.shape
        flat = np.concatenate([windows, np.zeros((count, 1), np.uint64)], axis=1).ravel()
        base = (np.arange(count, dtype=np.int64) * (n + 1))[None, :]
        at = np.zeros((self.repetitions, count), np.int64)
        for step in range(STRETCH * n):
            symbols = flat[base + at]
            yield step, symbols
            at += self.bits(step, symbols)
            np.minimum(at, n, out=at)

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """The LSH key of each window (columns) in each repetition (rows)."""
        count, n = windows.shape
        places = np.sort((self.share * STRETCH * n).astype(np.int64), axis=1)
        out = np.full((self.repetitions, count), n, np.uint64)
        for step, symbols in self.written(windows):
            for k in range(SAMPLED):
                hit = np.flatnonzero(places[:, k] == step)
                if len(hit):
                    out[hit] = out[hit] * np.uint64(0x9E3779B97F4A7C15) + symbols[hit]
        out += np.arange(self.repetitions, dtype=np.uint64)[:, None] * np.uint64(0xC2B2AE3D27D4EB4F)
        return textnum.mix(out)


def edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """`edits` random substitutions, insertions and deletions, at the old length."""
    out = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        new = np.uint64(rng.integers(1, 1 << 63))
        if kind == 0 and out:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    out = out[:len(item)]
    return np.array(out + [np.uint64(0)] * (len(item) - len(out)), np.uint64)


def length_class(words: int) -> int:
    """Items of similar length: quarter powers of two."""
    return int(4 * np.log2(max(1, words)) + 1e-9)


def misses(items: list[np.ndarray], allowed: list[int]) -> dict[int, np.ndarray]:
    """Per class of lengths, the chance of edited copies of its items to have another key, in one repetition."""
    rng, probe, out = np.random.default_rng(11), Walk(16, seed=23), {}
    classes: dict[int, list[int]] = {}
    for i in rng.permutation(len(items)).tolist():
        if allowed[i]:
            classes.setdefault(length_class(len(items[i])), []).append(i)
    for name, members in classes.items():
        # A class with few items is measured on several edits of each.
        tests = (members * PROBES)[:max(PROBES, min(len(members), 4 * PROBES))]
        agree = []
        for i in tests:
            pair = np.stack([items[i], edited(items[i], allowed[i], rng)])
            same = np.zeros(probe.repetitions)
            for _, symbols in probe.written(pair):
                same += symbols[:, 0] == symbols[:, 1]
            agree.append(((same / (STRETCH * len(items[i]))) ** SAMPLED).mean())
        out[name] = 1 - np.array(agree)
    return out


def repetitions(items: list[np.ndarray], allowed: list[int], recall: float = RECALL, most: int = REPETITIONS) -> tuple[int, set[int]]:
    """The least number of repetitions that finds the share `recall` of copies with all allowed edits in
    every class of lengths, and the classes for which `most` are not enough."""
    n, hard, measured = 1, set(), misses(items, allowed)
    for name, miss in measured.items():
        own = 1
        while (1 - miss**own).mean() < recall and own <= most:
            own += max(1, own // 8)
        if own > most:
            hard.add(name)
        else:
            n = max(n, own)
    return n, hard


# --- the items --------------------------------------------------------------------------------

@dataclass
class Items:
    """One block of the benchmark, ready to search for."""

    ids: list
    texts: list[np.ndarray]
    similarity: float = SIMILARITY
    most: int = REPETITIONS

    def __post_init__(self):
        self.allowed = [int((1 - self.similarity) * len(t) + 1e-9) for t in self.texts]
        self.run = [min(3, len(t) // (k + 1)) for t, k in zip(self.texts, self.allowed, strict=True)]
        self.least = [max(1, len(t) - q + 1 - k * q) for t, k, q in zip(self.texts, self.allowed, self.run, strict=True)]
        n, hard = repetitions(self.texts, self.allowed, most=self.most)
        self.walk = Walk(n)
        self.keyless = np.array([k > 0 and length_class(len(t)) in hard for t, k in zip(self.texts, self.allowed, strict=True)])
        self.grams, self.bloom = {}, {}
        for q in sorted(set(self.run)):
            h, item, place = [], [], []
            for i, t in enumerate(self.texts):
                if self.run[i] == q:
                    g = textnum.shingles(t, q)
                    h.append(g)
                    item.append(np.full(len(g), i))
                    place.append(np.arange(len(g)))
            h, item, place = map(np.concatenate, (h, item, place))
            order = np.argsort(h, kind="stable")
            self.grams[q] = h[order], item[order], place[order]
            bloom = np.zeros(1 << BLOOM_BITS, bool)
            bloom[h >> np.uint64(64 - BLOOM_BITS)] = True
            self.bloom[q] = np.packbits(bloom)
        keys, owner = [], []
        lengths = np.array([len(t) for t in self.texts])
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            for start in range(0, len(own), 1000):
                some = own[start:start + 1000]
                k = self.walk.keys(np.stack([self.texts[i] for i in some]))
                keys.append(k.ravel())
                owner.append(np.tile(some, self.walk.repetitions))
        keys, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def windows(self, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Rows (document, length, first word, item) of the windows that can match an item; the item is
        -1 where keys are to tell."""
        out = []
        for q, (grams, item, place) in self.grams.items():
            if len(hashes) < q:
                continue
            h = textnum.shingles(hashes, q)
            slot = h >> np.uint64(64 - BLOOM_BITS)
            maybe = np.flatnonzero((self.bloom[q][(slot >> np.uint64(3)).astype(np.int64)] >> (7 - (slot & np.uint64(7))).astype(np.uint8)) & 1)
            maybe = maybe[doc[maybe] == doc[maybe + q - 1]]
            lo, hi = np.searchsorted(grams, h[maybe]), np.searchsorted(grams, h[maybe], side="right")
            maybe, lo, hi = maybe[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(maybe):
                continue
            at = np.repeat(maybe, hi - lo)
            which = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange(int((hi - lo).sum()))
            who, start = item[which], at - place[which]
            # Shared runs per document and item, counted at different places of the item.
            pair = doc[at].astype(np.int64) * len(self.texts) + who
            once = np.unique(np.stack([pair, place[which]]), axis=1)[0]
            pairs, shared = np.unique(once, return_counts=True)
            enough = shared >= np.array(self.least)[pairs % len(self.texts)]
            ok = np.flatnonzero(enough[np.searchsorted(pairs, pair)])
            # All starts that a shared run allows, each once per document and length; by the number of allowed edits.
            allowed, length = np.array(self.allowed)[who[ok]], np.array([len(t) for t in self.texts])[who[ok]]
            for k in np.unique(allowed):
                mine = ok[allowed == k]
                base = np.stack([doc[at[mine]], length[allowed == k], start[mine], np.where(self.keyless[who[mine]], who[mine], -1)], axis=1)
                base = np.repeat(np.unique(base, axis=0), 2 * k + 1, axis=0)
                base[:, 2] += np.tile(np.arange(-k, k + 1), len(base) // (2 * k + 1))
                out.append(base)
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 4), np.int64)

    def candidates(self, hashes: np.ndarray, first: np.ndarray, last: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Rows (document, item, first word) whose window has the key of the item in a repetition, or is to
        be compared without."""
        known = found[:, 3] >= 0
        out = [found[known][:, [0, 3, 2]]]
        found = found[~known]
        for n in np.unique(found[:, 1]):
            own = found[found[:, 1] == n]
            for s in range(0, len(own), 4096):
                part = own[s:s + 4096]
                at = part[:, 2][:, None] + np.arange(n)[None, :]
                inside = (at >= first[part[:, 0]][:, None]) & (at < last[part[:, 0]][:, None])
                windows = np.where(inside, hashes[np.clip(at, 0, len(hashes) - 1)], np.uint64(0))
                k = self.walk.keys(windows)
                lo, hi = np.searchsorted(self.keys, k), np.searchsorted(self.keys, k, side="right")
                rep, col = np.nonzero(hi > lo)
                if not len(rep):
                    continue
                left, size = lo[rep, col], (hi - lo)[rep, col]
                which = np.repeat(left - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
                cols = np.repeat(col, size)
                rows = np.stack([part[cols, 0], self.owner[which], part[cols, 2]], axis=1)
                out.append(np.unique(rows, axis=0))
        return np.unique(np.concatenate(out), axis=0)


def _ends(item: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Least edits that turn the item into a part of `text` that ends at each place."""
    row, place = np.zeros(len(text) + 1, np.int64), np.arange(len(text) + 1)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (text != w), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    return row


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any part of `text`, and that part's first and last + 1 word."""
    ends = _ends(item, text)
    end = int(ends.argmin())
    starts = _ends(item[::-1], text[:end][::-1])
    best = np.flatnonzero(starts == ends[end])
    back = best[np.abs(best - len(item)).argmin()] if len(best) else int(starts.argmin())
    return int(ends[end]), end - int(back), end


def places(item: np.ndarray, text: np.ndarray, allowed: int) -> list[tuple[int, int, int]]:
    """Places of `text` within the allowed edits of the item, as in `align`, none over another: the
    best, then the best of what is before and after it. A long text is taken in parts; a place at
    the end of a part is judged with what follows."""
    out, todo, n = [], [(0, len(text))], len(item)
    most = 8 * (n + allowed) + 8
    while todo:
        lo, hi = todo.pop()
        if hi - lo < max(1, n - allowed):
            continue
        end = min(hi, lo + most)
        while True:
            edits, s, e = align(item, text[lo:end])
            if edits > allowed or end == hi or lo + e <= end - n - allowed:
                break
            end = min(hi, lo + e + n + allowed)  # only fewer edits can move the best place again
        if edits <= allowed and e > s:
            out.append((edits, lo + s, lo + e))
            todo += [(lo + e, hi), (lo, lo + s)]
        elif end < hi:
            todo.append((end - n - allowed, hi))
    return sorted(out, key=lambda x: x[1])


def _search(loaders: list[Callable[[], Items]]):
    """One pass over the texts for all blocks. A worker has one block in memory at a time; with several,
    each batch of texts meets them in turn."""
    def one(items: Items, batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, starts, ends, counts, offsets = words(batch.column("text"))
        last = np.cumsum(counts)
        first = last - counts
        doc = np.repeat(np.arange(len(counts)), counts)
        near = items.candidates(hashes, first, last, items.windows(hashes, doc))
        rows, take = [], []
        at = 0
        while at < len(near):
            d, item, begin = near[at]
            to = at
            n, k = len(items.texts[item]), items.allowed[item]
            while to + 1 < len(near) and (near[to + 1, :2] == near[at, :2]).all() and near[to + 1, 2] - near[to, 2] <= n:
                to += 1
            lo, hi = max(first[d], begin - k), min(last[d], near[to, 2] + n + k)
            for edits, s, e in places(items.texts[item], hashes[lo:hi], k):
                rows.append((items.ids[item], edits, n, int(starts[lo + s] - offsets[d]), int(ends[lo + e - 1] - offsets[d])))
                take.append(int(d))
            at = to + 1
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [batch.column("row").take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
            ["row", "item_id", "edits", "item_words", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = loaders[0]() if len(loaders) == 1 else None
        for whole in batches:
            for load in loaders:
                items = only or load()
                for i in range(0, whole.num_rows, 500):
                    yield one(items, whole.slice(i, 500))
                del items
    return run


def _published(spark: SparkSession, block: Items) -> Callable[[], Items]:
    """Give every executor a file with the block, from the shared folder; what comes back loads it in a task."""
    path = f"{fresh_path(spark, 'items')}.pickle"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(pickle.dumps(block, protocol=5)))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]

    def load() -> Items:
        with open(SparkFiles.get(name), "rb") as file:
            return pickle.load(file)
    return load


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark in blocks of bounded size; one block at a time is on the driver."""
    ids, texts, size = [], [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null").toLocalIterator():
        w = words(pa.array([r["t"]]))[0]
        if len(w):
            ids.append(r["i"])
            texts.append(w)
            size += len(r["t"])
        if size > block_bytes:
            yield Items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts)


def leaks(
    docs: DataFrame, items: DataFrame, carry: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per place where a document holds a benchmark item: `row`, item_id, edits, item_words,
    and the bytes (start, end) of the passage.

    Case, punctuation and white space do not count. Texts and items that are null or empty hold
    nothing and are found nowhere. An item of fewer than five words may have no edit: it is found where
    its words stand in a row. A letter of a script without word spaces (Chinese, Japanese, Thai, Lao,
    Burmese, Khmer) is a word. Repeated
    documents and repeated items each give their rows. Columns not carried are ignored, whatever their
    names. Item identifiers are whole numbers. Empty tables give no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    row = source.schema["row"].dataType.simpleString()
    schema = f"row {row}, item_id long, edits long, item_words long, start long, end long"
    loaders = [_published(spark, block) for block in blocks(items, item_id, item_text, block_bytes)]
    return source.mapInArrow(_search(loaders), schema) if loaders else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, whole rows, repeated ones too. Rows without identifier count."""
    rows = with_row_ids(docs, scratch, F.struct(*docs.columns).alias("row"), name="docs")
    dirty = scratch.write(leaks(rows, items, ["rid"], f"row.{text_col}").select("row.rid").distinct(), "dirty")
    return rows.join(dirty.hint("shuffle_hash"), "rid", "left_anti").select("row.*")
