"""Exact removal of byte strings that occur more than once in a corpus.

Every 400-byte window has an anchor, the leftmost gram of half its length of least hash in it; equal windows
have equal anchors at equal places. The windows of one anchor are consecutive, so a document is a
list of (anchor, stretch of text). Only stretches whose anchor occurs elsewhere can hold a repeat.
Equal stretches are repeats as a whole and count as one from then on. The different stretches of an
anchor are indexed in batches: a run-length compressed Burrows-Wheeler transform with the longest common prefixes sampled
at run ends. Between run ends the value falls by one from text position to text position, so
streaming over the text gives the matching statistics of every position, and positions that match
400 bytes elsewhere are marked.

Hot passages. An anchor with more stretches than one task should hold is split by content: its
windows are dealt into four by their distance to the anchor, and each part is grouped again by the text that
all its windows share. Dealing ends at single windows, which are equal as a whole. No group is
capped, and a passage that a third of the documents share costs each of them a few rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch, partitions, with_row_ids

WINDOW = 400
GROUP = 1000  # stretches of one anchor that a task indexes; larger groups are split
BATCH = 1 << 19  # bytes that one index covers, or one group if that is larger


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """The leftmost position of the least value in every run of `width` values."""
    value, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        left, right = value[:-step], value[step:]
        take = right < left
        value = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        span += step
    return at


def stretches(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> Iterator[tuple]:
    """(document, first window, windows, anchor - first window, anchor hash, stretch hash) over the
    documents in `data`, cut at `bounds`."""
    n = len(data)
    if n < window:
        return
    up, down = textnum.powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(textnum._VALUE[data] * up[:n], out=prefix[1:])
    h = textnum.mix((prefix[gram:] - prefix[:-gram]) * down[:n - gram + 1])
    at = least_positions((h >> np.uint64(32)).astype(np.uint32), window - gram + 1)
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    inside = doc[:n - window + 1] == doc[window - 1:]
    change = np.flatnonzero((at[1:] != at[:-1]) | (doc[1:n - window + 1] != doc[:n - window])) + 1
    starts = np.concatenate([[0], change])
    ends = np.concatenate([change, [len(at)]])
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    # A run never straddles the border of valid windows: they end where a document does.
    stop = bounds[1:][doc[starts]] - window + 1
    ends = np.minimum(ends, stop)
    ok = np.flatnonzero(inside[starts] & (ends > starts))
    starts, ends = starts[ok], ends[ok]
    anchor = at[starts].astype(np.int64)
    keys = h[anchor].view(np.int64)
    for s, e, p, k, d in zip(starts.tolist(), ends.tolist(), anchor.tolist(), keys.tolist(), doc[starts].tolist(), strict=True):
        yield d, s - int(bounds[d]), e - s, p - s, k, xxhash.xxh3_64_intdigest(view[s:e - 1 + window], p - s) - (1 << 63)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            data, offsets = textnum.buffer(batch.column("text"))
            found: list[tuple] = []

            def flush():
                cols = list(zip(*found, strict=True)) if found else [[]] * 6
                found.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)],
                    ["rid", "lo", "n", "a", "g", "c"])

            i = 0
            while i < len(rid):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + textnum.PIECE, side="right")) - 1)
                j = min(j, len(rid))
                size = int(offsets[j] - offsets[i])
                if j > i + 1 or size <= 2 * textnum.PIECE:
                    bounds = offsets[i:j + 1] - offsets[i]
                    found += [(int(rid[i + d]), *rest) for d, *rest in stretches(data[offsets[i]:offsets[j]], bounds, window, gram)]
                else:  # a long text, in parts that overlap by all but one byte of a window
                    for s in range(0, size - window + 1, textnum.PIECE):
                        part = data[offsets[i] + s:min(offsets[i] + s + textnum.PIECE + window - 1, offsets[j])]
                        found += [(int(rid[i]), s + lo, *rest) for _, lo, *rest in stretches(part, np.array([0, len(part)]), window, gram)]
                        if len(found) > 50_000:
                            yield flush()
                i = j
                if len(found) > 50_000:
                    yield flush()
            yield flush()
    return run


def _texts_of(window: int):
    """The bytes of the wanted stretches of a text."""
    def run(batches):
        for batch in batches:
            data, offsets = textnum.buffer(batch.column("text"))
            rid, wanted = batch.column("rid").to_pylist(), batch.column("wanted").to_pylist()
            rows, size = [], 0
            for i, spans in enumerate(wanted):
                text = data[offsets[i]:offsets[i + 1]]
                for x in spans:
                    rows.append((x["g"], rid[i], x["lo"], x["n"], x["a"], text[x["lo"]:x["lo"] + x["n"] - 1 + window].tobytes()))
                    size += len(rows[-1][5])
                    if size > 8 << 20:
                        yield _stretch_batch(rows)
                        rows, size = [], 0
            yield _stretch_batch(rows)
    return run


def _stretch_batch(rows):
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["g", "rid", "lo", "n", "a", "ctx"])


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of texts with sampled run ends.

    Each text ends in a terminator of its own. `symbols` and `lengths` are the runs; `head` and
    `tail` hold, for the first and last suffix of each run, its text position and the common prefix
    with its neighbour outside the run.
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts])
        n = int(sizes.sum())
        sym = np.zeros(n + 8, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sym[:n] = raw.astype(np.int64) + 1
        last = first + sizes - 1
        sym[last] = 0
        owner = np.repeat(np.arange(len(texts)), sizes)
        left = last[owner] - np.arange(n)  # symbols before the terminator
        key, alive = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(7):
            s = sym[k:k + n]
            key = (key << 9) | np.where(alive, s, 0)
            alive &= s != 0
        sa = np.argsort(key, kind="stable")
        ranked = key[sa]
        rank = np.empty(n, np.int64)
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        heads = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[sa] = heads
        self.levels, h = [(7, rank.astype(np.int32))], 7
        alone = new & np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~alone)
        while len(slots):
            pos = sa[slots]
            ahead = pos + h
            over = h > left[pos]
            second = np.where(over, -owner[pos] - 1, rank[np.minimum(ahead, n - 1)])
            order = np.lexsort((second, rank[pos]))
            pos, second = pos[order], second[order]
            base = rank[pos]
            sa[slots] = pos
            new = np.concatenate([[True], (base[1:] != base[:-1]) | (second[1:] != second[:-1])])
            rank[pos] = slots[np.maximum.accumulate(np.where(new, np.arange(len(pos)), 0))]
            alone = new & np.concatenate([new[1:], [True]])
            slots = slots[~alone]
            h *= 2
            self.levels.append((h, rank.astype(np.int32)))
        self.n, self.sym, self.left, self.first = n, sym, left, first
        before = np.where(np.isin(sa, first), 0, sym[sa - 1])
        border = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == 0)])
        at = np.flatnonzero(border)
        self.symbols, self.lengths = before[at], np.diff(np.concatenate([at, [n]]))
        inner = at[at > 0]
        common = self.common_prefix(sa[inner - 1], sa[inner])
        self.head = sa[at], np.concatenate([[0], common])
        self.tail = np.concatenate([sa[inner - 1], sa[-1:]]), np.concatenate([common, [0]])

    def common_prefix(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        size = np.zeros(len(x), np.int64)
        for h, rank in reversed(self.levels):
            a, b = np.minimum(x + size, self.n - 1), np.minimum(y + size, self.n - 1)
            size += np.where(rank[a] == rank[b], h, 0)
        going = np.ones(len(x), bool)
        for _ in range(6):
            a, b = np.minimum(x + size, self.n - 1), np.minimum(y + size, self.n - 1)
            going &= self.sym[a] == self.sym[b]
            size += going
        return np.minimum(size, np.minimum(self.left[x], self.left[y]))

    def matching_statistics(self) -> np.ndarray:
        """For every position the longest string there that also starts anywhere else."""
        place = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for at, size in (self.head, self.tail):
            ends = np.zeros(self.n, np.int64)
            np.maximum.at(ends, at, at + size)
            out = np.maximum(out, np.maximum.accumulate(ends) - place)
        return out


def _index(window: int):
    """Spans (rid, s, e) of the windows of a batch of stretches that occur elsewhere in the batch."""
    def run(batches):
        rows, size, last = [], 0, None

        def flush():
            # Equal stretches are repeats as a whole and are indexed once.
            times: dict[bytes, int] = {}
            for r in rows:
                times[r[4]] = times.get(r[4], 0) + 1
            index = RunLengthIndex(list(times))
            long = index.matching_statistics() >= window
            place = dict(zip(times, index.first.tolist(), strict=True))
            out = []
            for _, rid, lo, n, text in rows:
                if times[text] > 1:
                    out.append((rid, lo, lo + n - 1 + window))
                    continue
                hit = np.flatnonzero(np.diff(np.concatenate([[0], long[place[text]:place[text] + n].view(np.int8), [0]])))
                out += [(rid, lo + s, lo + e - 1 + window) for s, e in hit.reshape(-1, 2).tolist()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "s", "e"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("g", "rid", "lo", "n", "ctx")), strict=True):
                if size > BATCH and row[0] != last:
                    yield flush()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
                last = row[0]
        if rows:
            yield flush()
    return run


def repeated_spans(rows: DataFrame, scratch: Scratch, window: int = WINDOW) -> DataFrame:
    """(rid, s, e): byte ranges of `rows` (rid, text) whose every window occurs anywhere else."""
    spark = rows.sparkSession
    found = scratch.write(rows.mapInArrow(_anchors(window, window // 2), "rid long, lo long, n int, a int, g long, c long"), "anchors")
    # Equal stretches become one row before anything else: they are repeats as a whole.
    # Any row may stand for them; `first` takes its columns from one row and keeps the hash aggregate.
    equal = scratch.write(found.groupBy("g", "c").agg(
        F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in ("rid", "lo", "n", "a"))), "equal")
    several = equal.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    # A frequent stretch's rows are split by adaptive execution; the other side is a written table.
    even = found.join(equal.where("k > 1").select("g", "c"), ["g", "c"])
    span = ["rid", F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + window).alias("e")]
    spans = [scratch.write(even.select(*span), "even")]
    wanted = equal.join(several.select("g"), "g").groupBy("rid").agg(
        F.collect_list(F.struct("lo", "n", "a", "g")).alias("wanted"))
    work = scratch.write(rows.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted").mapInArrow(
        _texts_of(window), "g long, rid long, lo long, n int, a int, ctx binary"), "stretches-0")
    cell = 1 << (window - window // 2).bit_length()
    level = 0
    while True:
        sizes = scratch.write(work.groupBy("g").agg(
            F.count(F.lit(1)).alias("k"), F.min(F.xxhash64("ctx", "a")).alias("c1"), F.max(F.xxhash64("ctx", "a")).alias("c2")).where("k > 1").selectExpr(
                "g", "case when c1 = c2 then 'even' when k > " + str(GROUP) + " then 'split' else 'index' end as way"), f"sizes-{level}")
        joined = work.join(sizes, "g")
        spans.append(joined.where("way = 'even'").select(*span))
        spans.append(joined.where("way = 'index'").select("g", "rid", "lo", "n", "ctx").repartition(partitions(spark), "g").sortWithinPartitions(
            "g", "rid", "lo").mapInArrow(_index(window), "rid long, s long, e long"))
        scratch.drop(*(["anchors", "equal"] if level == 0 else []))
        if cell == 1 or sizes.where("way = 'split'").limit(1).count() == 0:
            break
        cell = max(1, cell // 4)
        level += 1
        # Windows by their distance d to the anchor, in cells; x to y are those of this row and cell.
        halves = joined.where("way = 'split'").withColumn("d1", F.explode(F.sequence(
            F.floor((F.col("a") - F.col("n") + 1) / cell) * cell, F.floor(F.col("a") / cell) * cell, F.lit(cell).cast("long"))))
        halves = halves.withColumns({
            "x": F.greatest(F.col("d1"), F.col("a") - F.col("n") + 1), "y": F.least(F.col("d1") + cell - 1, F.col("a").cast("long"))})
        halves = halves.select(
            "g", "d1", "rid", (F.col("lo") + F.col("a") - F.col("y")).alias("lo"), (F.col("y") - F.col("x") + 1).cast("int").alias("n"),
            F.col("y").cast("int").alias("a"), F.expr(f"substring(ctx, cast(a - y + 1 as int), cast(y - x + {window} as int))").alias("ctx"))
        core = F.expr(f"substring(ctx, cast(a - d1 + 1 as int), {window} - {cell} + 1)")
        work = scratch.write(halves.select(F.xxhash64("g", "d1", core).alias("g"), "rid", "lo", "n", "a", "ctx"), f"stretches-{level}")
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    out = scratch.write(out, "spans")
    # What led here makes room for the tables that follow.
    scratch.drop(*(n for n in list(scratch.paths) if n == "even" or n.startswith(("stretches-", "sizes-"))))
    return out


def _word_runs(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first word, anchor hash, window hash, start byte, end byte) of every window of
    `width` words, in parts of bounded size. As with bytes, the anchor is the leftmost run of half
    the width with the least hash, so equal windows have equal anchors."""
    i, gram = 0, width // 2
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + textnum.PIECE, side="right")) - 1)
        bounds = offsets[i:j + 1] - offsets[i]
        hashes, starts, ends, counts = textnum.word_hashes(data[offsets[i]:offsets[j]], bounds)
        doc, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        for s in range(0, len(hashes) - width + 1, textnum.PIECE // 4):  # parts overlap by all but one word
            part = hashes[s:s + textnum.PIECE // 4 + width - 1]
            grams = textnum.shingles(part, gram)
            at = least_positions((grams >> np.uint64(32)).astype(np.uint32), width - gram + 1)
            w = np.arange(s, s + len(at))
            ok = np.flatnonzero(doc[w] == doc[w + width - 1])
            w, d = w[ok], doc[w[ok]]
            yield d + i, w - first[d], grams[at[ok]], textnum.shingles(part, width)[ok], starts[w] - bounds[d], ends[w + width - 1] - bounds[d]
        i = j


def _word_anchors(width: int):
    """Stretches of windows with one anchor hash, and a hash of all their windows."""
    def run(batches):
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for d, lo, g, h, s, e in _word_runs(*textnum.buffer(batch.column("text")), width):
                if not len(d):
                    continue
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (g[1:] != g[:-1]) | (lo[1:] != lo[:-1] + 1)])
                a = np.flatnonzero(new)
                b = np.concatenate([a[1:], [len(d)]])
                up, down = textnum.powers(len(d))
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:len(d)])])
                c = textnum.mix((prefix[b] - prefix[a]) * down[a] + (b - a).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (rid[d[a]], lo[a], b - a, g[a].view(np.int64), c.view(np.int64), s[a], e[b - 1])],
                    ["rid", "lo", "n", "g", "c", "s", "e"])
    return run


def _word_windows(width: int):
    """The windows of the wanted stretches of a text, one by one."""
    def run(batches):
        for batch in batches:
            rid, wanted = batch.column("rid").to_numpy(), batch.column("wanted").to_pylist()
            marks = [np.array(sorted((x["lo"], x["lo"] + x["n"]) for x in spans)).T for spans in wanted]
            for d, lo, g, h, s, e in _word_runs(*textnum.buffer(batch.column("text")), width):
                keep = np.zeros(len(d), bool)
                for i in np.unique(d):
                    own = slice(*np.searchsorted(d, [i, i + 1]))
                    at = np.searchsorted(marks[i][0], lo[own], side="right") - 1
                    keep[own] = (at >= 0) & (lo[own] < marks[i][1][at])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (rid[d], g.view(np.int64), h.view(np.int64), s, e)], ["rid", "g", "h", "s", "e"])
    return run


def repeated_word_spans(rows: DataFrame, scratch: Scratch, width: int) -> DataFrame:
    """(rid, s, e): byte ranges of `rows` (rid, text) whose every run of `width` words occurs anywhere
    else. Words end at white space, the amount of which does not count; exact up to 128-bit hash collisions."""
    found = scratch.write(rows.mapInArrow(
        _word_anchors(width), "rid long, lo long, n long, g long, c long, s long, e long"), "word-anchors")
    # As with bytes: equal stretches count as one, and only anchors of several kinds need a closer look.
    equal = scratch.write(found.groupBy("g", "c").agg(
        F.count(F.lit(1)).alias("k"), *(F.first(x).alias(x) for x in ("rid", "lo", "n"))), "word-equal")
    even = scratch.write(found.join(equal.where("k > 1").select("g", "c"), ["g", "c"]).select("rid", "s", "e"), "word-even")
    several = equal.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = equal.join(several.select("g"), "g").groupBy("rid").agg(F.collect_list(F.struct("lo", "n")).alias("wanted"))
    windows = scratch.write(rows.join(wanted.hint("shuffle_hash"), "rid").select("rid", "text", "wanted").mapInArrow(
        _word_windows(width), "rid long, g long, h long, s long, e long"), "word-windows")
    twice = scratch.write(windows.groupBy("g", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g", "h"), "word-twice")
    other = scratch.write(windows.join(twice, ["g", "h"]).select("rid", "s", "e"), "word-other")
    out = scratch.write(even.unionByName(other), "word-spans")
    scratch.drop("word-anchors", "word-equal", "word-even", "word-windows", "word-twice", "word-other")
    return out


def merged(owner: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each owner: overlapping and touching spans joined, by owner and in text order."""
    if not len(s):
        return owner, s, e
    wide = np.int64(1) << np.int64(40)  # texts are shorter, so owners do not mix
    order = np.argsort(owner * wide + s, kind="stable")
    first, last = (owner * wide + s)[order], np.maximum.accumulate((owner * wide + e)[order])
    at = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    owner, end = owner[order][at], last[np.concatenate([at[1:] - 1, [len(last) - 1]])]
    return owner, first[at] - owner * wide, end - owner * wide


def _spans_of(column: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row, start, end and kind of all spans in a batch."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("s", "e", "w"))
    return np.repeat(np.arange(len(sizes)), sizes), *fields


def _without(raw: np.ndarray, spans: list[tuple[int, int]], whole: bool = False) -> bytes:
    """What is left of a text; with `whole`, a character stays if one of its bytes does."""
    kept, at = [], 0
    for s, e in spans:
        if whole:
            cut = e
            while cut < len(raw) and raw[cut] & 0xC0 == 0x80 and cut > s:
                cut -= 1
            while s < cut and raw[s] & 0xC0 == 0x80:
                s += 1
            e = cut
        kept.append(raw[at:s].tobytes())
        at = e
    return b"".join(kept) + raw[at:].tobytes()


def _cutter(with_text: bool, words: bool):
    def run(batches):
        for batch in batches:
            data, offsets = textnum.buffer(batch.column("text"))
            texts, rows = batch.column("text").to_pylist() if with_text else None, []
            owner, s, e, w = _spans_of(batch.column("spans"))
            places = np.arange(len(offsets))

            def runs(pick, owner=owner, s=s, e=e, places=places):
                """For every row the runs of the spans picked."""
                who, a, b = merged(owner[pick], s[pick], e[pick])
                ends, pairs = np.searchsorted(who, places).tolist(), list(zip(a.tolist(), b.tolist(), strict=True))
                return lambda i: pairs[ends[i]:ends[i + 1]]

            windows, passages, every = runs(~w), runs(w), runs(np.ones(len(w), bool))
            for i in range(len(offsets) - 1):
                raw, spans = data[offsets[i]:offsets[i + 1]], windows(i)
                left = _without(raw, spans)
                row = [len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest()]
                if words:
                    row += [len(passages(i)), sum(y - x for x, y in passages(i))]
                if with_text:
                    row.append(_without(raw, every(i), True).decode() if every(i) else texts[i])
                rows.append(row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64()] * 2 * words + [pa.string()] * with_text
            names = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passages", "passage_bytes"] * words + ["kept_text"] * with_text
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)
    return run


def remove_repeats(
    docs: DataFrame, scratch: Scratch, carry: list[str], text_col: str = "text", window: int = WINDOW, with_text: bool = False,
    words: int | None = None,
) -> DataFrame:
    """`row`, a struct of the columns in `carry`, and what is left of every text.

    A byte goes if it lies in a string of `window` bytes that also starts anywhere else in the
    corpus, in the same text too; strings are judged on the input: n_bytes, n_removed, n_spans and
    kept_sha256. With `words`, runs of so many words that also start anywhere else are found as well,
    however few bytes they have: n_passages (maximal ones) and passage_bytes. kept_text (with
    `with_text`) is without either and keeps a character as a whole if any of its bytes stays. A null text
    is empty (its kept_text is null); a text shorter than the window stays as it is; equal long texts
    lose all their bytes. Columns not carried are ignored, whatever their names. An empty table gives no rows.
    """
    rows = with_row_ids(docs, scratch, F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    spans = repeated_spans(rows.select("rid", "text"), scratch, window).withColumn("w", F.lit(False))
    if words:
        scratch.release()
        spans = spans.unionByName(repeated_word_spans(rows.select("rid", "text"), scratch, words).withColumn("w", F.lit(True)))
    per_text = spans.groupBy("rid").agg(F.collect_list(F.struct("s", "e", "w")).alias("spans"))
    joined = rows.join(per_text.hint("shuffle_hash"), "rid", "left").select("row", "text", "spans")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(
        _cutter(with_text, bool(words)), f"row {row}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + ", n_passages long, passage_bytes long" * bool(words) + ", kept_text string" * with_text)
