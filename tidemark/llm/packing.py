"""Packing by patterns, fitted by non-negative least squares.

Documents become pieces of at most `capacity` tokens. Only the histogram of piece lengths decides:
patterns of a few lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left is packed
best-fit by length, many equal sequences at a time. The plan has a size bounded by the capacity, not
by the data. Pieces are numbered within their length by prefix sums over task-sized blocks, and the
number picks a sequence and an offset. No piece list ever meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.tokens import word_tokenizer

CAPACITY = 2048


# --- the plan ---------------------------------------------------------------------------------

def patterns(lengths: np.ndarray, capacity: int, most: int = 3) -> np.ndarray:
    """Every multiset of up to `most` of the given lengths that fills `capacity`; zeros fill rows up."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    out = []
    if there[capacity]:
        out.append(np.array([[capacity, 0, 0]]))
    a = np.flatnonzero(there)
    pair = a[(2 * a >= capacity) & (a < capacity)]
    pair = pair[there[capacity - pair]]
    out.append(np.stack([pair, capacity - pair, np.zeros_like(pair)], axis=1))
    for x in a[(3 * a >= capacity) & (a < capacity)].tolist() if most >= 3 else []:
        y = a[(2 * a >= capacity - x) & (a <= x) & (a < capacity - x)]
        y = y[there[capacity - x - y]]
        out.append(np.stack([np.full_like(y, x), y, capacity - x - y], axis=1))
    return np.concatenate(out).astype(np.int64)


def fit(patterns_: np.ndarray, counts: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts that come closest to `counts` per length, in least squares.

    Accelerated projected gradient steps; a length weighs as much as its tokens, because a long
    piece without partner costs most.
    """
    size = len(counts)
    scale = float(counts.max() or 1)
    target = counts / scale
    weight = np.sqrt(np.arange(size) / (size - 1))
    weight[0] = 0
    rows = patterns_.ravel()

    def spread(x):
        return np.bincount(rows, np.repeat(x, patterns_.shape[1]), size)

    # The largest eigenvalue, by a few power steps, bounds the step.
    v = np.ones(len(patterns_))
    for _ in range(12):
        v /= np.linalg.norm(v)
        v = (weight**2 * spread(v))[patterns_].sum(axis=1)
    step = 1 / (np.linalg.norm(v) * 1.05)
    x = np.zeros(len(patterns_))
    z, t = x, 1.0
    for _ in range(steps):
        grad = (weight**2 * (spread(z) - target))[patterns_].sum(axis=1)
        new = np.maximum(z - step * grad, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


@dataclass
class Plan:
    """`kinds` (lengths, repeats): how many sequences hold exactly these lengths, longest first."""

    kinds: list[tuple[tuple[int, ...], int]]

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per length the runs of piece numbers: length, first number, first sequence, offset."""
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for lengths, repeats in self.kinds:
            offset = 0
            for n in lengths:
                rows.append((n, used.get(n, 0), sequence, offset))
                used[n] = used.get(n, 0) + repeats
                offset += n
            sequence += repeats
        rows.sort()
        return tuple(np.array([r[i] for r in rows], np.int64) for i in range(4))

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.kinds)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: the longest length left opens a sequence, the longest
    that fits fills it up, and the sequence is repeated while its lengths last."""
    counts = counts.copy()
    kinds = []
    while (left := np.flatnonzero(counts)).size:
        need: dict[int, int] = {}
        room, chosen = capacity, []
        for _ in range(capacity):
            at = int(np.searchsorted(left, room, side="right")) - 1
            while at >= 0 and counts[left[at]] <= need.get(int(left[at]), 0):
                at -= 1
            if at < 0:
                break
            n = int(left[at])
            need[n] = need.get(n, 0) + 1
            chosen.append(n)
            room -= n
        repeats = min(int(counts[n]) // k for n, k in need.items())
        for n, k in need.items():
            counts[n] -= k * repeats
        kinds.append((tuple(chosen), repeats))
    return kinds


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in histogram.items():
        counts[n] = k
    if not counts.sum():
        return Plan([])
    kinds = []
    full = int(counts[capacity])
    if full:
        kinds.append(((capacity,), full))
        counts[capacity] = 0
    some = patterns(np.flatnonzero(counts), capacity)
    if len(some):
        repeats = np.floor(fit(some, counts) + 1e-6).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            lengths = tuple(int(n) for n in some[i] if n)
            # Rounding errors of the fit may ask for more pieces than there are.
            r = min(int(repeats[i]), *(int(counts[n]) // lengths.count(n) for n in set(lengths)))
            if r > 0:
                kinds.append((lengths, r))
                for n in lengths:
                    counts[n] -= r
    return Plan(kinds + best_fit(counts, capacity))


# --- the work ---------------------------------------------------------------------------------

def _cutter(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        seen: dict[int, int] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500)
                rows, take = [], []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    ids = tokenizer.encode(text or "") + b"\0\0\0\0"
                    total = len(ids) // 4
                    for piece, start in enumerate(range(0, total, capacity)):
                        part = ids[4 * start:4 * (start + capacity)]
                        n = len(part) // 4
                        rows.append((piece, start, n, zlib.crc32(part), seen.get(n, 0)))
                        seen[n] = seen.get(n, 0) + 1
                        take.append(k)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(take, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                    ["row", "piece", "start", "length", "ids_crc32", "nth"])
    return run


def cut(docs: DataFrame, carry: list[str], vocabulary: str, text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document: `row`, piece, start, length, ids_crc32, block, nth.

    nth counts the pieces of one length within the block, a task. The ids end with one 0.
    """
    source = docs.select(F.struct(*carry).alias("row"), F.col(text_col).alias("text"))
    row = source.schema["row"].dataType.simpleString()
    return source.mapInArrow(
        _cutter(vocabulary, capacity), f"row {row}, piece int, start long, length long, ids_crc32 long, nth long",
    ).withColumn("block", F.spark_partition_id())


def _placer(segments):
    length, first, sequence, offset = segments
    wide = np.int64(1) << np.int64(44)  # numbers within a length stay below

    def run(batches):
        keys = length * wide + first
        for batch in batches:
            n = batch.column("length").to_numpy()
            at = np.searchsorted(keys, n * wide + batch.column("number").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[at] + batch.column("number").to_numpy() - first[at], pa.int64()),
                 pa.array(offset[at], pa.int64())],
                [*batch.schema.names[:-1], "sequence_id", "offset"])
    return run


def pack(
    docs: DataFrame, scratch: Scratch, carry: list[str], vocabulary: str, text_col: str = "text", capacity: int = CAPACITY,
) -> DataFrame:
    """`row`, a struct of the columns in `carry`, and the place of every piece in the sequences.

    A null or empty text is one piece, its closing 0. Equal documents are packed one by one. Columns
    not carried are ignored, whatever their names. An empty table gives no rows.
    """
    pieces = scratch.write(cut(docs, carry, vocabulary, text_col, capacity), "pieces")
    counts = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("k"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.write(counts.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))), "counts")
    # At most `capacity` rows reach the driver: one per length.
    histogram = {r["length"]: r["k"] for r in base.groupBy("length").agg(F.sum("k").alias("k")).collect()}
    segments = plan(histogram, capacity).segments()
    numbered = pieces.join(base.select("block", "length", "base"), ["block", "length"]).select(
        "row", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("number"))
    row = numbered.schema["row"].dataType.simpleString()
    return numbered.mapInArrow(
        _placer(segments), f"row {row}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
