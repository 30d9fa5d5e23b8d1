"""Hashes of words and shingles, computed over UTF-8 buffers a few megabytes at a time.

A word's hash is a polynomial over its bytes modulo 2**64, mixed afterwards. Words are found and
hashed for many documents in one pass; a document longer than a piece is cut at separators, so
memory does not grow with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20_240_611)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPOT = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base and its inverse to the powers 0 to n."""
    global _powers
    if _powers is None or len(_powers[0]) <= n:
        size = max(n + 1, PIECE + 4096)
        out = []
        for base in (_BASE, _INVERSE):
            col = np.full(size, base, np.uint64)
            col[0] = 1
            out.append(np.multiply.accumulate(col))
        _powers = out[0], out[1]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as its bytes and the n + 1 offsets into them; null is empty."""
    kind = pa.large_binary()
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(data: np.ndarray, offsets: np.ndarray, is_break: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first document, last document + 1, start byte, end byte) of pieces of about PIECE bytes.

    Short documents share a piece; a long one is cut after bytes of `is_break`.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1
        if j > i:
            yield i, min(j, n), int(offsets[i]), int(offsets[min(j, n)])
            i = j
            continue
        start, end = int(offsets[i]), int(offsets[i + 1])
        while start < end:
            stop = min(start + PIECE, end)
            if stop < end:
                breaks = np.flatnonzero(is_break[data[start:stop]])
                if len(breaks):
                    stop = start + int(breaks[-1]) + 1
                else:  # one word longer than a piece
                    while stop < end and not is_break[data[stop]]:
                        more = np.flatnonzero(is_break[data[stop:stop + PIECE]])
                        stop = min(end, stop + (int(more[0]) if len(more) else PIECE))
            yield i, i + 1, start, stop
            start = stop
        i += 1


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray | None = None,
    heads: tuple[int, ...] = (), borders: np.ndarray | None = None,
) -> tuple[np.ndarray, ...]:
    """Hash, start and end byte of every word, and how many words each document has; then, for each
    number in `heads`, the hash of so many first bytes of every word (0 for a shorter word).

    `separators` says which bytes end words, `fold` maps bytes before hashing. Words do not cross
    documents, nor the places before the bytes marked in `borders`.
    """
    value = _VALUE if fold is None else _VALUE[fold]
    counts = np.zeros(len(offsets) - 1, np.int64)
    hashes, starts, ends, begins = [], [], [], [[] for _ in heads]
    for first, last, start, end in pieces(data, offsets, separators):
        part = data[start:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~separators[part]
        edge = inside[1:] - inside[:-1]
        cuts = offsets[first + 1:last] - start  # a word ends where its document does
        if borders is not None:
            cuts = np.concatenate([cuts, np.flatnonzero(borders[start:end])])
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        cuts = np.unique(cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)])
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if len(cuts):
            s, e = np.sort(np.concatenate([s, cuts])), np.sort(np.concatenate([e, cuts]))
        up, down = powers(len(part))
        prefix = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(value[part] * up[:len(part)], out=prefix[1:])
        hashes.append(mix((prefix[e] - prefix[s]) * down[s]))
        for k, n in enumerate(heads):
            h = mix((prefix[np.minimum(s + n, e)] - prefix[s]) * down[s] + _SPOT[20 + n % 20])
            begins[k].append(np.where(e - s > n, h, np.uint64(0)))
        starts.append(s + start)
        ends.append(e + start)
        if last - first == 1:
            counts[first] += len(s)
        else:
            at = np.searchsorted(s + start, offsets[first:last + 1])
            counts[first:last] += np.diff(at)
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, counts, *(np.zeros(0, np.uint64) for _ in heads)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), counts, *map(np.concatenate, begins)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of every run of `width` words; with fewer words, of the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix((words * _SPOT[:n]).sum(dtype=np.uint64, keepdims=True) + _SPOT[40 + n:41 + n])
    out = words[:n - width + 1] * _SPOT[0]
    for k in range(1, width):
        out += words[k:n - width + 1 + k] * _SPOT[k]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's bigint."""
    return h.view(np.int64)
