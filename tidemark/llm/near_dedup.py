"""MinHash near-duplicate detection with SetSketch registers.

A document is the set of its distinct word shingles. Per register the sketch keeps the truncated,
exponentially spaced minimum of a hash over the set: K = floor(1 - log_b(h)). Registers merge by
maximum and agree with a probability close to the Jaccard similarity. Bands of registers find
candidates, the joint likelihood of larger, smaller and equal registers estimates their similarity,
and every link is confirmed on the full sets.

Hot groups. Equal sets collapse into one class before anything is compared. Members of a bucket are
first compared with its most central member only; links found join components. Pairs of a bucket
that are still in different components are then compared block by block, and a block returns no
more than a spanning forest of its links. So no link is lost, no bucket is capped, and no pair list
of a group is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textnum
from tidemark.llm.common import Scratch, components, partitions, with_row_ids

BASE = 1.001  # b of the registers; they agree almost as often as the minima themselves
LIMIT = (1 << 16) - 2  # q + 1, the largest register
ROWS, BANDS = 6, 24  # at a similarity of 0.85 a pair shares no band once in 90,000 pairs
REGISTERS = ROWS * BANDS
BLOCK = 512  # rows on each side of a block comparison
_rng = np.random.default_rng(77)
_FACTOR = _rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(elements: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes, as uint16; 0 for the empty set."""
    if not len(elements):
        return np.zeros(REGISTERS, np.uint16)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    high = (elements >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(high), 2048):
        part = high[start:start + 2048]
        np.minimum(least, (part[None, :] * _FACTOR[:, None] + _SHIFT[:, None]).min(axis=1), out=least)
    # An exponential variate per register: the minimum of the set is exponential with its size.
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)) + LIMIT // 8, 0, LIMIT).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def bands_of(band_rows: int) -> int:
    """How many bands of so many registers there are; registers that fill no band are in none."""
    return REGISTERS // band_rows


def band_keys(k: np.ndarray, band_rows: int = ROWS) -> np.ndarray:
    shape = bands_of(band_rows), band_rows
    factor = _BAND if band_rows == ROWS else _BAND.ravel()[:shape[0] * band_rows].reshape(shape)
    return textnum.mix((k[:factor.size].reshape(shape).astype(np.uint64) * factor).sum(axis=1, dtype=np.uint64))


def estimate(k1: np.ndarray, k2: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, from the numbers of registers that
    are larger, smaller and equal and from the known set sizes."""
    plus, minus = (k1 > k2).sum(axis=1), (k1 < k2).sum(axis=1)
    equal = k1.shape[1] - plus - minus
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)

    # Larger registers belong to the set that holds the smaller minimum.
    up, down = np.maximum(p(u - v * grid), 1e-12), np.maximum(p(v - u * grid), 1e-12)
    ll = plus[:, None] * np.log(up) + minus[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    return grid[np.arange(len(ll)), ll.argmax(axis=1)]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text; A to Z count as lower case."""
    data, offsets = textnum.buffer(texts)
    hashes, _, _, counts = textnum.word_hashes(data, offsets, fold=textnum.LOWER)
    at = 0
    for n in counts:
        yield np.unique(textnum.shingles(hashes[at:at + n], width))
        at += n


def _small(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _signer(width: int, band_rows: int = ROWS):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            sizes, h1, h2, regs, bands = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                k = registers(s)
                sizes.append(len(s))
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int(textnum.mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                regs.append(k.tobytes())
                bands.append(band_keys(k, band_rows).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("rid"), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()),
                pa.array(h2, pa.int64()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
            ], ["rid", "id", "n_shingles", "h1", "h2", "regs", "bands"])
    return sign


def _sets(width: int):
    def run(batches):
        for batch in _small(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sets, pa.binary())], ["rid", "set"])
    return run


def _linked(common, n1, n2, num: int, den: int):
    return den * common >= num * (n1 + n2 - common)


def _star_check(num: int, den: int):
    """Keep (a, b) if the estimate leaves a chance and the full sets confirm it."""
    doubt = 5 * np.sqrt(num / den * (1 - num / den) / REGISTERS)

    def run(batches):
        for batch in _small(batches, 500):
            k = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ka", "kb")]
            n = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("na", "nb")]
            likely = np.flatnonzero(estimate(k[0], k[1], n[0], n[1]) >= num / den - doubt)
            sa, sb, keep = batch.column("sa"), batch.column("sb"), []
            for i in likely.tolist():
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (sa, sb))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if _linked(common, len(x), len(y), num, den):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])
    return run


def _forest(find: dict, a: int, b: int) -> bool:
    def root(x):
        while (y := find.get(x, x)) != x:
            find[x] = find.get(y, y)
            x = y
        return x
    a, b = root(a), root(b)
    if a == b:
        return False
    find[max(a, b)] = min(a, b)
    return True


def block_links(left, right, same: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of a bucket, and within one if `same`.

    Each block is (rid, component, registers, band keys, sets, band number of the bucket). Pairs of
    one component, and pairs that an earlier band also holds, are left out.
    """
    rid1, comp1, k1, bands1, sets1, band = left
    rid2, comp2, k2, bands2, sets2, _ = right
    wanted = comp1[:, None] != comp2[None, :]
    if same:
        wanted &= rid1[:, None] < rid2[None, :]
    if not wanted.any():
        return []
    for j in range(band):
        wanted &= bands1[:, j][:, None] != bands2[:, j][None, :]
    equal = np.zeros(wanted.shape, np.int16)
    for j in range(REGISTERS):
        equal += k1[:, j][:, None] == k2[:, j][None, :]
    t = num / den
    wanted &= equal >= REGISTERS * (t - 5 * np.sqrt(t * (1 - t) / REGISTERS))
    rows, cols = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(rows):
        return []
    # Sizes of all intersections at once: a product of the sets' membership over shared elements.
    a, b = [sets1[i] for i in rows], [sets2[i] for i in cols]
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    common = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, len(shared), 4096):
        part = shared[start:start + 4096]

        def member(sets):
            out = np.zeros((len(sets), len(part)), np.float32)
            for i, s in enumerate(sets):
                hit = np.intersect1d(part, s, assume_unique=True)
                out[i, np.searchsorted(part, hit)] = 1
            return out
        common += member(a) @ member(b).T
    ok = wanted[np.ix_(rows, cols)] & _linked(common.astype(np.int64), na[:, None], nb[None, :], num, den)
    find: dict = {}
    out = []
    for i, j in zip(*np.nonzero(ok), strict=True):
        x, y = int(rid1[rows[i]]), int(rid2[cols[j]])
        if _forest(find, int(comp1[rows[i]]), int(comp2[cols[j]])):
            out.append((x, y))
    return out


def _block_check(num: int, den: int, band_rows: int = ROWS):
    """Rows of one (key, block pair) follow each other; compare its two sides."""
    def run(batches):
        import pandas as pd
        held, key = [], None

        def flush():
            df = pd.concat(held)
            sides = []
            for s in (0, 1):
                part = df[df.side == s]
                sides.append((
                    part.rid.to_numpy(np.int64), part.comp.to_numpy(np.int64),
                    np.frombuffer(b"".join(part.regs), np.uint16).reshape(-1, REGISTERS),
                    np.array(part.bands.tolist(), np.int64).reshape(-1, bands_of(band_rows)),
                    [np.frombuffer(x, np.uint64) for x in part.set], int(df.band.iloc[0])))
            same = df.ba.iloc[0] == df.bb.iloc[0]
            if same:
                sides[1] = sides[0]
            return block_links(sides[0], sides[1], same, num, den) if all(len(s[0]) for s in sides) else []

        for batch in batches:
            df = batch.to_pandas()
            for this, part in df.groupby(["key", "ba", "bb"], sort=False):
                if key is not None and this != key:
                    yield _pairs(flush())
                    held = []
                key = this
                held.append(part)
        if held:
            yield _pairs(flush())
    return run


def _pairs(links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def near_duplicates(
    docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
    num: int = 85, den: int = 100, tie: str | None = None, band_rows: int = ROWS,
) -> DataFrame:
    """One row per document: tie, id, n_shingles, component_id, first.

    Documents are linked if den * |intersection| >= num * |union| of their shingle sets. A lower
    limit needs fewer registers in a band (`band_rows`) to lose as few pairs.
    component_id is the smallest identifier of the component, `first` marks one row of it: the one
    with that identifier, and the lowest `tie` (a column of row numbers, else the operator's own) if
    several rows carry it. A text without words
    has an empty set and is linked with nothing. Null identifiers sort after all others; a component
    of null identifiers has a null component_id. Equal rows are linked like any equal texts.
    Other columns of `docs` are ignored, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    columns = F.col(id_col).alias("id"), F.col(text_col).alias("text")
    rows = docs.select(F.col(tie).alias("rid"), *columns) if tie else with_row_ids(docs, scratch, *columns)
    signed = scratch.write(rows.mapInArrow(
        _signer(width, band_rows), "rid long, id long, n_shingles long, h1 long, h2 long, regs binary, bands array<long>"), "signed")
    order = F.struct(F.col("id").isNull(), "id", "rid")
    classes = scratch.write(signed.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(
        F.min(order).alias("lowest")).selectExpr("h1", "h2", "n_shingles", "lowest.rid as rep", "lowest.id as low"), "classes")

    heads = signed.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi")
    keyed = scratch.write(heads.select("rid", F.posexplode("bands").alias("band", "key")), "keyed")
    full = keyed.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    members = scratch.write(keyed.join(full.select("key", "size"), "key"), "members")
    scratch.drop("keyed")

    central = members.groupBy("rid").agg(F.sum("size").alias("score"))
    members = scratch.write(members.join(central, "rid"), "central")
    pivots = scratch.write(members.groupBy("key").agg(
        F.max(F.struct("score", -F.col("rid"))).alias("top")).selectExpr("key", "-top.col2 as pivot"), "pivots")
    stars = scratch.write(members.join(pivots, "key").where("rid <> pivot").select("pivot", "rid").distinct(), "stars")

    wanted = scratch.write(central.select("rid"), "wanted")
    sets = rows.join(wanted.hint("shuffle_hash"), "rid", "left_semi").mapInArrow(_sets(width), "rid long, set binary")
    known = scratch.write(sets.join(signed.join(wanted, "rid", "left_semi").select("rid", "n_shingles", "regs", "bands"), "rid"), "known")
    scratch.drop("wanted", *([] if tie else ["rows"]))

    pivot = known.select(F.col("rid").alias("pivot"), F.col("rid").alias("a"), F.col("n_shingles").alias("na"), F.col("regs").alias("ka"), F.col("set").alias("sa"))
    member = known.select("rid", F.col("rid").alias("b"), F.col("n_shingles").alias("nb"), F.col("regs").alias("kb"), F.col("set").alias("sb"))
    links = scratch.write(stars.join(pivot, "pivot").drop("pivot").join(member, "rid").drop("rid").mapInArrow(
        _star_check(num, den), "a long, b long"), "star-links")
    comps = scratch.write(components(links, scratch, "star"), "star-comps")

    # What the stars left apart: buckets with several components and more than the pivot's pairs.
    placed = members.join(comps.withColumnRenamed("node", "rid"), "rid", "left").select(
        "key", "band", "rid", "size", F.coalesce("component", "rid").alias("comp"))
    placed = scratch.write(placed.where("size > 2"), "placed")
    main = placed.join(pivots, "key").where("rid = pivot").select("key", F.col("comp").alias("main"))
    split = scratch.write(placed.join(main, "key").groupBy("key", "main").agg(
        F.count_if(F.col("comp") != F.col("main")).alias("off"), F.count(F.lit(1)).alias("all")).where("off > 0"), "split")
    # Members away from the pivot's component meet each other and that component, in blocks.
    away = F.col("comp") != F.col("main")
    blocked = placed.join(split, "key").select(
        "key", "band", "rid", "comp", away.alias("away"),
        F.ceil(F.col("off") / BLOCK).alias("no"), F.ceil((F.col("all") - F.col("off")) / BLOCK).alias("nm"))
    blocked = blocked.withColumn("block", F.when(F.col("away"), F.pmod(F.xxhash64("rid"), "no")).otherwise(
        F.col("no") + F.pmod(F.xxhash64("rid"), F.greatest("nm", F.lit(1)))))
    meets = F.when(F.col("away"), F.sequence(F.lit(0), F.col("no") + F.col("nm") - 1)).otherwise(F.sequence(F.lit(0), F.col("no") - 1))
    paired = blocked.withColumn("other", F.explode(meets)).select(
        "key", "band", "rid", "comp", F.least("block", "other").alias("ba"), F.greatest("block", "other").alias("bb"),
        (F.col("block") > F.col("other")).cast("int").alias("side"))
    paired = paired.join(known.select("rid", "regs", "bands", "set"), "rid").repartition(
        partitions(spark), "key", "ba", "bb").sortWithinPartitions("key", "ba", "bb")
    more = scratch.write(paired.mapInArrow(_block_check(num, den, band_rows), "a long, b long"), "block-links")
    scratch.drop("members", "central", "pivots", "stars", "known", "placed", "split")

    comps = scratch.write(components(links.unionByName(more), scratch, "all"), "comps")
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = named.groupBy("component").agg(F.min(F.struct(F.col("low").isNull(), "low", "rep")).alias("lowest")).selectExpr(
        "component", "lowest.low as component_id", "lowest.rep as first_rid")
    named = scratch.write(named.join(lowest, "component").select("h1", "h2", "n_shingles", "component_id", "first_rid"), "named")
    # Documents of one class may be a third of all; adaptive execution splits them, as the class table is written.
    return signed.select("rid", "id", "n_shingles", "h1", "h2").join(named, ["h1", "h2", "n_shingles"], "left").select(
        F.col("rid").alias("tie"), "id", "n_shingles",
        F.when(F.col("first_rid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("first_rid").isNull(), True).otherwise(F.col("rid") == F.col("first_rid")).alias("first"))
