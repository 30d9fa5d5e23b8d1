"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows every input block sends to every shard is drawn first, from the multivariate
hypergeometric distribution that a uniform shuffle of all rows would have. Each block permutes its
rows and deals them out by its row of the matrix; after the exchange each shard permutes what it
got, in cells of bounded size that a random key spreads evenly. Any assignment with these shard
sizes and any order within the shards is equally likely.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

CELL = 50_000  # rows of a shard that one task orders, on average


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Equal sizes; the first shards take one more row each if it does not come out even."""
    return rows // shards + (np.arange(shards) < rows % shards)


def communication_matrix(blocks: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Rows that each block sends to each shard in a uniform shuffle: row sums `blocks`, column sums `sizes`."""
    left, out = sizes.astype(np.int64).copy(), np.zeros((len(blocks), len(sizes)), np.int64)
    for b, n in enumerate(blocks.astype(np.int64).tolist()):
        rest, total = n, int(left.sum())
        for s in range(len(sizes)):
            # One shard after the other: of the places still open, `left[s]` are this shard's.
            total -= int(left[s])
            got = _hypergeometric(int(left[s]), total, rest, rng)
            out[b, s] = got
            rest -= got
        left -= out[b]
    return out


def _hypergeometric(good: int, bad: int, draws: int, rng: np.random.Generator) -> int:
    """Good ones among `draws` without replacement; beyond numpy's range by drawing distinct places."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    places = np.unique(rng.integers(good + bad, size=draws))
    while len(places) < draws:
        # Later draws only replace those that hit a taken place, so every set is equally likely.
        places = np.unique(np.concatenate([places, rng.integers(good + bad, size=draws - len(places))]))
    return int((places < good).sum())


def shuffle(docs: DataFrame, scratch: Scratch, columns: list, shards: int = 8, seed: int = 42) -> DataFrame:
    """`columns` of every row, with its shard (0 to shards - 1) and its slot there (gapless from 0).

    `columns` are names or expressions over `docs`; equal rows, null keys and null texts are dealt
    like any other row. With fewer rows than shards some shards are empty; an empty table gives no
    rows. Other columns are ignored, whatever their names.
    """
    block, place = F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("place")
    # Written once: block and place stay what they are when a task is repeated.
    rows = scratch.write(docs.select(F.struct(*columns).alias("row"), block, place), "rows")
    counts = sorted((r["block"], r["n"]) for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    sizes, rng = shard_sizes(total, shards), np.random.default_rng(seed)
    matrix = communication_matrix(np.array([n for _, n in counts]), sizes, rng)
    # One line per block, as the tasks of the scan; its columns are where each shard's stretch ends.
    ends = rows.sparkSession.createDataFrame(
        [(int(b), [int(x) for x in np.cumsum(matrix[i])]) for i, (b, _) in enumerate(counts)], "block int, ends array<long>")
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), "place"), "place")
    dealt = rows.withColumn("at", F.row_number().over(local) - 1).join(ends, "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("at"))))
    cells = max(1, -(-int(sizes.max() if total else 0) // CELL))
    key = F.xxhash64(F.lit(seed + 1), "place")
    # The cell is the leading part of the random key, so that cells follow each other in its order.
    cell = F.floor((key / 2.0**64 + 0.5) * cells).cast("int")
    dealt = scratch.write(dealt.select(
        "row", "place", "shard", key.alias("key"), F.greatest(F.lit(0), F.least(F.lit(cells - 1), cell)).alias("cell")), "dealt")
    filled = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "cell").orderBy("key", "place")
    return dealt.withColumn("nth", F.row_number().over(inside) - 1).join(offsets, ["shard", "cell"]).select(
        "row.*", "shard", (F.col("base") + F.col("nth")).alias("slot"))
