"""Exact distinct users that can be merged: bitmaps per day and segment.

Counts of users do not add up over days or segments, so each window and breakdown usually starts again
from all sessions. Here every user of a property has a number, and each day keeps, for every
segment, which numbers were seen. Any set of days and segments is then an OR of small pieces, and its
count is exact.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import ranked_all

# What makes a session count for a figure of its user.
SEEN = {
    "totalUsers": "true", "activeUsers": "engaged", "newUsers": "date = first_seen", "keyUsers": "key_events > 0",
    "totalPurchasers": "purchases > 0", "firstTimePurchasers": "date = first_purchase",
}


def user_numbers(users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(property_id, user_id, number): users of a property, numbered from 1 without gaps.

    `known` are earlier numbers, which stay; users without one follow after the last.
    """
    key = ["property_id", "user_id"]
    distinct = users.select(*key).distinct()
    if known is None:
        return ranked_all(distinct, ["property_id"], ["user_id"], "number").select(*key, F.col("number").cast("bigint").alias("number"))
    last = known.groupBy("property_id").agg(F.max("number").alias("_last"))
    fresh = ranked_all(distinct.join(known.select(*key), key, "left_anti"), ["property_id"], ["user_id"], "number")
    # A property is one row on the right; AQE splits a property that has most of the new users.
    numbered = fresh.join(last, "property_id", "left").select(
        *key, (F.col("number") + F.coalesce("_last", F.lit(0))).cast("bigint").alias("number"))
    return known.select(*key, "number").unionByName(numbered)


def day_bitmaps(sessions: DataFrame, numbers: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """One piece of bitmap per property, dataset, key, day, figure and 32,768 user numbers.

    `dimensions` maps a dataset name to an expression over the sessions. Sessions shrink to one row per
    user, day, key and figure before they are counted; a piece is 4 KB at most, however many
    sessions are behind it. Pieces of one day and user range of two tables are merged by `merged`.
    """
    rows = ", ".join(f"struct('{name}' AS dataset, CAST({column} AS STRING) AS key)" for name, column in dimensions.items())
    figures = ", ".join(f"IF({test}, '{name}', NULL)" for name, test in SEEN.items())
    seen = sessions.select("property_id", "user_id", "date", F.expr(f"array_compact(array({figures}))").alias("figures"), F.inline(F.expr(f"array({rows})")))
    daily = seen.withColumn("figure", F.explode("figures")).select("property_id", "user_id", "date", "dataset", "key", "figure").distinct()
    placed = daily.join(numbers, ["property_id", "user_id"])
    return placed.groupBy("property_id", "dataset", "key", "date", "figure", F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("users"))


def merged(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Pieces with the same `by`, figure and user range as one: for coarser days, segments or tables."""
    return pieces.groupBy(*by, "figure", "bucket").agg(F.expr("bitmap_or_agg(users)").alias("users"))


def distinct_users(pieces: DataFrame, windows: dict[str, tuple[date, date]], by: tuple[str, ...] = ("property_id", "dataset", "key")) -> DataFrame:
    """Exact users per key and window, one column for each figure; zero where a figure had none.

    All windows come from one scan, which reads no day outside of them.
    """
    spans = ", ".join(f"IF(date BETWEEN DATE '{s}' AND DATE '{e}', '{name}', NULL)" for name, (s, e) in windows.items())
    within = pieces.filter(F.col("date").between(F.lit(min(s for s, _ in windows.values())), F.lit(max(e for _, e in windows.values()))))
    tagged = within.withColumn("window", F.explode(F.expr(f"array_compact(array({spans}))")))
    counts = merged(tagged, [*by, "window"]).groupBy(*by, "window", "figure").agg(F.sum(F.expr("bitmap_count(users)")).alias("n"))
    return counts.groupBy(*by, "window").agg(*(
        F.coalesce(F.max(F.when(F.col("figure") == name, F.col("n"))), F.lit(0)).alias(name) for name in SEEN))
