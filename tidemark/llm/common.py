"""Row numbers, scratch folders and connected components shared by the operators of this package."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_path, remove


class Scratch:
    """Tables written to the shared folder, which a lost executor does not take along.

    A table that nothing reads any more is removed with `drop`. The tables behind an operator's
    lazy result stay; `clear` removes them once the result is written. `codec` compresses tables with a
    column of texts (`text`, `html` or `ctx`), where room matters more than time.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str | None = None):
        self.spark, self.name, self.codec, self.paths = spark, name, codec, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, f"{self.name}-{name}")
        self.paths[name] = path
        texts = self.codec and not {"text", "html", "ctx"}.isdisjoint(df.columns)
        (df.write.option("compression", self.codec) if texts else df.write).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.paths.pop(name))

    def clear(self) -> None:
        self.drop(*list(self.paths))
        gc.collect()  # lets Spark remove the shuffle files of frames that are gone

    def release(self) -> None:
        """Have the shuffle files of frames that are gone removed now, before the next large step."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def with_row_ids(df: DataFrame, scratch: Scratch, *columns: str, name: str = "rows") -> DataFrame:
    """`columns` of every row and a number `rid`, written once so that later passes see the same
    numbers. Identifiers of the input may be null or repeat; `rid` never does."""
    return scratch.write(df.select(F.monotonically_increasing_id().alias("rid"), *columns), name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """(node, component) for every node of `links` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps: every node points its larger (then its smaller and
    own) neighbours at the smallest one it knows. The edge count never grows and paths shrink by
    a constant factor, so a few rounds do for the links of near copies. Minima are pre-aggregated;
    joins on a hot node are against a written table, which lets adaptive execution split the node.
    """
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-0")
    turn, before = 0, None
    while True:
        for kind in ("large", "small"):
            if kind == "large":
                both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            else:
                both = edges
            least = scratch.write(
                both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-m{turn}")
            joined = both.join(least, "u")
            if kind == "large":
                new = joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                new = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                    least.where("u <> m").select("u", F.col("m").alias("v")))
            turn += 1
            edges = scratch.write(new.distinct(), f"{name}-{turn}")
            scratch.drop(f"{name}-m{turn - 1}", f"{name}-{turn - 1}")
        # A star forest no longer changes; its edge set is summed up as a whole.
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
