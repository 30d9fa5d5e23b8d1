"""Connected components of rows that share keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fresh_path, remove


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that `links` (a, b: whole numbers) names; the component is its
    smallest node.

    Links become stars in alternating steps: every node hangs its larger neighbours on the smallest
    node it knows, then its smaller ones. A step never adds links and shortens a path to about
    its logarithm, so a chain of look-alikes takes a few steps where following it would take as many as
    it has rows. Each step is a written table: a node with very many links is split by adaptive execution, and
    what a lost executor held is read again. Tables of earlier steps are removed.
    """
    spark = links.sparkSession

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = fresh_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).filter("node > to")
    stars, path = keep(down.distinct(), "links")
    before = None
    while True:
        for larger in (True, False):
            ways = stars.unionByName(stars.select(F.col("to").alias("node"), F.col("node").alias("to"))) if larger else stars
            least, least_path = keep(ways.groupBy("node").agg(F.least(F.min("to"), "node").alias("least")), "least")
            hung = ways.join(least, "node")
            if larger:
                new = hung.filter("to > node").select(F.col("to").alias("node"), F.col("least").alias("to"))
            else:
                new = hung.select(F.col("to").alias("node"), F.col("least").alias("to")).unionByName(
                    least.select("node", F.col("least").alias("to"))).filter("node > to")
            stars, new_path = keep(new.distinct(), "links")
            for old in (path, least_path):
                remove(spark, old)
            path = new_path
        # A star forest stays as it is, so its digest does.
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("node", "to").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select("node", F.col("to").alias("component")).unionByName(
        stars.select(F.col("to").alias("node"), F.col("to").alias("component")).distinct())
