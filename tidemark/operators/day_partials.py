"""Sums per key and day that are kept, so that a report reads what is new and no more.

Sums and counts of days add up to those of any window, and a two-period comparison is a sum of day
sums. Days become final when the source says that they no longer change. A refresh reads the facts
after the last final day, replaces those days and leaves the others alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_days_after, stage, staging_scope
from .aggregate import two_period
from .periods import Windows, mark


def final_through(spark: SparkSession, path: str) -> date | None:
    """The last day that is kept as final; later ones are kept too but read again."""
    try:
        return spark.read.parquet(f"{path}/final").agg(F.max("day")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def facts_to_read(facts: DataFrame, last: date | None) -> DataFrame:
    """Facts of days that are not kept as final; the bound reaches the scan as a literal."""
    return facts if last is None else facts.filter(F.col("date") > F.lit(last))


def refresh(facts: DataFrame, path: str, keys: list[str], measures: dict[str, Column], final: date | None) -> DataFrame:
    """Bring the kept sums up to the facts; days up to `final` will not be read again. Returns the table.

    A day's folder is replaced as a whole: a key that has dropped out of a day that is not final leaves
    nothing. `_rows` counts the facts. A sum over no reported value is null, so an absent metric
    stays absent. The mark of what is final is written last; an attempt that ends before that is repeated.
    """
    spark = facts.sparkSession
    last = final_through(spark, path)
    with staging_scope(spark):
        sums = stage(facts_to_read(facts, last).groupBy(*keys, "date").agg(
            *(F.sum(column).alias(name) for name, column in measures.items()), F.count("*").alias("_rows")), "day-sums")
        remove_days_after(spark, f"{path}/days", last)
        # One file for each day: a day's keys are dealt out by the day.
        sums.withColumn("day", F.col("date")).repartition("day").write.mode("append").partitionBy("day").parquet(f"{path}/days")
    if final is not None and (last is None or final > last):
        spark.createDataFrame([(final,)], "day date").coalesce(1).write.mode("append").parquet(f"{path}/final")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Keys, date, measures and `_rows` of every kept day; `day` is the folder of the date."""
    return spark.read.parquet(f"{path}/days")


def compared(days: DataFrame, windows: Windows, keys: list[str], measures: list[str]) -> DataFrame:
    """What `two_period` gives for the facts, from the sums of their days. Only folders of the windows are read."""
    lo, hi = min(windows.cur_start, windows.prev_start), max(windows.cur_end, windows.prev_end)
    marked = mark(days.filter(F.col("day").between(F.lit(lo), F.lit(hi))), windows)
    sums = two_period(marked, keys, {m: F.col(m) for m in [*measures, "_rows"]}, rows=False)
    rows = {f"{p}rows": F.coalesce(f"{p}_rows", F.lit(0)) for p in ("cur_", "prev_")}
    return sums.withColumns(rows).drop("cur__rows", "prev__rows")
