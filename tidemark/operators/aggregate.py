"""One-scan aggregation of both periods and the helpers that keep hot properties spread out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import safe_div
from ..session import stage


def two_period(
    facts: DataFrame, keys: list[str], measures: dict[str, Column], rows: bool = True
) -> DataFrame:
    """`cur_*` and `prev_*` sums per key in one hash aggregation over marked facts.

    A sum over no reported value is null, so an absent metric stays absent.
    """
    cur, prev = F.col("in_current"), F.col("in_previous")
    aggs = []
    for name, column in measures.items():
        aggs.append(F.sum(F.when(cur, column)).alias(f"cur_{name}"))
        aggs.append(F.sum(F.when(prev, column)).alias(f"prev_{name}"))
    if rows:
        aggs.append(F.count_if(cur).alias("cur_rows"))
        aggs.append(F.count_if(prev).alias("prev_rows"))
    return facts.groupBy(*keys).agg(*aggs)


def present_in() -> Column:
    return (
        F.when((F.col("cur_rows") > 0) & (F.col("prev_rows") > 0), "both")
        .when(F.col("cur_rows") > 0, "current only")
        .otherwise("previous only")
    )


def _salts(df: DataFrame) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(256, shuffle // 4))


def attach(
    rows: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join per-property figures to the rows of that property.

    One property may own a third of all rows, so the join key carries a salt taken from the row's
    own key and the small side is copied once per salt. No broadcast is forced: the small side has
    as many rows as there are properties. Catalyst or AQE broadcasts it when its measured size is
    under the threshold, and the salted shuffle join does the work when it is not.
    """
    n = salts or _salts(rows)
    salted = rows.withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(n)).cast("int")
    )
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first `k` rows per key in a total order.

    The rank filter becomes a window group limit, so every map task passes on at most `k` rows
    per key and a hot key never gathers whole in one task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def exact_median(
    df: DataFrame, keys: list[str], value: str, out: str = "median", most: int | None = 1_000_000
) -> DataFrame:
    """Exact median of any values, unrounded, with the row count.

    Rows collapse to one per distinct value first. Where no key has more than `most` of them, one
    window per key does; None says that the domain of the values sees to that. Else the values are range-partitioned by key and value, so a big key
    spans many tasks, and every stretch is shifted by the rows of the stretches before it.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    largest = 0
    if most is not None:
        counted = stage(counted, "median-values")
        largest = counted.groupBy(*keys).agg(F.count("*").alias("_k")).agg(F.max("_k")).first()[0] or 0
    if most is None or largest <= most:
        w = Window.partitionBy(*keys)
        placed = counted.withColumns({
            "_upto": F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_all": F.sum("_n").over(w)})
    else:
        ranged = stage(counted.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "median-ranged")
        sums = ranged.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
        w = Window.partitionBy(*keys)
        # One figure per key and stretch.
        offsets = sums.withColumns({
            "_before": F.coalesce(F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_all": F.sum("_sum").over(w)}).drop("_sum")
        inside = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = ranged.withColumn("_inside", F.sum("_n").over(inside)).join(offsets, [*keys, "_part"]).withColumn(
            "_upto", F.col("_inside") + F.col("_before"))
    low = F.floor((F.col("_all") + 1) / 2)
    high = F.floor((F.col("_all") + 2) / 2)
    before = F.col("_upto") - F.col("_n")

    def holds(place: Column) -> Column:
        return F.when((before < place) & (F.col("_upto") >= place), F.col(value))

    return placed.groupBy(*keys).agg(
        ((F.max(holds(low)) + F.max(holds(high))) / F.lit(2.0)).alias(out),
        F.max("_all").alias("rows"),
    )


def share_of(part: Column, whole: Column) -> Column:
    """Percent of a whole; null when either is missing or the whole is zero."""
    return F.lit(100.0) * safe_div(part, whole)


def rollup_merge(parts: list[DataFrame], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Full outer merge of metric exports on their keys; a later part overrides.

    Also returns, per later part, how many keys the first part did not have.
    """
    merged = parts[0].withColumn("_base", F.lit(True))
    strays = None
    for number, part in enumerate(parts[1:], start=2):
        marked = part.withColumn("_part", F.lit(True))
        shared = [c for c in part.columns if c not in keys and c in merged.columns]
        renamed = marked
        for c in shared:
            renamed = renamed.withColumnRenamed(c, f"_new_{c}")
        joined = merged.join(renamed, keys, "full_outer")
        missing = joined.filter(F.col("_base").isNull() & F.col("_part").isNotNull()).agg(
            F.count("*").alias("stray_rows")
        ).withColumn("part", F.lit(number))
        strays = missing if strays is None else strays.unionByName(missing)
        for c in shared:
            joined = joined.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
        merged = joined.withColumn("_base", F.lit(True)).drop("_part")
    return merged.drop("_base"), strays


def join_unique(rows: DataFrame, unique: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a frame with one row per key, whose size is that of the data.

    The unique side is written first. An aggregate directly under the join would keep adaptive
    execution from splitting a partition of `rows` that one key has filled; a table does not.
    """
    return rows.join(stage(unique, "unique"), on, how)


def numbered(df: DataFrame, keys: list[str], seq: str, out: str, width: int = 1_000_000) -> DataFrame:
    """`row_number` per key in the order of a whole-number sequence, for groups of any size.

    Rows are ranked inside blocks of the sequence, then shifted by the rows of earlier blocks, so
    no task sees more than one block of a hot key. `seq` is unique.
    """
    blocks = df.withColumn("_block", F.expr(f"{seq} div {width}"))
    counts = blocks.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(seq))
    ranked = blocks.withColumn("_inside", inside)
    joined = ranked.join(offsets, [*keys, "_block"])
    return joined.withColumn(out, F.col("_inside") + F.col("_before")).drop(
        "_block", "_inside", "_before")


def ranked_all(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Position of every row inside its key, for keys of any size.

    Rows are range-partitioned by key and order, so a big key spans many tasks; each task ranks
    its stretch and is shifted by the rows of the stretches before it. The ranged rows are written
    once, because a second evaluation could draw other range bounds.
    """
    columns = [F.col(c) for c in [*keys, *order]]
    # Range partitioning samples its input first; a written input is not computed twice for that.
    rows = stage(df, "unranked")
    ranged = stage(
        rows.repartitionByRange(*columns).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside).join(offsets, [*keys, "_part"])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_part", "_inside", "_before")
    )


def counted_before(
    rows: DataFrame, marks: DataFrame, keys: list[str], at: str, out: str, width: int = 1_000_000
) -> DataFrame:
    """How many `marks` (keys and `at`) of a row's key lie before the row's own `at`, a whole number.

    Equal marks become one with a count. Numbers are cut into blocks: whole blocks before a row's
    come from prefix sums over one figure per block, the rest from a window inside the block, which
    holds `width` different marks at most. So a key of any size is spread over many tasks.
    """
    block = F.expr(f"{at} div {width}")
    weighed = marks.groupBy(*keys, at).agg(F.count("*").alias("_n")).withColumn("_block", block)
    placed = rows.withColumn("_block", block)
    sums = weighed.select(*keys, "_block", "_n").unionByName(
        placed.select(*keys, "_block").distinct().withColumn("_n", F.lit(0).cast("bigint")))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # At equal places rows come first, as a mark there is not before them.
    both = placed.withColumn("_mark", F.lit(0)).unionByName(
        weighed.withColumn("_mark", F.lit(1)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_block").orderBy(at, "_mark").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    counted = both.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).filter("_mark = 0")
    return counted.join(offsets, [*keys, "_block"]).withColumn(
        out, F.col("_inside") + F.col("_before")).drop("_block", "_mark", "_n", "_inside", "_before")


def least_before(
    rows: DataFrame, keys: list[str], seq: str, value: str, out: str, width: int = 1_000_000
) -> DataFrame:
    """The least `value` among earlier rows of the key, in the order of a whole-number sequence.

    As in `numbered`, blocks of the sequence are looked at by themselves and joined to the least
    value of all blocks before. `seq` is unique; the first row of a key gets null.
    """
    blocks = rows.withColumn("_block", F.expr(f"{seq} div {width}"))
    least = blocks.groupBy(*keys, "_block").agg(F.min(value).alias("_least"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = least.withColumn("_before", F.min("_least").over(before)).drop("_least")
    inside = Window.partitionBy(*keys, "_block").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_inside", F.min(value).over(inside)).join(offsets, [*keys, "_block"])
    return placed.withColumn(out, F.least("_inside", "_before")).drop("_block", "_inside", "_before")
