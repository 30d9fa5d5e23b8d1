"""Audit of filters that are applied one after the other: what each removes in every order.

A filter's share depends on its place, so all orders are looked at. The states of the lattice are
the sets of filters already applied; an edge applies one more filter. Documents shrink to counts per
part and set of failed filters, which give the removals of every edge. Counting the paths that reach
an edge (forward) and those that leave it (backward) says in how many orders it is taken: removals
weighted by that sum up to the Shapley value times the number of orders. The steps of any one order
are read from the same edges.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

BREAK = r"[\x20\x09-\x0D]+"
LENGTHS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D on a text; words end at white space and are compared as they are."""
    words = F.array_remove(F.split(text, BREAK), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """For every set of filters (as bits): orders that reach it from none, and that go on to all."""
    full = (1 << filters) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    for state in range(full + 1):
        for f in range(filters):
            if not state >> f & 1:
                reach[state | 1 << f] += reach[state]
    for state in range(full, -1, -1):
        for f in range(filters):
            if not state >> f & 1:
                leave[state] += leave[state | 1 << f]
    return reach, leave


def edges(filters: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through it) of the lattice."""
    reach, leave = path_counts(filters)
    return [(s, f, reach[s] * leave[s | 1 << f]) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]


def steps(names: list[str]) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every order."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for k, f in enumerate(order, 1):
            out.append(("".join(names[i] for i in order), k, state, f))
            state |= 1 << f
    return out


def failed_sets(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """(part, failed, good, toxic, docs): documents per part, set of failed filters (as bits, E the
    highest) and label.

    Rows shrink to a digest and five bits in the scan. E asks for a smaller identifier with the same
    text: the smallest of every text is found by partial aggregation and joined back by text and
    identifier, so that a text which a third of all rows share is no hot key. A null text is empty, a
    null identifier is smaller than none and larger than none. Labels of one identifier count as one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    tests = text_filters(F.col("_text"))
    bits = sum((test.cast("int") * (1 << k) for k, test in enumerate(tests.values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = scratch.write(rows.select("id", "part", F.unhex(F.sha2(F.col("_text"), 256)).alias("digest"), bits.alias("failed")).groupBy(
        "digest", "id", "part", "failed").agg(F.count(F.lit(1)).alias("docs")), "rows")
    # Every text has a first identifier; the others fail E.
    first = scratch.write(rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True)), "first")
    marks = scratch.write(labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")), "labels")
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "id"], "left").join(marks, "id", "left").groupBy(
        "part", (F.col("failed") + repeated.cast("int") * (1 << len(tests))).alias("failed"),
        (F.coalesce("good", F.lit(0)) == 1).alias("good"), (F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"),
    ).agg(F.sum("docs").alias("docs"))


def lattice(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order and step from counts per part and set of failed filters.

    Every set meets the edges it counts for, at most 80 of five filters; nothing here grows with the
    number of documents.
    """
    n = len(names)
    cells = counts.groupBy("part", "failed").agg(
        F.sum("docs").alias("docs"), F.sum(F.when(F.col("good"), F.col("docs")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("toxic"))
    edge = F.explode(F.array(*(F.struct(
        F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges(n))))
    # An edge concerns the documents that pass the filters before it.
    at = cells.select("*", edge.alias("e")).select("*", "e.*").where("failed & state = 0")
    hit = F.expr("shiftright(failed, filter) & 1 = 1")

    def lost(column: str) -> Column:
        return F.sum(F.when(hit, F.col(column)).otherwise(0))

    of_edge = at.groupBy("part", "state", "filter").agg(
        lost("docs").alias("removed"), F.sum(F.when(~hit, F.col("docs")).otherwise(0)).alias("kept"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.max("orders").alias("orders"))
    single = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(1 << f).alias("bit")) for f in range(n))))
    fails = cells.select("*", single.alias("x")).select("*", "x.*").groupBy("part", "filter").agg(
        F.sum(F.when(F.expr("failed & bit <> 0"), F.col("docs")).otherwise(0)).alias("fails"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("docs")).otherwise(0)).alias("unique_fails"))
    shapley = of_edge.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    order = F.explode(F.array(*(F.struct(
        F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(s).alias("state"), F.lit(f).alias("filter")) for o, k, s, f in steps(names))))
    out = cells.select("part").distinct().select("part", order.alias("o")).select("part", "o.*")
    out = out.join(fails.join(shapley, ["part", "filter"], "left"), ["part", "filter"]).join(of_edge, ["part", "state", "filter"], "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("kept", "removed", "good_lost", "toxic_lost", "unique_fails", "shapley")}
    zero["redundant"] = F.col("fails") - zero["removed"]
    return out.select("part", "filter_order", "step", *(zero[c].cast("long").alias(c) for c in LENGTHS))


def audit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
) -> DataFrame:
    """part, filter_order (a permutation of ABCDE), step (1 to 5), then counts of the part: kept and
    removed by the step, redundant (fails the filter, removed before), unique_fails, good_lost,
    toxic_lost and shapley (the filter's removals over all orders).

    A null part is the empty string. A null or empty text has no words: it fails A, and E if it is not
    the first empty one. Repeated rows count each; those with the smallest identifier of their text
    pass E. Documents without a label are neither good nor toxic; labels of no document are ignored, as
    are other columns. An empty table gives no rows.
    """
    counts = scratch.write(failed_sets(docs, labels, scratch, id_col, text_col, part_col), "counts")
    return lattice(counts, list("ABCDE"))
