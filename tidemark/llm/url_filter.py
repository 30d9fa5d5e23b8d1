"""URL filters by a sort-merge range join.

A host is keyed by its labels in reverse, `org.example.www.`; the hosts under a rule's host are then
one interval of keys. Rules and URLs are sorted together by key, and one sweep keeps the rules whose
interval is open on a stack: the rules above any URL are nested, the innermost on top. Tasks sweep
disjoint ranges of keys that hold about equally many rows; a rule is given to every range its
interval meets, and a host with very many URLs is spread over several tasks of one range.
"""

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, partitions

RANGE_SAMPLE = 64  # sampled keys for each range; bounds what the driver sorts


def host_of(url) -> Column:
    """What stands between the first :// and the next /, ? or #, with A to Z in lower case; else empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> Column:
    """From the end of the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host) -> Column:
    """`www.example.org` as `org.example.www.`, in an order that keeps subdomains next to their domain."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def key_end(key: str) -> str:
    """The least key after all keys that start with `key`: its final dot replaced by the next sign."""
    return key[:-1] + "/"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in the order of keys, rules before URLs; URLs leave with their rule."""
    stack: list[tuple[str, list]] = []  # (key of the rules' host, its rules, longest first)
    last = None
    for batch in batches:
        found = []
        take = []
        for i, (part, key, is_url, host, path, verdict) in enumerate(zip(
                *(batch.column(c).to_pylist() for c in ("part", "key", "is_url", "host", "path", "verdict")), strict=True)):
            if part != last:
                stack, last = [], part
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                rules = stack[-1][1]
                rules.append((len(host) + len(path), path, host, verdict))
                rules.sort(reverse=True)
                continue
            best = None
            for _, rules in reversed(stack):
                fit = next((r for r in rules if path.startswith(r[1])), None)
                if fit and (best is None or fit > best):
                    best = fit
            take.append(i)
            found.append((best[2] + best[1], best[3]) if best else (None, None))
        cols = [batch.column(c).take(pa.array(take, pa.int64())) for c in ("row", "host", "path")]
        yield pa.RecordBatch.from_arrays(
            [*cols, *(pa.array([f[j] for f in found], pa.string()) for j in (0, 1))], ["row", "host", "path", "rule", "verdict"])


def match(
    pages: DataFrame, rules: DataFrame, scratch: Scratch, carry: list[str], url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """The columns in `carry` of every row, host, path, rule (host and path of the rule, else null) and
    verdict (the rule's, else `default`).

    `rules` has host, path and verdict (allow or block). A rule fits its host and all subdomains if the
    URL's path starts with the rule's; of several the longest wins (host and path together, then the
    later path, then the later host in order). A rule with an empty host fits every URL whose path starts with its
    path. A null URL, or one without ://, has empty host and path. Repeated rows are judged one by one;
    of equal rules `block` wins. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    urls = scratch.write(pages.select(F.struct(*carry).alias("row"), host.alias("host"), path.alias("path")).withColumn(
        "key", key_of(F.col("host"))), "urls")
    n = partitions(spark)
    # Range borders from a sample; they only balance the tasks. A frequent host repeats among them.
    count = urls.count()
    share = min(1.0, 2.0 * RANGE_SAMPLE * n / max(1, count))
    sample = sorted(r["key"] for r in urls.select("key").sample(share, 7).limit(4 * RANGE_SAMPLE * n).collect())
    picked = [sample[i * len(sample) // n] for i in range(1, n)] if len(sample) >= n else []
    borders = sorted(set(picked))
    copies = [1 + sum(b == x for x in picked) for b in borders]  # tasks for the range that begins here
    # Ranges: before the first border, and from each border to the next. A hot border key has a range
    # of its own, so that its copies hold little else.
    edges: list[tuple[str, int]] = [("", 1)]
    for b, c in zip(borders, copies, strict=True):
        edges.append((b, c))
        if c > 2:
            edges.append((b + "\0", 1))
    starts, many = [e for e, _ in edges], [c for _, c in edges]
    first = [sum(many[:i]) for i in range(len(many))]

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return keys.map(lambda x: bisect_right(starts, x) - 1).astype("int32")

    at = F.array(*map(F.lit, first)), F.array(*map(F.lit, many))
    spread = F.monotonically_increasing_id()
    url_rows = urls.withColumn("range", place("key")).withColumn(
        "part", F.get(at[0], "range") + F.pmod(F.xxhash64(spread), F.get(at[1], "range"))).select(
        "part", "key", F.lit(True).alias("is_url"), "host", "path", F.lit(None).cast("string").alias("verdict"), "row")

    @F.pandas_udf("array<int>")
    def meets(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            # The open interval of keys under this one, as ranges and all their copies.
            lo, hi = bisect_right(starts, k) - 1, bisect_right(starts, key_end(k)) - 1
            out.append([p for r in range(lo, hi + 1) for p in range(first[r], first[r] + many[r])])
        return pd.Series(out, dtype=object)

    # A rule without host has the key of every other one as a prefix.
    rule_key = F.when(F.col("host") == "", F.lit("")).otherwise(key_of(F.col("host")))
    row_type = urls.schema["row"].dataType
    rule_rows = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", rule_key).withColumn(
        "part", F.explode(F.when(F.col("key") == "", F.sequence(F.lit(0), F.lit(sum(many) - 1))).otherwise(meets("key")))).select(
        "part", "key", F.lit(False).alias("is_url"), "host", "path", "verdict", F.lit(None).cast(row_type).alias("row"))
    ordered = url_rows.unionByName(rule_rows).repartition(n, "part").sortWithinPartitions("part", "key", "is_url")
    row = row_type.simpleString()
    return ordered.mapInArrow(_sweep, f"row {row}, host string, path string, rule string, verdict string").select(
        "row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
